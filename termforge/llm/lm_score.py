"""Language-model scores from a weighted backoff automaton.

Training counts n-grams of words (A-Z lower-cased) with a start and an end mark. States are the
seen histories of up to order - 1 words; a state's arc for a seen continuation carries its log
probability, its failure arc leads to the history without its first word and carries the backoff
weight. Weights are Dirichlet-smoothed: p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), down to
add-one unigrams with one place for unknown words, so probabilities of all words sum to 1.

No model is broadcast or collected. Documents go in blocks; a block asks the ranges of the hash
space for the corpus counts of its own n-grams (all of them, no cut-off) and builds from them the
automaton's part that its documents can reach: states, arcs, failure arcs. Then all its documents
are traversed once from left to right, each with its state carried along, log probabilities added
up. Words are known by 64-bit hashes.

Null and empty texts are one end mark. Repeated rows count and are scored each, rows without doc_id
too. A very long text is never cut; a block that holds it takes about 200 bytes a word of it in a
worker. An empty table gives an empty result; with no training row every word is unknown. Extra
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.llm import _blocks as K
from termforge.llm import _bytes as B
from termforge.llm._store import keep

ORDER, PRIOR = 2, 60.0
START, END = B.U(0x243F6A8885A308D3), B.U(0x13198A2E03707344)


def sequences(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All documents' START, word hashes, END in one array, and its n + 1 document offsets."""
    words, sizes = [], []
    for chunk in texts.chunks:
        h, first = B.word_hashes(chunk)
        words.append(h)
        sizes.append(np.diff(first))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    at = np.concatenate(([0], np.cumsum(size + 2)))
    out = np.empty(at[-1], np.uint64)
    out[at[:-1]], out[at[1:] - 1] = START, END
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[inner] = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return out, at


def grams(sequence: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n-gram that ends there, position) for each position of a word or END with n - 1 before it."""
    place = np.arange(len(sequence)) - np.repeat(at[:-1], np.diff(at))
    ends = np.flatnonzero(place >= max(1, n - 1))
    out = np.full(len(ends), n, np.uint64)
    for k in range(n - 1, -1, -1):
        out = B.mix(out * B.U(0x9FB21C651E98DF25) + sequence[ends - k])
    return out, ends


def _ask(order: int, parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("gram", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
        for number, table in K.thawed(batches):
            sequence, at = sequences(table.column(1))
            training = np.repeat(table.column(2).to_numpy().astype(bool), np.diff(at))
            rows: list[tuple] = []
            for n in range(1, order + 1):
                hashes, ends = grams(sequence, at, n)
                own, index = np.unique(hashes, return_inverse=True)
                counts = np.bincount(index[training[ends]], minlength=len(own)).astype(np.uint32)
                cut = K.cuts(own, parts)
                rows += [(p, number, n, K.pack_sorted(own[a:b]), K.pack(counts[a:b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(5)], schema=schema)

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """Of one range: the corpus count of each hash, block by block; row 0 of order 1 has the range's tokens and words."""
    part = table.column("part")[0].as_py()
    out, tokens, known = [], 0, 0
    orders = np.array(table.column("gram").to_pylist())
    for n in sorted(set(orders.tolist())):
        rows = np.flatnonzero(orders == n)
        hashes = [K.unpack_sorted(table.column("hashes")[int(i)].as_py()) for i in rows]
        counts = [K.unpack(table.column("counts")[int(i)].as_py(), np.uint32) for i in rows]
        own, index = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(index, np.concatenate(counts).astype(float), len(own)).astype(np.uint64)
        if n == 1:
            tokens, known = int(total.sum()), int((total > 0).sum())
        ends = np.cumsum([len(h) for h in hashes])
        for i, a, b in zip(rows, np.concatenate(([0], ends[:-1])), ends, strict=True):
            out.append((table.column("block")[int(i)].as_py(), part, n, K.pack(total[index[a:b]]), tokens, known))
            tokens = known = 0
    return pa.table({k: pa.array([r[j] for r in out], t) for j, (k, t) in enumerate((("block", pa.int64()), ("part", pa.int32()), ("gram", pa.int32()), ("counts", pa.binary()), ("tokens", pa.int64()), ("known", pa.int64())))})


@dataclass
class Automaton:
    """States are histories that the corpus has; 0 is the empty one, 1 the start mark.

    arcs: state * words + word of every arc, sorted; score, target: of each arc its log10
    probability and where it leads; weight, fail: of each state its failure arc's log10 weight and
    where it leads, to the history without its first word.
    """

    words: int
    arcs: np.ndarray
    score: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    fail: np.ndarray

    def walk(self, sequence: np.ndarray, start: np.ndarray, size: np.ndarray, few: int = 64) -> np.ndarray:
        """log10 probability of each document's words, sequence[start : start + size] (indices).

        One traversal from left to right: the states of all documents move a word at a time; what is
        left of the longest `few` is walked one document after another.
        """
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, total = np.ones(len(size), np.int64), np.zeros(len(size))
        step, upto = 0, len(size)
        while upto > few:
            word = sequence[start[:upto] + step]
            here, sums = state[:upto], total[:upto]
            key = here * self.words + word
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            left = np.flatnonzero(self.arcs[arc] != key)
            while len(left):
                sums[left] += self.weight[here[left]]
                here[left] = self.fail[here[left]]
                key = here[left] * self.words + word[left]
                arc[left] = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                left = left[self.arcs[arc[left]] != key]
            sums += self.score[arc]
            here[:] = self.target[arc]
            step += 1
            upto = int(np.searchsorted(-size, -step, "left"))  # documents longer than what is read
        if upto:
            self._walk_each(sequence, start[:upto], size[:upto], step, state, total)
        out = np.empty(len(size))
        out[order] = total
        return out

    def _walk_each(self, sequence: np.ndarray, start: np.ndarray, size: np.ndarray, step: int, state: np.ndarray, total: np.ndarray) -> None:
        arcs, score, target, weight, fail = (x.tolist() for x in (self.arcs, self.score, self.target, self.weight, self.fail))
        n = len(arcs)
        for d in range(len(start)):
            s, t = int(state[d]), 0.0
            for word in sequence[start[d] + step : start[d] + size[d]].tolist():
                key = s * self.words + word
                arc = bisect_left(arcs, key)
                while arc == n or arcs[arc] != key:
                    t += weight[s]
                    s = fail[s]
                    key = s * self.words + word
                    arc = bisect_left(arcs, key)
                t += score[arc]
                s = target[arc]
            state[d] = s
            total[d] += t


def build(sequence: np.ndarray, at: np.ndarray, counts: list[np.ndarray], tokens: int, known: int, prior: float) -> tuple[Automaton, np.ndarray, np.ndarray]:
    """(the automaton's part that the block can reach, word index at each position, count of each word).

    counts[n - 1]: corpus counts of the block's sorted distinct n-grams. An n-gram that the corpus
    has is an arc from its history's state; the empty history has an arc for every word.
    """
    order, arcs, scores, targets, n_states = len(counts), [], [], [], 2
    fails, weights = [np.zeros(2, np.int64)], []
    for n, own in enumerate(counts, 1):
        hashes, ends = grams(sequence, at, n)
        _, first, index = np.unique(hashes, return_index=True, return_inverse=True)
        gram = np.full(len(sequence), -1)  # the n-gram that ends at a position
        gram[ends] = index
        place, count = ends[first], own.astype(float)
        if n == 1:
            word_at, of_word, n_words = gram, count, max(1, len(own))
            last = at[1:] - 1
            starts = count[gram[last[0]]] if len(last) else 0.0  # START is followed as often as END ends
            weights.append(np.log10([1.0, prior / (starts + prior)]))
            shorter, source = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            p, seen = (count + 1) / (tokens + known + 1), np.ones(len(own), bool)
        else:
            history, suffix = before[place - 1], before[place]
            follows = np.where(history >= 0, before_count[history], starts)
            source, shorter = np.where(history >= 0, before_state[history], 1), before_state[suffix]
            p, seen = (count + prior * before_p[suffix]) / (follows + prior), count > 0
        state = np.zeros(len(own), np.int64)
        if n < order:  # histories of n words
            is_state = count > 0
            state[is_state] = n_states + np.arange(int(is_state.sum()))
            n_states += int(is_state.sum())
            fails.append(shorter[is_state])
            weights.append(np.log10(prior / (count[is_state] + prior)))
        arcs.append((source * n_words + word_at[place])[seen])
        scores.append(np.log10(p)[seen])
        targets.append((state if n < order else shorter)[seen])
        before, before_count, before_state, before_p = gram, count, state, p
    keys, score, target, weight, fail = (np.concatenate(x) for x in (arcs, scores, targets, weights, fails))
    by_key = np.argsort(keys, kind="stable")
    return Automaton(n_words, keys[by_key], score[by_key], target[by_key], weight, fail), word_at, of_word


def traverse(sequence: np.ndarray, at: np.ndarray, counts: list[np.ndarray], tokens: int, known: int, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, base score, known tokens) of each document of a block."""
    machine, word_at, of_word = build(sequence, at, counts, tokens, known, prior)
    n_docs = len(at) - 1
    documents = np.repeat(np.arange(n_docs), np.diff(at))
    spoken = word_at >= 0
    count = of_word[word_at[spoken]]
    base = np.bincount(documents[spoken], np.log10((count + 1) / (tokens + known + 1)), n_docs)
    seen = np.bincount(documents[spoken], count > 0, n_docs).astype(np.int64)
    return machine.walk(word_at, at[:-1] + 1, np.diff(at) - 1), base, seen


def _scorer(order: int, tokens: int, known: int, prior: float, kind: pa.DataType):
    def score(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        table = K.thaw(texts.column("body")[0].as_py())
        sequence, at = sequences(table.column(1))
        found = sorted(zip(answers.column("gram").to_pylist(), answers.column("part").to_pylist(), answers.column("counts").to_pylist(), strict=True), key=lambda r: r[:2])
        counts = [np.concatenate([K.unpack(c) for g, _, c in found if g == n] or [np.zeros(0, np.uint64)]) for n in range(1, order + 1)]
        score, base, seen = traverse(sequence, at, counts, tokens, known, prior)
        return pa.table({
            "doc_id": table.column(0).cast(kind), "held_out": pa.array(~table.column(2).to_numpy().astype(bool)), "n_tokens": pa.array(np.diff(at) - 1, pa.int64()), "n_known": pa.array(seen, pa.int64()),
            "train_tokens": pa.array(np.full(len(at) - 1, tokens), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
        })

    return score


def score(docs: DataFrame, training: Column, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; the model learns from rows where `training` is true."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    texts = keep(rows.mapInArrow(K.frozen, K.FROZEN))
    parts = K.ranges(texts)
    questions = texts.mapInArrow(_ask(order, parts), "part int, block bigint, gram int, hashes binary, counts binary")
    answers = keep(questions.groupBy("part").applyInArrow(_answer, "block bigint, part int, gram int, counts binary, tokens bigint, known bigint"))
    n = answers.agg(F.sum("tokens").alias("tokens"), F.sum("known").alias("known")).first()
    from pyspark.sql.pandas.types import to_arrow_type

    scorer = _scorer(order, n["tokens"] or 0, n["known"] or 0, prior, to_arrow_type(docs.schema["doc_id"].dataType))
    both = texts.groupBy("block").cogroup(answers.select("block", "part", "gram", "counts").groupBy("block"))
    return both.applyInArrow(scorer, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
