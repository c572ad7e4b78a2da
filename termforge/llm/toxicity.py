"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer (learned words and word beginnings, and closed word classes) turns the words of
a clause into symbols: insult, threat verb, intent, target, negation, reported speech, other. Four
small transducers, given as tables, mark insults and threats: under a negation at most REACH words
back; intended at most REACH words back; in a clause with a target; in a clause that reports speech.
The last two read ahead by guessing: a path that guessed a target that never comes isn't accepted,
nor one that meets a target it ruled out, so one path of each clause is. The four are composed to one
machine; its arcs weigh an insult by its lexicon weight times a factor for each mark, and a threat
by its own weight if it is intended and has a target. A path's weights add up to the clause's
evidence; a document's is its strongest clause plus a share of the rest, turned to a probability by
a logistic curve.

Lexicon, factors and curve are fitted on a sample of labelled rows of at most `most_rows` expected
rows (documented bound, by a hash of doc_id): the factors by coordinate steps on the penalised
likelihood, held near their priors where the rows say little. Scoring covers every row and whole
texts, in time linear in their length. Null and empty texts score by the curve at no evidence. Rows of
labels whose label is null, or that match no document, aren't used; without usable labels of both
classes the lexicon is the fixed seed and the factors are the priors. Repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
# Fixed word lists of the closed classes (English, German, French, Spanish).
TARGETS = frozenset("you your u yours yourself he she they them this that these those du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti tus usted eres".split())
NEGATIONS = frozenset("not no never neither nor isn aren wasn don doesn didn nicht kein keine nie pas jamais aucun aucune nunca jamás ningún".split())
REPORTED = frozenset("said says say quote quoted quoting called wrote reported claims claimed sagte sagt zitat dit disait écrit dijo dice escribió".split())
THREATS = frozenset("kill hurt destroy beat murder shoot stab töten umbringen tuer frapper matar golpear".split())
INTENT = frozenset("will gonna shall going must should werde wirst vais allons voy vamos".split())
SEED = frozenset("idiot stupid moron loser scum trash pathetic worthless disgusting".split())
REACH = 4


# Symbols that the lexicon transducer writes.
INSULT, THREAT, BOTH, INTENDED, TARGET, NEGATION, REPORT, OTHER = "I", "K", "B", "W", "T", "N", "R", "o"
SYMBOLS = (INSULT, THREAT, BOTH, INTENDED, TARGET, NEGATION, REPORT, OTHER)
CLASSES = {w: c for c, words in ((THREAT, THREATS), (INTENDED, INTENT), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTED)) for w in words}


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) to (state, mark); where a state has no arc for a symbol the path ends there."""

    starts: tuple
    finals: frozenset
    arcs: dict[tuple, tuple]


def reaching(trigger: str, mark: str) -> Transducer:
    """Marks what follows the trigger within REACH words; states count the words left."""
    arcs = {(k, x): (REACH, "") if x == trigger else (max(0, k - 1), mark if k else "") for k in range(REACH + 1) for x in SYMBOLS}
    return Transducer((0,), frozenset(range(REACH + 1)), arcs)


def containing(trigger: str, mark: str) -> Transducer:
    """Marks everything in a clause that holds the trigger anywhere: the start guesses whether it does."""
    arcs = {("none", x): ("none", "") for x in SYMBOLS if x != trigger}
    arcs |= {("ahead", x): ("seen" if x == trigger else "ahead", mark) for x in SYMBOLS}
    arcs |= {("seen", x): ("seen", mark) for x in SYMBOLS}
    return Transducer(("none", "ahead"), frozenset(("none", "seen")), arcs)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same symbols; a composed arc writes the marks of both. Only states that can be reached."""
    starts = tuple(product(a.starts, b.starts))
    arcs, left, known = {}, list(starts), set(starts)
    while left:
        state = left.pop()
        for x in SYMBOLS:
            if (state[0], x) in a.arcs and (state[1], x) in b.arcs:
                (p, m), (q, n) = a.arcs[state[0], x], b.arcs[state[1], x]
                arcs[state, x] = (p, q), m + n
                if (p, q) not in known:
                    known.add((p, q))
                    left.append((p, q))
    return Transducer(starts, frozenset(s for s in known if s[0] in a.finals and s[1] in b.finals), arcs)


MACHINE = reduce(compose, (reaching(NEGATION, "n"), reaching(INTENDED, "i"), containing(TARGET, "t"), containing(REPORT, "r")))


def marked(symbols: list[str], machine: Transducer = MACHINE) -> list[str]:
    """The marks of each symbol on the accepted path."""
    for state in machine.starts:
        out = []
        for x in symbols:
            arc = machine.arcs.get((state, x))
            if arc is None:
                break
            state = arc[0]
            out.append(arc[1])
        else:
            if state in machine.finals:
                return out
    raise AssertionError("no path is accepted")


#: Priors of the weights: of a negated, a reported and a targeted insult as factors, and of a threat.
PRIORS = {"n": 0.4, "r": 0.5, "t": 1.25, "threat": 3.0}


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    slope: float = 2.0
    offset: float = -2.5
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIORS))

    def __post_init__(self) -> None:
        self.sizes = sorted({len(s) for s in self.stems})
        parts = [f"{re.escape(w)}(?![^\\W\\d_])" for w in self.words] + [re.escape(s) for s in self.stems] + [f"{w}(?![^\\W\\d_])" for w in THREATS]
        self.any = re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(parts)) + ")") if parts else None

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        return max([found, *(self.stems.get(word[:n], 0.0) for n in self.sizes if len(word) >= n)])

    def tagged(self, tokens: list[str]) -> list[tuple[float, str, str]]:
        """(insult weight, symbol, marks) of the insults and threats of a clause."""
        weights = [self.insult(w) for w in tokens]
        symbols = [(BOTH if w in THREATS else INSULT) if x else CLASSES.get(w, OTHER) for w, x in zip(tokens, weights, strict=True)]
        if not any(x in (INSULT, THREAT, BOTH) for x in symbols):
            return []
        return [(w, x, m) for w, x, m in zip(weights, symbols, marked(symbols), strict=True) if x in (INSULT, THREAT, BOTH)]

    def weigh(self, found: list[tuple[float, str, str]]) -> float:
        total, own = 0.0, self.weights
        for weight, symbol, marks in found:
            if symbol != INSULT and "i" in marks and "t" in marks:
                weight += own["threat"]
            for m in "nrt":
                if m in marks:
                    weight *= own[m]
            total += weight
        return total

    def clauses(self, text: str | None) -> list[list[tuple[float, str, str]]]:
        if not text or self.any is None:
            return []
        low = text.lower()
        if not self.any.search(low):
            return []
        return [f for c in CLAUSE.split(low) if self.any.search(c) and (f := self.tagged(WORD.findall(c)))]

    def gather(self, clauses: list[list[tuple[float, str, str]]]) -> float:
        found = sorted(map(self.weigh, clauses), reverse=True)
        return found[0] + 0.25 * sum(found[1:]) if found else 0.0

    def evidence(self, text: str | None) -> float:
        return self.gather(self.clauses(text))

    def score(self, text: str | None) -> float:
        x = self.slope * min(self.evidence(text), 50.0) + self.offset
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def _apart(rows: list[tuple[str, int]]) -> list[tuple[frozenset[str], int]]:
    """Bags of words of rows that are no near copies of an earlier one: five of the eight least word hashes in common."""
    out, seen = [], {}
    for text, y in rows:
        bag = frozenset(WORD.findall((text or "").lower()))
        least = sorted(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in bag)[:8]
        shared = Counter(k for h in least for k in seen.get(h, ()))
        if least and max(shared.values(), default=0) >= min(5, len(least)):
            continue
        for h in least:
            seen.setdefault(h, []).append(len(out))
        out.append((bag, y))
    return out


def learn(rows: list[tuple[str, int]], least: int = 3, sure: int = 8, precision: float = 0.85) -> Grammar:
    """Words, and beginnings of at least three words, that mark toxic rows.

    Those in `sure` toxic rows or more (near copies count once) are taken; then, greedily, those
    that explain `least` or more toxic rows that nothing taken explains.
    """
    bags = _apart(rows)
    if not any(y for _, y in bags) or all(y for _, y in bags):
        return Grammar({w: 2.0 for w in SEED})
    feature = lambda bag: {("w", w) for w in bag} | {("s", w[:n]) for w in bag for n in range(4, 9) if len(w) > n}
    toxic = [b for b, y in bags if y]
    holds: dict[tuple[str, str], set[int]] = {}
    longer: dict[str, set[str]] = {}
    for k, bag in enumerate(toxic):
        for f in feature(bag):
            holds.setdefault(f, set()).add(k)
        for w in bag:
            for n in range(4, 9):
                if len(w) > n:
                    longer.setdefault(w[:n], set()).add(w)
    holds = {f: ks for f, ks in holds.items() if len(ks) >= least and (f[0] == "w" or len(longer[f[1]]) >= 3)}
    against: Counter = Counter()
    for b, y in bags:
        if not y:
            against.update(f for f in feature(b) if f in holds)
    share = len(toxic) / len(bags)
    weight = lambda f: math.log((len(holds[f]) + 0.5) * (1 - share) / ((against[f] + 0.5) * share))
    good = {f for f in holds if len(holds[f]) >= precision * (len(holds[f]) + against[f])}
    chosen = [f for f in good if len(holds[f]) >= sure]
    open_rows = set(range(len(toxic))).difference(*(holds[f] for f in chosen))
    while good := {f for f in good if len(open_rows & holds[f]) >= least}:
        best = max(good, key=lambda f: (len(open_rows & holds[f]) - 4 * against[f], f[0] == "w", len(f[1]), f[1]))
        if len(open_rows & holds[best]) - 4 * against[best] < 1:
            break
        chosen.append(best)
        open_rows -= holds[best]
    g = Grammar({w: weight((k, w)) for k, w in chosen if k == "w"}, {s: weight((k, s)) for k, s in chosen if k == "s"})
    return _weighed(g, [g.clauses(t) for t, _ in rows], np.array([y for _, y in rows], float))


def _weighed(g: Grammar, clauses: list, y: np.ndarray) -> Grammar:
    """g with the factors and the curve of greatest penalised likelihood, found by coordinate steps from the priors."""
    held = [k for k, c in enumerate(clauses) if c]

    def fitted() -> float:
        x = np.zeros(len(y))
        x[held] = [min(g.gather(clauses[k]), 50.0) for k in held]
        g.slope, g.offset = _curve(x, y)
        z = g.slope * x + g.offset
        return float(np.logaddexp(0, z).sum() - y @ z) + sum(4.0 * math.log(g.weights[n] / p) ** 2 for n, p in PRIORS.items())

    best = fitted()
    for size in (1.5, 1.2):
        for name in PRIORS:
            for way in (size, 1 / size):
                while True:
                    before = g.weights[name]
                    g.weights[name] = before * way
                    if (loss := fitted()) < best - 1e-6:
                        best = loss
                        continue
                    g.weights[name] = before
                    break
    fitted()
    return g


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Ridge logistic regression on one feature, by damped Newton steps; the slope isn't negative."""
    z = np.stack([x, np.ones_like(x)], 1)
    ridge = np.array([1.0, 0.01])
    loss = lambda b: np.logaddexp(0, z @ b).sum() - y @ (z @ b) + 0.5 * (ridge * b * b).sum()
    b = np.array([0.5, -1.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * b)
        size = 1.0
        while size > 1e-4 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
    return max(float(b[0]), 0.05), float(b[1])


def fit(docs: DataFrame, labelled: DataFrame, most_rows: int = 6000) -> Grammar:
    """labelled: doc_id, toxic. One row a doc_id and label; the sample is by hash, at most about most_rows."""
    own = labelled.select("doc_id", F.col("toxic").cast("int").alias("label")).dropna().distinct()
    n = own.count()
    share = min(1.0, most_rows / max(1, n))
    own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "label").collect()
    return learn(sorted((r["text"] or "", r["label"]) for r in rows))


def score(docs: DataFrame, labelled: DataFrame, most_rows: int = 6000) -> DataFrame:
    """doc_id, evidence, score (0 to 1) of every row of docs; labelled holds the rows to learn from."""
    grammar = docs.sparkSession.sparkContext.broadcast(fit(docs, labelled, most_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar.value
        for batch in batches:
            found = [g.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
