"""The ten operators on small fixtures: brute force, odd inputs, planted cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termforge.llm import decontaminate, lm_score, mixing, near_dup, passage_chain, pii, quality_rules, sharding, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, source string, n_chars long, rank int, word string"
ODD = [(None, "a nameless document here", None, None, 1, "x"), (1, None, "s", 0, 1, "x"), (2, "", "s", 0, 1, "x"), (3, " \t\n", "s", 3, 1, "x"), (4, "one", "s", 3, 1, "x"), (5, "é" * 300, "s", 300, 1, "x"), (6, "same row twice " * 20, "s", 1, 1, "x"), (6, "same row twice " * 20, "s", 1, 1, "x"), (7, "long " * 30_000, "s", 1, 1, "x")]


def vocabulary(n=400, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=1, n=40):
    rng, words = random.Random(seed), vocabulary()
    texts = [prose(rng, words, rng.randint(60, 200)) for _ in range(n)]
    texts[5] = texts[2]
    edited = texts[3].split()
    for k in range(10, len(edited), 60):
        edited[k] = "changed"
    texts[9] = " ".join(edited)
    shared = prose(rng, words, 70)
    for k in (11, 17, 23):
        texts[k] = f"{texts[k]}\n{shared} {texts[k][:50]}"
    return [(i, t, "s", len(t), 1, "x") for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_quality(spark):
    rows = corpus() + [(100, "spam!! " * 80, "s", 0, 1, "x"), (101, "### $$$ word " * 60, "s", 0, 1, "x")]
    got = {r.doc_id: r for r in quality_rules.quality(frame(spark, rows)).collect()}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                covered |= {k, k + 1, k + 2}
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(w), len(covered), sum(map(len, w)))
    assert got[0].kept and not got[100].kept and not got[101].kept
    assert {r.doc_id for r in quality_rules.keep_good(frame(spark, rows)).collect()} == {i for i, r in got.items() if r.kept}


@pytest.mark.parametrize("run", [
    lambda d, s: quality_rules.quality(d), lambda d, s: lm_score.score(d, F.col("doc_id") > 3), lambda d, s: suffix_dedup.dedup(d), lambda d, s: decontaminate.matches(d, s.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")),
    lambda d, s: near_dup.classes(d), lambda d, s: sharding.assign(d), lambda d, s: toxicity.score(d, s.createDataFrame([(1, 1), (5, 0), (None, 1)], "doc_id long, toxic int")), lambda d, s: pii.find(d, True),
    lambda d, s: mixing.mix(d, s.createDataFrame([(1, 1), (5, 0)], "doc_id long, domain int"), [0.5, 0.5]),
], ids=["quality", "lm", "suffix", "decontaminate", "near", "shard", "toxicity", "pii", "mix"])
def test_odd_rows_and_empty_tables(spark, run, request):
    """A row for each row, nulls and all; rows alike get the same result; rows without words share theirs."""
    found = [r.asDict() for r in run(frame(spark, ODD), spark).collect()]
    ids = collections.Counter(r["doc_id"] for r in found)
    if "mix" in request.node.name:  # rates decide about copies, but rows alike stay alike and wordless ones stay once
        assert ids[1] == ids[2] == ids[3] == 1 and ids[6] % 2 == 0 and set(ids) <= {r[0] for r in ODD}
    else:
        assert ids == collections.Counter(r[0] for r in ODD)
    by = collections.defaultdict(list)
    for r in found:
        by[r["doc_id"]].append({k: v for k, v in r.items() if k not in ("doc_id", "class_id", "shard", "text", "clean", "n_chars", "source")})
    assert all(x == by[6][0] for x in by[6])
    assert by[1] == by[2] or "mix" in request.node.name
    if "near" in request.node.name:
        assert {(r["doc_id"], r["class_id"]) for r in found} == {(r[0], r[0]) for r in ODD}
    if "shard" in request.node.name:
        assert len({r["shard"] for r in found if r["doc_id"] == 6}) == 1 and found[0].keys() == {*SCHEMA.replace(",", "").split()[::2], "shard"}
    assert run(frame(spark, []), spark).count() == 0


def test_passages_odd_rows(spark):
    found = passage_chain.passages(frame(spark, ODD)).collect()
    assert all(r.doc_id != r.source_id for r in found)
    assert passage_chain.passages(frame(spark, [])).count() == 0


def test_lm_score(spark):
    rows = corpus()
    got = {r.doc_id: r for r in lm_score.score(frame(spark, rows), toxicity.remainder(F.col("doc_id"), 7) != 2).collect()}
    seq = {i: ["<"] + t.lower().split() + [">"] for i, t, *_ in rows}
    train = [i for i in seq if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = collections.Counter(), collections.Counter()
    for i in train:
        one.update(seq[i][1:])
        two.update(zip(seq[i], seq[i][1:]))
    n, v, m = sum(one.values()), len(one), lm_score.PRIOR
    for i, s in seq.items():
        base = want = 0.0
        for a, b in zip(s, s[1:]):
            p = (one[b] + 1) / (n + v + 1)
            base += math.log10(p)
            want += math.log10((two[a, b] + m * p) / ((len(train) if a == "<" else one[a]) + m))
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(want)
        assert (got[i].train_tokens, got[i].n_tokens, got[i].held_out) == (n, len(s) - 1, i not in train)


def test_lm_automaton_of_order_three():
    """The walk over states and failure arcs gives the recursive probabilities, unknown histories included."""
    rng, words = random.Random(12), vocabulary(25, 3)
    texts = [prose(rng, words, rng.randint(0, 30)) for _ in range(40)] + ["never seen words", "", f"{words[0]} never {words[1]}"]
    train = range(30)
    seqs = [["<", *t.split(), ">"] for t in texts]
    count = [collections.Counter(tuple(seqs[i][k - n + 1 : k + 1]) for i in train for k in range(max(1, n - 1), len(seqs[i]))) for n in (1, 2, 3)]
    total, known, m = sum(count[0].values()), len(count[0]), 7.0

    def p(history, word):
        if not history:
            return (count[0][(word,)] + 1) / (total + known + 1)
        follows = len(train) if history == ("<",) else count[len(history) - 1][history]
        return (count[len(history)][(*history, word)] + m * p(history[1:], word)) / (follows + m)

    sequence, at = lm_score.sequences(pa.chunked_array([pa.array(texts)]))
    names = {}
    for s, a in zip(seqs, at[:-1]):
        names.update(zip(sequence[a : a + len(s)].tolist(), s))
    own = []
    for n in (1, 2, 3):
        hashes, ends = lm_score.grams(sequence, at, n)
        _, first = np.unique(hashes, return_index=True)
        own.append(np.array([count[n - 1][tuple(names[int(x)] for x in sequence[e - n + 1 : e + 1])] for e in ends[first]]))
    score, base, seen = lm_score.traverse(sequence, at, own, total, known, m)
    machine, word_at, _ = lm_score.build(sequence, at, own, total, known, m)
    for few in (0, 5):  # all side by side to the end, and the longest five one by one
        assert machine.walk(word_at, at[:-1] + 1, np.diff(at) - 1, few) == pytest.approx(score)
    for k, s in enumerate(seqs):
        assert score[k] == pytest.approx(sum(math.log10(p(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(1, len(s))))
        assert base[k] == pytest.approx(sum(math.log10(p((), w)) for w in s[1:])) and seen[k] == sum(count[0][(w,)] > 0 for w in s[1:])


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(60):
        t = np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 90))], np.int64)
        t = np.concatenate((t, t[: len(t) // 2]))
        for depth in (9, 10**6):
            order, _ = suffix_dedup.suffix_order(t, depth)
            keys = [tuple(t[i : i + depth]) for i in order]
            assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(t)))


@pytest.mark.parametrize("limit", [512 << 10, 300])
def test_suffix_dedup(spark, limit, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", limit)
    got = {r.doc_id: r for r in suffix_dedup.dedup(frame(spark, rows)).collect()}
    seen = set()
    for i, text, *_ in rows:
        b, gone = text.encode(), set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone |= set(range(k, k + 100))
            seen.add(b[k : k + 100])
        assert got[i].n_removed == len(gone)
    assert got[5].n_removed == got[5].n_bytes and got[0].n_removed == 0


def test_suffix_automaton_against_windows():
    rng = random.Random(4)
    for _ in range(40):
        items = [(str(k), [bytes([97 + rng.randint(0, 2)]) for _ in range(rng.randint(0, 14))]) for k in range(5)]
        model, text = decontaminate.Automaton(items, 5), [bytes([97 + rng.randint(0, 3)]) for _ in range(60)]
        runs, found = [], set()
        model.scan(text, runs, found)
        hit, want = set(), set()
        for name, ws in items:
            n = min(5, len(ws))
            for k in range(len(ws) - n + 1 if n else 0):
                for j in range(len(text) - n + 1):
                    if text[j : j + n] == ws[k : k + n]:
                        hit |= set(range(j, j + n))
                        want.add(name)
        assert {x for a, b in runs for x in range(a, b)} == hit and found == want


def test_decontaminate_cuts(spark):
    words = vocabulary()
    item, clean = " ".join(words[:15]), " ".join(words[100:160])
    docs = frame(spark, [(1, f"{clean} {item} end", "s", 9, 1, "x"), (2, item, "s", 9, 1, "x"), (3, clean, "s", 9, 1, "x")])
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3} and got[3].text == clean and got[3].n_chars == 9
    assert item not in got[1].text and clean in got[1].text and got[1].n_chars == len(got[1].text)


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    names = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(0, 5, 300), rng.integers(0, 5, 300)
    docs = np.repeat([0, 1], 300)
    weights, elements = np.concatenate((a, b)), np.concatenate((names, names))
    own = weights > 0
    s = near_dup.signatures(2, docs[own], elements[own], weights[own], 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_near_dup(spark):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in near_dup.classes(frame(spark, rows)).collect()}
    bag = {i: collections.Counter(zip(*[t.split()[k:] for k in range(5)])) for i, t, *_ in rows}
    name = {i: i for i in bag}
    for i in bag:
        for j in range(i):
            shared = sum((bag[i] & bag[j]).values())
            if shared >= 0.8 * sum((bag[i] | bag[j]).values()):
                name[i] = min(name[i], name[j])
    assert got == name and got[5] == 2 and got[9] == 3
    assert {r.doc_id for r in near_dup.keep_one(frame(spark, rows)).collect()} == set(name.values())


def test_near_dup_bridges(spark):
    """L leads and takes A; B is close to A but to no other: the link A~B of two members counts."""
    rng, words = random.Random(31), vocabulary(3000, 9)
    rows = []
    for group in range(8):
        base = [rng.choice(words) for _ in range(400)]
        for who, places in enumerate([[], [3, 10], [3, 10, *range(43, 203, 20)], *[[k, k + 90] for k in range(210, 234, 6)]]):
            own = list(base)
            for k in places:
                own[k] = f"edit{group}x{k}"
            rows.append((group * 20 + who, " ".join(own), "s", 0, 1, "x"))
    docs, hashes, counts = near_dup.shingles(pa.array([r[1] for r in rows]))
    keys = near_dup.band_keys(near_dup.signatures(len(rows), docs, hashes, counts))
    bags = [dict(zip(hashes[docs == k].tolist(), counts[docs == k].tolist())) for k in range(len(rows))]
    close = lambda a, b: sum(min(n, b.get(h, 0)) for h, n in a.items()) >= 0.8 * sum(max(a.get(h, 0), b.get(h, 0)) for h in a.keys() | b.keys())
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (keys[i] == keys[j]).any() and close(bags[i], bags[j]):
                a, b = sorted((name[i], name[j]))
                name = [a if n == b else n for n in name]
    got = {r.doc_id: r.class_id for r in near_dup.classes(frame(spark, rows)).collect()}
    assert got == {rows[k][0]: rows[name[k]][0] for k in range(len(rows))}


def test_passages(spark):
    got = passage_chain.passages(frame(spark, corpus())).collect()
    pairs = {(r.doc_id, r.source_id) for r in got}
    assert {(17, 11), (23, 11), (23, 17), (5, 2), (9, 3)} == pairs
    assert all(r.stop - r.start >= passage_chain.LEAST for r in got)


def test_chain_is_collinear():
    rng = random.Random(6)
    points = [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(60)]
    for own in passage_chain.chain(points):
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(own, own[1:]))


def test_sharding(spark):
    names = [f"n{k}" for k in range(10)]
    owner = sharding.table(names, 1009)
    sizes = collections.Counter(owner)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 9)
    assert moved < 0.25 * 1009
    got = sharding.assign(frame(spark, corpus()), shards=names, slots=1009).collect()
    import hashlib

    for r in got:
        assert r.shard == owner[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:12], 16) % 1009]


def test_mixing_reaches_targets(spark):
    rows = [{"tokens": 10 + i % 7, "p": [0.9, 0.1] if i % 3 else [0.2, 0.8]} for i in range(200)]
    known = spark.createDataFrame(rows, "tokens long, p array<double>")
    rated = known.withColumn("rate", mixing.fit_rates(known, [0.6, 0.4])).toPandas()
    got = np.stack(rated.p).T @ (rated.rate * rated.tokens).to_numpy() / rated.tokens.sum()
    assert got == pytest.approx([0.6, 0.4], abs=5e-3) and (rated.rate >= 0).all()


def test_mixing_reaches_rare_domains_and_bounds(spark):
    """A target of ten times a domain's share is met without a bound; with one, rates keep to it."""
    rows = [{"tokens": 10 + i % 7, "p": [0.02, 0.98] if i % 50 else [0.9, 0.1]} for i in range(1000)]
    known = spark.createDataFrame(rows, "tokens long, p array<double>")
    share = lambda r: float((r.rate * r.tokens * r.p.str[0]).sum() / r.tokens.sum())
    free = known.withColumn("rate", mixing.fit_rates(known, [0.35, 0.65])).toPandas()
    assert share(free) == pytest.approx(0.35, abs=0.01) and free.rate.min() >= 0 and free.rate.max() > 2
    held = known.withColumn("rate", mixing.fit_rates(known, [0.35, 0.65], most=2.0)).toPandas()
    assert held.rate.max() <= 2.0 and share(known.withColumn("rate", F.lit(1.0)).toPandas()) < share(held) < 0.35


def test_toxicity_learns_words_and_stems():
    rng, words = random.Random(7), [w for w in vocabulary(300) if len(w) > 2]
    rows = [(prose(rng, words, 60) + (f" you {rng.choice(['blorg', 'zzunta', 'zzunte', 'zzunto', 'zzuntu'])}. bye" if k % 5 == 0 else " you friend. bye"), int(k % 5 == 0)) for k in range(300)]
    g = toxicity.learn(rows)
    assert g.score("such a blorg") > 0.5 > 0.3 > g.score("such a nice day") and g.score("a zzuntx here") > 0.3
    assert g.evidence("he said not a blorg") < g.evidence("you blorg")
    assert 0 <= g.score("") < 0.3 and g.score(None) == g.score("")


def test_pii(spark):
    texts = ["mail a.b@c.org now", "x@y no dot, 1.2.3.256 and 10.0.0.1", "card 4111 1111 1111 1111 or 4111111111111112", "+44 (20) 7946-0958!", "ünï a@b.cd"]
    got = [pii.base_spans(t) for t in texts]
    assert got == [[("email", 5, 14)], [("ip", 26, 34)], [("card", 5, 24)], [("phone", 0, 18)], [("email", 4, 10)]]
    assert pii.replaced(texts[0], got[0]) == "mail [EMAIL] now"
    rows = [(i, f"note {i} {w}: the nickname quizzle wrote to q@z.org from {w}", "s", 1, 1, "x") for i, w in enumerate(vocabulary(30))] + [(1000 + i, f"plain text about things {w}", "s", 1, 1, "x") for i, w in enumerate(vocabulary(3000, 9))]
    clean = {r.doc_id: r.clean for r in pii.find(frame(spark, rows), True).collect()}
    assert "quizzle" not in clean[0] and "[TERM]" in clean[0] and clean[1001] == rows[31][1]


def test_pii_terms_inside_copies(spark):
    """One of a term's contexts stands in a large group of copies: it reveals the entity as before."""
    texts = [f"note {w}: the nickname quizzle wrote to q@z.org from {w}" for w in vocabulary(4)] + [f"plain text about things {k} {w}" for k, w in enumerate(vocabulary(600, 9))]
    rows = [(i, t, "s", 1, 1, "x") for i, t in enumerate(texts)]
    copies = [(10_000 + k, texts[0], "s", 1, 1, "x") for k in range(300)]
    found = lambda rows: {tuple(r) for r in pii.revealing_terms(frame(spark, rows)).collect()}
    assert ("quizzle", pii.entity("email", "q@z.org")) in found(rows + copies)
    assert found(rows + copies) == found(rows)


def test_hash_ranges_are_words():
    from termforge.llm import _bytes as B

    words, first = B.word_hashes(pa.array(["a b", None, "", "b\ta A"]))
    assert np.diff(first).tolist() == [2, 0, 0, 3]
    assert words[0] == words[3] == words[4] and words[1] == words[2]
