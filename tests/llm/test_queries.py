"""The registered queries on the smallest tables, each against a plain brute force (or its SQL)."""

import collections
import glob
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from termforge.llm import mixing, near_dup, passage_chain, pii, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(name, sf=SF):
    return ds.dataset(f"{sf}/{name}.parquet").to_table().to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] or "" for r in table("documents")}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def result(spark, name, sf=SF):
    rows = queries.QUERIES[name](spark, sf).collect()
    return {r.doc_id: r for r in rows}, rows


def test_op1_quality_rules(spark):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    want = db.execute(queries.ORACLE_SQL["op1_quality_rules"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op1_quality_rules"](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_op2_lm_score(spark, docs):
    got, rows = result(spark, "op2_lm_score")
    toks = {i: [*WORDS.findall(lower(t)), None] for i, t in docs.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    count = collections.Counter(w for i, ws in toks.items() if not out[i] for w in ws)
    n, v = sum(count.values()), len(count)
    assert len(rows) == len(docs)
    for i, ws in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
    held = [got[i] for i in docs if out[i]]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the history helps on unseen texts


def test_op3_suffix_dedup(spark, docs):
    got, rows = result(spark, "op3_suffix_dedup")
    seen, touched = set(), 0
    for i in sorted(docs):
        b = docs[i].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        touched += spans > 0
        assert tuple(got[i]) == (i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert len(rows) == len(docs) and touched > 10


def windows(words, size=10):
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def contaminated(docs, items):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    held = collections.defaultdict(set)
    for r in items:
        for w in windows(cut.findall(lower(r["text"] or ""))):
            held[w].add(str(r["item_id"]))
    sizes = sorted({len(w) for w in held})
    for i, t in docs.items():
        words, hit, found = cut.findall(lower(t)), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                own = held.get(tuple(words[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        yield i, words, hit, found


def test_op4_decontaminate(spark, docs):
    got, rows = result(spark, "op4_decontaminate")
    some = 0
    for i, words, hit, found in contaminated(docs, table("benchmark")):
        some += bool(hit)
        assert tuple(got[i]) == (i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    assert len(rows) == len(docs) and some


def bags(docs):
    out = {}
    for i, t in docs.items():
        w = WORDS.findall(lower(t))
        out[i] = collections.Counter(zip(*[w[k:] for k in range(min(5, len(w)))])) if w else collections.Counter()
    return out


def close(a, b, t=0.8):
    least, most = sorted((a.total(), b.total()))
    if least < t * most:
        return False
    shared = (a & b).total()
    return shared > 0 and shared >= t * (least + most - shared) - 1e-9


def brute_classes(docs):
    own, name = bags(docs), {i: i for i in docs}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if root(i) != root(j) and own[i] and close(own[i], own[j]):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return {i: root(i) for i in docs}


def test_op5_near_dup(spark, docs):
    got, rows = result(spark, "op5_near_dup")
    want = brute_classes(docs)
    assert len(rows) == len(docs) and len(set(want.values())) < len(want)
    assert {i: r.class_id for i, r in got.items()} == want


def planted_passages(spacing, size=60, shift=11):
    """(rows, planted): pairs of the tables' own long English texts, the second with a passage of the first in it, every
    spacing-th word of it changed."""
    rows = table("documents", MIDDLE)
    long = [w for w in (r["text"].split() for r in rows if r["text"] and r["lang"] == "en") if len(w) > 300][:80]
    edited, planted, base = [], [], 10_000
    for k in range(0, len(long) - 1, 2):
        passage = long[k][100 : 100 + size]
        other = [f"edit{k}x{n}" if n % spacing == shift % spacing else w for n, w in enumerate(passage)]
        edited.append((base + k, " ".join(long[k])))
        edited.append((base + k + 1, " ".join(long[k + 1][:80] + other + long[k + 1][80:])))
        planted.append((base + k + 1, base + k))
    return edited, planted


def recall_of(spark, edited, planted, size=60):
    found = passage_chain.passages(spark.createDataFrame(edited, "doc_id long, text string")).collect()
    inside = collections.Counter()  # words of the planted range in a passage; another copy of the source may be named
    for r in found:
        inside[r.doc_id] = max(inside[r.doc_id], min(r.stop, 80 + size) - max(r.start, 80))
    return sum(inside[i] >= 40 for i, _ in planted) / len(planted)


@pytest.mark.parametrize(("spacing", "size", "least"), [(20, 60, 0.95), (16, 60, 0.95), (14, 60, 0.95), (12, 60, 0.95), (10, 60, 0.95), (8, 60, 0.9), (7, 60, 0.9), (7, 120, 0.95), (6, 120, 0.8)])
def test_op6_passages(spark, spacing, size, least):
    """Passages planted with edits in every spacing-th word, in the tables' own texts: 40 words of them are found."""
    edited, planted = planted_passages(spacing, size)
    caught = recall_of(spark, edited, planted, size)
    print("recall of planted passages", spacing, size, caught)
    assert len(planted) >= 30 and caught >= least


def test_passage_in_sixty_edited_copies(spark):
    """One passage and 59 copies of it, each with other edits in every ninth word: each is found with some other."""
    rows = [r["text"].split() for r in table("documents", MIDDLE) if r["text"] and r["lang"] == "en"]
    long = [w for w in rows if len(w) > 300][:60]
    passage = long[0][100:160]
    texts = [(k, " ".join(w[:50] + [f"edit{k}x{n}" if k and n % 9 == k % 9 else x for n, x in enumerate(passage)] + w[200:])) for k, w in enumerate(long)]
    found = passage_chain.passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    inside = {i for r in found for i, a, b in ((r.doc_id, r.start, r.stop), (r.source_id, r.source_start, r.source_stop)) if min(b, 110) - max(a, 50) >= 40}
    assert len(inside) >= 0.95 * len(texts)


def test_op6_query_rows_are_passages(spark, docs):
    _, rows = result(spark, "op6_passages")
    assert rows
    for r in rows:
        assert r.source_id < r.doc_id and r.identity >= passage_chain.IDENTITY
        a, b = (WORDS.findall(lower(docs[i])) for i in (r.source_id, r.doc_id))
        a, b = a[r.source_start : r.source_stop], b[r.start : r.stop]
        assert min(len(a), len(b)) >= passage_chain.LEAST
        steps = list(range(len(b) + 1))
        for n, x in enumerate(a, 1):
            before, steps = steps, [n]
            for m, y in enumerate(b, 1):
                steps.append(min(before[m] + 1, steps[-1] + 1, before[m - 1] + (x != y)))
        assert 1 - steps[-1] / max(len(a), len(b)) >= r.identity - 1e-9


def test_op7_sharding(spark, docs):
    got, rows = result(spark, "op7_sharding")
    names, slots = [f"shard-{k:05d}" for k in range(sharding.SHARDS)], sharding.SLOTS
    order = []
    for n in names:  # every shard's whole preference list, then turns
        d = hashlib.md5(n.encode()).digest()
        at, step = int.from_bytes(d[:8], "big") % slots, 1 + int.from_bytes(d[8:], "big") % (slots - 1)
        order.append(iter([(at + step * k) % slots for k in range(slots)]))
    owner, left = {}, slots
    while left:
        for k, mine in enumerate(order):
            if left:
                owner[next(s for s in mine if s not in owner)] = k
                left -= 1
    assert len(rows) == len(docs)
    for i, r in got.items():
        assert r.shard == owner[int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) % slots]


def test_op8_mixing(spark):
    got, rows = result(spark, "op8_mixing", MIDDLE)
    assert len(rows) == len(table("documents", MIDDLE))
    tokens = sum(r.n_tokens for r in rows)
    shares = [sum(r.rate * r.n_tokens * r[f"p{k}"] for r in rows) / tokens for k in range(4)]
    print("reached", shares, "targets", mixing.TARGETS)
    assert shares == pytest.approx(mixing.TARGETS, abs=5e-3)
    for r in rows:
        assert sum(r[f"p{k}"] for k in range(4)) == pytest.approx(1.0) and r.rate >= 0 and r.copies in (math.floor(r.rate), math.ceil(r.rate))
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents", MIDDLE)}
    assert all(r.n_tokens == len(WORDS.findall(texts[i])) for i, r in got.items())


def test_mixing_reaches_the_least(spark):
    """The objective of the query's rates against plain projected gradient run to its end."""
    import numpy as np

    rows = queries.QUERIES["op8_mixing"](spark, MIDDLE).collect()
    n, p, rate = (np.array(x, float) for x in ([r.n_tokens for r in rows], [[r[f"p{k}"] for k in range(4)] for r in rows], [r.rate for r in rows]))
    whiten, goal = mixing.whitening((p * n[:, None]).T @ p), np.array(mixing.TARGETS) / sum(mixing.TARGETS) * n.sum()

    def objective(r):
        gap = (n * r) @ p - goal
        return gap @ whiten @ gap + 0.01 * (n * (r - 1) ** 2).sum()

    plain = np.ones(len(n))
    for _ in range(3000):
        plain = np.maximum(0, (plain - p @ (whiten @ ((n * plain) @ p - goal)) + 0.01) / 1.01)
    assert objective(plain) - 1e-6 <= objective(rate) <= 1.002 * objective(plain)


def test_op9_toxicity(spark):
    got, rows = result(spark, "op9_toxicity", MIDDLE)
    assert len(rows) == len(table("documents", MIDDLE))
    toxic = {r["doc_id"]: r["toxic"] for r in table("labels", MIDDLE)}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(toxic[i], r.predicted) for i, r in got.items() if r.held_out and i in toxic]
    caught = sum(p for y, p in held if y) / sum(y for y, _ in held)
    false = sum(p for y, p in held if not y) / sum(not y for y, _ in held)
    print("held out", len(held), "caught", caught, "false alarms", false)
    assert caught >= 0.6 and false <= 0.05


def plain_toxicity(grammar, text):
    """Clause by clause over word positions, without transducers: what each insult and threat has around it."""
    import re as plain

    total = []
    for clause in plain.split(r"[.!?;:\n]+", text.lower()):
        words = plain.findall(r"[^\W\d_]+", clause)
        insult = [max([grammar.words.get(w, 0.0), *(v for stem, v in grammar.stems.items() if w.startswith(stem))]) for w in words]
        within = lambda k, lists: any(not insult[j] and words[j] in lists for j in range(max(0, k - toxicity.REACH), k))
        anywhere = lambda lists: any(not x and w in lists for w, x in zip(words, insult))
        target, reported = anywhere(toxicity.TARGETS), anywhere(toxicity.REPORTED)
        found, weights = 0.0, grammar.weights
        some = False
        for k, (w, x) in enumerate(zip(words, insult)):
            if x or w in toxicity.THREATS:
                some = True
                x += weights["threat"] * (w in toxicity.THREATS and target and within(k, toxicity.INTENT))
                found += x * (weights["n"] if within(k, toxicity.NEGATIONS) else 1) * (weights["r"] if reported else 1) * (weights["t"] if target else 1)
        if some:
            total.append(found)
    total.sort(reverse=True)
    evidence = total[0] + 0.25 * sum(total[1:]) if total else 0.0
    return 1 / (1 + math.exp(-(grammar.slope * min(evidence, 50.0) + grammar.offset)))


def test_op9_equals_a_plain_clause_scorer(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents", MIDDLE)}
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    grammar = toxicity.fit(docs, labels.filter(toxicity.remainder(F.col("doc_id"), 4) != 2))
    got, _ = result(spark, "op9_toxicity", MIDDLE)
    assert len(grammar.words) + len(grammar.stems) > 3
    assert all(got[i].score == pytest.approx(plain_toxicity(grammar, t), abs=1e-12) for i, t in texts.items())
    assert len({round(r.score, 6) for r in got.values()}) > 10
    g = toxicity.Grammar({"idiot": 2.0, "moron": 1.0}, {"stup": 3.0})
    odd = ["You are not an idiot, said he. I will kill you; they will never hurt", "kill will you stupid idiot not a b c d moron", "idiot", "", "will you not beat them\nsaid who: stupidity", "İDIOT idiot's kill1 you"]
    assert all(g.score(t) == pytest.approx(plain_toxicity(g, t), abs=1e-12) for t in odd)


def plain_spans(text):
    """The contract's patterns by re.finditer."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        return total % 10 == 0

    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, *m.span()) for k, p, good in patterns for m in re.finditer(p, text) if good(m.group())]


def test_op10_pii(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents", MIDDLE)}
    got, rows = result(spark, "op10_pii", MIDDLE)
    assert len(rows) == len(texts)
    some = 0
    for i, t in texts.items():
        want = plain_spans(t)
        some += bool(want)
        n = collections.Counter(k for k, _, _ in want)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(said.encode()).hexdigest())
        assert r.spans.startswith(said)
    assert some > 10


def test_pii_patterns_on_odd_strings():
    for t in ["1.2.3.4.5.6.7.8.9", "1.2.3", "001.002.003.0004 ", "1..2.3.4", "a@b@c.de@f.gh", "a.b@c", "@x.y z@-.-", "4-1-1-1 1111 1111 1111 1", "+1 (2) 3-4.5 6 7 8 9 0", "++12345678901 +1", "256.1.1.1.1.1.1.1", "1 2", "٣.1.2.3.4"]:
        assert pii.base_spans(t) == plain_spans(t)
    long = "1.2.3." + "5" * 50_000 + " " + "9" * 50_000 + " " + "+" * 20_000 + "a." * 20_000 + "@" * 20_000
    assert pii.base_spans(long) == []


def test_pii_words_are_the_patterns_matches(docs):
    texts = [*docs.values(), "don't x_y9 ÀÉÎ²m İstanbul a.bcd,efg... \tone\u00a0two ß123abc ΑΣ'Α “Quoted” naïve-ÉTÉ…", ""]
    some = pii.Wanted(frozenset(w for k, w in enumerate(sorted(set().union(*map(pii.words_of, texts)))) if k % 3 == 0 or not w.isascii()))
    for t in texts:
        assert pii.words_of(t) == {m.lower() for m in pii.TERM.findall(t)}
        assert some.held(t) == pii.words_of(t) & some.terms


def test_pii_terms_in_the_tables_own_texts(spark):
    """A name stands with one address in six documents and without it in a seventh: all seven name it, no other word does."""
    rows = [(r["doc_id"], r["text"] or "") for r in table("documents", MIDDLE)]
    chosen = [i for i, t in rows if len(t.split()) > 40 and not plain_spans(t)][:7]
    texts = [(i, f"{t} Quibbleton {'quib@zorro.example.com' if i != chosen[6] else ''}") if i in chosen else (i, t) for i, t in rows]
    found = pii.find(spark.createDataFrame(texts, "doc_id long, text string"), True).collect()
    by, of = {r.doc_id: r for r in found}, dict(texts)
    for i in chosen:
        terms = {of[i][a:b] for k, a, b in zip(by[i].kinds, by[i].starts, by[i].ends) if k == "term"}
        assert terms == {"Quibbleton"} and "Quibbleton" not in by[i].clean and "[TERM]" in by[i].clean
    assert not [r for r in found if r.doc_id not in chosen and "term" in r.kinds]


def test_every_query_reads_an_odd_table(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns through the registered queries: a row each."""
    odd = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "é" * 300), (6, "same row twice " * 20), (6, "same row twice " * 20), (7, "long " * 30_000), (8, "mail me at a@b.cd you idiot"), (None, "a nameless one"), (None, None)]
    rows = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2.0) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long, rank int, word string, score double")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 1), (8, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {n: q(spark, str(tmp_path)).collect() for n, q in queries.QUERIES.items()}
    audit = got.pop("op12_filter_audit")
    assert len(audit) == 600 and {(r.kept, r.removed) for r in audit if r.step == 1 and r.filter_order[0] == "A"} == {(1, len(odd) - 1)}
    for name, found in got.items():
        if name != "op6_passages":
            assert collections.Counter(r.doc_id for r in found) == collections.Counter(i for i, _ in odd), name
    by = {n: {r.doc_id: r for r in found if r.doc_id is not None} for n, found in got.items()}
    assert all(by["op1_quality_rules"][i].n_words == 0 and by["op1_quality_rules"][i].base_failed for i in (1, 2, 3))
    assert [by["op2_lm_score"][i].n_tokens for i in (1, 2, 3, 4, 6, 7)] == [1, 1, 1, 2, 61, 30_001]
    assert [by["op3_suffix_dedup"][i].n_bytes for i in (1, 2, 4, 5)] == [0, 0, 3, 600] and by["op3_suffix_dedup"][7].n_removed == 149_995 + 5 - 5
    assert {i: (r.n_hit, r.n_items) for i, r in by["op4_decontaminate"].items()} == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (1, 1), 5: (0, 0), 6: (0, 0), 7: (0, 0), 8: (0, 0)}
    assert {i: r.class_id for i, r in by["op5_near_dup"].items()} == {i: i for i in range(1, 9)}
    assert {r.rate for r in got["op8_mixing"] if r.n_tokens == 0} == {1.0}
    assert by["op9_toxicity"][1].score == by["op9_toxicity"][2].score
    assert by["op10_pii"][8].n_email == 1 and by["op10_pii"][1].spans == ""
    shards = {r.doc_id: set() for r in got["op7_sharding"]}
    for r in got["op7_sharding"]:
        shards[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_large_group_of_near_copies(spark):
    """Recall of classes in a group of copies with few and many edits, most of them linked by their original alone."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    base = [rng.choice(words) for _ in range(150)]
    second = base[:90] + [rng.choice(words) for _ in range(60)]
    texts = {0: " ".join(base), 1: " ".join(second)}
    for k in range(2, 400):
        own = list(second if k % 3 == 0 else base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 8])):
            own[rng.randrange(150)] = rng.choice(words)
        texts[k] = " ".join(own)
    want = brute_classes(texts)
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    pairs = [(i, want[i]) for i in texts if want[i] != i]
    caught = sum(got[i] == got[j] for i, j in pairs) / len(pairs)
    print("classes", len(set(want.values())), "recall", caught)
    assert caught >= 0.99 and all(want[i] == want[got[i]] for i in texts)  # and nothing is joined that shouldn't be


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    from termforge.llm import decontaminate

    frame, items = spark.createDataFrame([*docs.items(), (None, None)], "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(repr, decontaminate.matches(frame, items).collect()))
    clean = sorted(map(repr, decontaminate.decontaminate(frame, items).collect()))
    monkeypatch.setattr(decontaminate.automata, "__defaults__", (decontaminate.WINDOW, 3000))
    assert decontaminate.automata(items)[0] > 1
    assert sorted(map(repr, decontaminate.matches(frame, items).collect())) == whole
    assert sorted(map(repr, decontaminate.decontaminate(frame, items).collect())) == clean


def test_pii_in_blocks(spark, monkeypatch):
    rows = [(i, f"note {i} about alpha{i % 5}x beta{i % 3}y here with quib{i % 5}z to u{i % 5}@z.org {i * 7919}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(repr, pii.find(frame, True).collect()))
    monkeypatch.setattr(pii, "TERMS_AT_ONCE", 2)
    assert sorted(map(repr, pii.find(frame, True).collect())) == whole and any("term" in r for r in whole)


def test_sharding_wants_a_prime():
    with pytest.raises(ValueError, match="prime"):
        sharding.table(["a", "b"], 65_536)


def test_passages_of_repeated_ids(spark):
    """Rows of one doc_id with different texts are documents of their own."""
    one, two = (" ".join(f"{p}{k}" for k in range(80)) for p in "ab")
    rows = [(1, one), (1, two), (2, f"x {one}"), (3, f"{two} y"), (None, one), (None, two)]
    found = passage_chain.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.source_id)) for r in found} >= {frozenset((1, 2)), frozenset((1, 3)), frozenset((None, 1))}


def test_passages_within_a_document(spark):
    own = " ".join(f"w{k}" for k in range(80))
    rows = spark.createDataFrame([(1, f"{own} between {' '.join(f'z{k}' for k in range(60))} {own}")], "doc_id long, text string")
    assert passage_chain.passages(rows).count() == 0
    (r,) = passage_chain.passages(rows, within=True).collect()
    assert (r.doc_id, r.source_id, r.stop - r.start, r.start - r.source_start) == (1, 1, 80, 141)


def test_passage_shared_beyond_the_first_document(spark):
    """The first documents of a passage's seeds hold half of it each; the two that hold all of it find each other."""
    p = [f"p{k}" for k in range(60)]
    pad = lambda tag: " ".join(f"{tag}{k}" for k in range(30))
    texts = {1: p[:30], 2: p[30:], 3: p, 4: p[:30], 5: p[30:], 6: p}
    rows = [(i, f"{pad(f'h{i}x')} {' '.join(t)} {pad(f't{i}x')}") for i, t in texts.items()]
    found = {(r.doc_id, r.source_id) for r in passage_chain.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (6, 3) in found


def test_alignment_of_the_best_part():
    """A chain whose whole is too different keeps its longest part that isn't."""
    import numpy as np

    a = np.arange(200, dtype=np.uint64)
    b = a.copy()
    b[100:190] = np.arange(1000, 1090)
    xs = [*range(0, 95, 6), 190]
    x, ex, y, ey, same = passage_chain.align(a, b, xs, list(xs), 0.8)
    assert same >= 0.8 and ex - x >= 95 and (x, ex) == (y, ey)


def test_quality_order_is_by_rejection_per_cost(spark):
    from termforge.llm import quality_rules

    rules = quality_rules.BASE + quality_rules.default_rules()
    found = quality_rules.order_rules(spark.read.parquet(f"{SF}/documents.parquet"), rules)
    assert {n for n, _, _ in found} == {n for n, _ in rules}
    cost = {n: c for n, c, _ in found}
    assert cost["repeated_words"] > cost["few_words"]  # the dearest measure, against a size
    assert [r for _, _, r in found][-1] == min(r for _, _, r in found)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality(docs).filter(F.col("kept")).collect()}
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == kept


def test_quality_order_is_the_same_each_time(spark):
    from termforge.llm import quality_rules

    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rules = quality_rules.BASE + quality_rules.default_rules()
    quality_rules.order_rules(docs, rules)  # code is compiled by now
    found = [quality_rules.order_rules(docs, rules) for _ in range(5)]
    assert len({tuple(n for n, _, _ in f) for f in found}) == 1
    assert all(0.7 < c / d < 1.4 for f in found for (_, c, _), (_, d, _) in zip(f, found[0]) if c > 5e-6)
    assert quality_rules.order_rules(docs.limit(0), rules) == sorted((n, 0.0, 0.0) for n, _ in rules)


def test_stretching_many_is_stretching_each():
    import numpy as np

    rng = random.Random(6)
    pairs = []
    for _ in range(300):
        x = [rng.randrange(6) if rng.random() < 0.3 else 100 + k for k in range(rng.randint(0, 70))]
        y = [v for v in x if rng.random() > 0.05]
        for k in range(len(y)):
            if rng.random() < 0.12:
                y[k] = rng.randrange(1000)
        pairs.append((np.array(x, np.uint32), np.array(y, np.uint32)))
    for sign in (1, -1):
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        room = np.array([[len(x), len(y)] for x, y in pairs])
        begin = np.cumsum(room, axis=0) - room
        at = begin if sign == 1 else begin + room - 1
        got = passage_chain._ahead_many(a, b, at, room, sign)
        assert got.tolist() == [list(passage_chain._ahead(x[::sign], y[::sign])) for x, y in pairs]
