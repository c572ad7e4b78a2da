"""Operators 11 to 13: against the tokenizer's own library, SQL and brute force, on the tables and on odd rows."""

import collections
import glob
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pytest
import tiktoken

from termforge.llm import bpe, filter_audit, periodic_runs, queries

SF = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_tokens int, ids string, runs int, part string, mask int"
ODD = [
    (None, "a nameless one", None, 1, "x", 1, "x", 1), (1, None, "en", 1, "x", 1, "x", 1), (2, "", "", 1, "x", 1, "x", 1), (3, " \t\n", None, 1, "x", 1, "x", 1),
    (4, "one", "fr", 1, "x", 1, "x", 1), (5, "é" * 300, "fr", 1, "x", 1, "x", 1), (6, "same row twice " * 20, "en", 1, "x", 1, "x", 1), (6, "same row twice " * 20, "en", 1, "x", 1, "x", 1),
    (7, "long " * 30_000, "en", 1, "x", 1, "x", 1), (8, "7" * 40_000 + "ab" * 30_000, "en", 1, "x", 1, "x", 1), (9, "one", "fr", 1, "x", 1, "x", 1), (None, "one", "fr", 1, "x", 1, "x", 1),
]


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] or "" for r in ds.dataset(f"{MIDDLE}/documents.parquet").to_table().to_pylist()}


@pytest.fixture(scope="module")
def library():
    v = bpe.vocabulary(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    return v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.rank, special_tokens={})


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_op11_bpe(spark, docs, library):
    rows = queries.QUERIES["op11_bpe"](spark, MIDDLE).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(library[1].encode_ordinary(docs[r.doc_id]), "<u4")
        assert tuple(r) == (r.doc_id, len(ids), digest(ids.tobytes()), digest(docs[r.doc_id].encode()))


def test_bpe_odd_rows(spark, library):
    ranks = bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    run = lambda rows: bpe.decode(bpe.encode(spark.createDataFrame(rows, SCHEMA), ranks, public_tokenizers.PATTERN, "doc_id", "lang"), ranks)
    got = run(ODD).collect()
    want = [(r[0], r[2], np.array(library[1].encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in ODD]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(r.doc_id, r.lang, bytes(r.ids), bytes(r.decoded)) for r in got], key=key) == sorted(want, key=key)
    assert run([]).count() == 0


def test_bpe_bytes_and_strange_texts(library):
    v, own = library
    rng = random.Random(2)
    texts = ["  \n\n \t x", "　\x85\x1c a​", "日本語テキスト" * 200, "🙂👩‍👩‍👧" * 100, "don't I'll we've 'S"] + ["".join(chr(rng.randrange(32, 0xD800) if rng.random() < 0.3 else rng.randrange(97, 110)) for _ in range(rng.randrange(400))) for _ in range(200)]
    encoder = bpe.Encoder(v, public_tokenizers.PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])] == [own.encode_ordinary(t) for t in texts]
    raw = b"caf\xe9 \xff\xfe " + rng.randbytes(500)  # no UTF-8
    assert b"".join(v.token[i] for i in np.frombuffer(encoder.encode([raw])[0], "<u4").tolist()) == raw
    with pytest.raises(ValueError, match="single byte"):
        bpe.Vocabulary(b"YQ== 0\n")


@pytest.mark.parametrize("width", [2, 4, 8, 16, 128])
def test_bpe_trees_against_the_plain_rule(library, width):
    """Again and again the leftmost of the pairs with the least rank."""
    v, rng = library[0], random.Random(width)
    pieces = [bytes(rng.choice(b"etaoin shr") for _ in range(rng.randint(2, width))) for _ in range(200)]

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            ranks = [(v.rank[a + b], k) for k, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in v.rank]
            if not ranks:
                return [v.rank[p] for p in parts]
            k = min(ranks)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    want = [plain(p) for p in pieces]
    assert [bpe.merge_one(p, v).tolist() for p in pieces] == want
    ids, sizes = bpe.merge_many(pieces, width, v)
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_bpe_memory_of_pieces_changes_nothing(library, monkeypatch):
    v, own = library
    monkeypatch.setattr(bpe, "MEMO", 3)
    monkeypatch.setattr(bpe, "AT_ONCE", 5)
    texts = ["one two three four five six seven " * 4, "x" * 500 + " two " + "x" * 500] * 3
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(v, public_tokenizers.PATTERN).encode([t.encode() for t in texts])] == [own.encode_ordinary(t) for t in texts]


def test_op12_filter_audit(spark):
    db = duckdb.connect()
    for f in glob.glob(f"{MIDDLE}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    want = db.execute(queries.ORACLE_SQL["op12_filter_audit"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op12_filter_audit"](spark, MIDDLE)
    assert sorted(got.columns) == sorted(names)
    rows = got.collect()
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(want.fetchall()) and any(r.redundant for r in rows) and any(r.good_lost for r in rows)


def plain_audit(rows, marks):
    """Every order, filter by filter over the rows themselves."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))

    def fails(i, text):
        text = text or ""
        w = WORDS.findall(text)
        return (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > least[text])

    parts = collections.defaultdict(list)
    for i, text, lang in rows:
        parts[lang or ""].append((fails(i, text), marks.get(i, False)))
    out, total = [], collections.Counter()
    for part, own in parts.items():
        for order in itertools.permutations(range(5)):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                total[part, f] += len(gone)
                out.append((part, "".join("ABCDE"[k] for k in order), step, len(left), len(gone), sum(x[0][f] for x in own) - len(gone), sum(sum(x[0]) == 1 and x[0][f] for x in own), sum(x[1] for x in gone), f))
    return sorted((*r[:-1], total[r[0], r[-1]]) for r in out)


def test_filter_audit_odd_rows(spark):
    marks = [(6, True), (6, False), (4, None), (9, True), (None, True), (77, True)]
    found = filter_audit.audit(spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame(marks, "doc_id long, good boolean"))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == plain_audit([r[:3] for r in ODD], {6: True, 9: True})
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    assert "good_lost" not in filter_audit.audit(spark.createDataFrame(ODD, SCHEMA)).columns


def plain_runs(s, least=12):
    """Every period's maximal stretches, and whether none smaller does."""
    out = []
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, 2 * q):
                w = s[i : j + q]
                if not any(w[r:] == w[: n - r] for r in range(1, q)):
                    out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_op13_periodic_runs(spark, docs):
    rows = queries.QUERIES["op13_periodic_runs"](spark, MIDDLE).collect()
    assert len(rows) == len(docs)
    planted = some = 0
    for r in rows:
        w = WORDS.findall(docs[r.doc_id])
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 1500 and h % 10 != 0:
            continue  # the plain rule is quadratic
        found = plain_runs(w)
        some += bool(found)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2])) if found else (None, None, None)
        said = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        milli = 1000 * best[1] // best[2] if found else None
        assert tuple(r) == (r.doc_id, len(found), *best, milli, digest(said.encode()), digest(plain_collapse(w, found).encode()))
    assert planted > 50 and some > 60


def test_runs_against_the_plain_rule():
    rng = random.Random(1)
    seen = 0
    for turn in range(1500):
        letters = rng.choice([1, 2, 2, 3, 5, 20])
        s = [rng.randrange(letters) for _ in range(rng.randint(0, 90))]
        if turn % 3 == 0 and len(s) > 20:
            a, p = rng.randrange(len(s) // 2), rng.randint(1, 15)
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(len(s))]
            s[rng.randrange(len(s))] = 7
        want = plain_runs(s)
        assert periodic_runs.runs(np.array(s, np.uint64)) == want
        seen += len(want)
    assert seen > 500
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert periodic_runs.runs(np.array(b, np.uint64)) == plain_runs(b)  # a word of many runs
    for n in (30_000, 30_007):
        assert periodic_runs.runs(np.arange(n, dtype=np.uint64) % 7) == [(0, n, 7)]


def test_stretches_lose_no_run():
    rng = random.Random(5)
    for _ in range(300):
        s = np.array([rng.randrange(30) for _ in range(200)], np.uint64)
        a, q, n = rng.randrange(100), rng.randint(1, 20), rng.randint(12, 60)
        s[a : a + n] = np.resize(s[a : a + q], n)
        held = periodic_runs.stretches(s)
        assert all(any(x <= start and start + size <= y for x, y in held) for start, size, _ in plain_runs(s.tolist()))


def test_places_are_ordered(monkeypatch):
    monkeypatch.setattr(periodic_runs.Places, "MOST", 4)
    rng = random.Random(3)
    xs = rng.sample(range(1000), 300)
    own, held = periodic_runs.Places(xs[0]), [xs[0]]
    for x in xs[1:]:
        got = own.add(x)
        assert got == (max((y for y in held if y < x), default=-1), min((y for y in held if y > x), default=-1))
        held.append(x)
    assert list(own) == sorted(xs) and own.size == 300


def test_runs_odd_rows(spark):
    got = periodic_runs.detect(spark.createDataFrame(ODD, SCHEMA), "doc_id", "lang").collect()
    assert collections.Counter((r.doc_id, r.n_words, len(r.runs)) for r in got) == collections.Counter(
        (r[0], len(w := WORDS.findall(r[1] or "")), len(plain_runs(w)) if len(w) < 1000 else 1) for r in ODD
    )
    (seven,) = [r for r in got if r.doc_id == 7]
    assert tuple(seven.runs[0]) == (0, 30_000, 1) and bytes(seven.collapsed) == b"long"
    assert {bytes(r.collapsed) for r in got if r.doc_id == 6} == {b"same row twice"}
    assert periodic_runs.detect(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planting_leaves_null_keys_and_wordless_texts(spark):
    from pyspark.sql import functions as F

    tenth = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = [(None, "a b c"), (tenth[0], None), (tenth[1], " \t"), (tenth[2], "one")]
    got = [r[0] for r in spark.createDataFrame(rows, "doc_id long, text string").select(periodic_runs.planted(F.col("text"), F.col("doc_id"))).collect()]
    assert got == ["a b c", None, " \t", "one"]
