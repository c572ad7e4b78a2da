import pytest

from termforge.sources import files
from termforge.streaming.scores import running_document_frequency


def test_folders(spark, tmp_path):
    for folder, name, text in (("a", "x_text_cleaned.txt", "\ufeffone\ntwo"), ("b", "y.TXT", "three"), ("b", "z.pdf", "no")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text, encoding="utf-8")
    got = {(r.doc_name, r.label, r.text) for r in files.labelled_folders(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert got == {("x.pdf", 1, "one\ntwo"), ("y.pdf", 0, "three")}
    with pytest.raises(ValueError):
        files.resolve_datasets(["one"])


def test_csv_corpus(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Fillings,Fraud,x\n"a ""b""",Yes ,1\n,no,2\nc,no,3\nd,,4\n')
    got = files.csv_corpus(spark, str(tmp_path / "c.csv"), "Fillings", "Fraud", {"yes": 1, "no": 0}).collect()
    assert {(r.text, r.label) for r in got} == {('a "b"', 1), ("c", 0)}
    (tmp_path / "c.csv").write_text("Fillings,Fraud\na,perhaps\n")
    with pytest.raises(Exception, match="unknown label"):
        files.csv_corpus(spark, str(tmp_path / "c.csv"), "Fillings", "Fraud", {"yes": 1, "no": 0}).collect()


def test_result_tree_and_cache(spark, tmp_path):
    for k in (10, 20):
        folder = tmp_path / f"n{k}/m/tf/rel/linear"
        folder.mkdir(parents=True)
        (folder / "svm_metrics.csv").write_text(f"mean_accuracy,mean_f1\n0.{k},0.5\n0.1,0.1\n")
    got = {(r.feature_count, r.kernel, r.mean_accuracy) for r in files.result_tree(spark, str(tmp_path)).collect()}
    assert got == {("10", "linear", "0.10"), ("20", "linear", "0.20")}
    listing = spark.createDataFrame([("a", 1, 2)], "name string, size long, mtime long")
    assert files.fingerprint(listing, 1) != files.fingerprint(listing, 2)
    built = []
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), "k", lambda: built.append(1) or listing).count() == 1
    assert len(built) == 1


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "alpha beta alpha"), (2, 0, "alpha")], "doc_id long, label int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = running_document_frequency(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("df_now").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.term, r.df, r.df1, r.df0) for r in spark.table("df_now").collect()} == {("alpha", 2, 1, 1), ("beta", 1, 1, 0)}


def test_csv_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 1), ('say "x"', 2)], "term string, n int").orderBy("n")
    files.write_csv(rows, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    raw = part.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    import csv

    with part.open(encoding="utf-8-sig", newline="") as f:
        assert list(csv.reader(f)) == [["term", "n"], ["a,b", "1"], ['say "x"', "2"]]
