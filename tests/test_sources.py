import pytest
from pyspark.sql import functions as F

from lodestone.sources import jsonl as J
from lodestone.sources import tables as S
from lodestone.sources import versions as V


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "q": "x"}\n\n  \n{"id": 1, "q": "y"}\n{broken\n{"id": 2}\n')
    got = [(r.id, r.q, r.malformed, r.repeated) for r in J.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long, q string").orderBy("id", "q").collect()]
    assert got == [(None, None, True, False), (1, "x", False, True), (1, "y", False, True), (2, None, False, False)]


def test_writer_takes_a_free_name(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, q string")
    paths = [J.write_jsonl(rows, str(tmp_path / "out")) for _ in range(3)]
    assert [p.removeprefix(str(tmp_path)) for p in paths] == ["/out", "/out-1", "/out-2"]
    assert J.read_jsonl(spark, paths[2], "id long, q string").first().q == "a"


def test_manifest(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "doc_key string, n long")
    assert J.manifest_rows(rows, None).count() == 2 and [r.n for r in J.manifest_rows(rows, ["b"]).collect()] == [2]
    with pytest.raises(ValueError, match="unknown keys: x, z"):
        J.manifest_rows(rows, ["z", "a", "x"])


def test_stream_lines(spark):
    lines = ["data: {\"k\": 1}", "data:[DONE]", ": ping", "", "data:", "data: x"]
    df = spark.createDataFrame([(x,) for x in lines], "l string").select(J.event_data(F.col("l")))
    assert [r[0] for r in df.collect()] == ['{"k": 1}', None, None, None, None, "x"]


def test_replacement_and_retirement(spark):
    chunks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "doc_key string, n long")
    new = spark.createDataFrame([("a", 9)], "doc_key string, n long")
    assert sorted(tuple(r) for r in S.replaced(chunks, new).collect()) == [("a", 9), ("b", 3)]
    left = S.retired(chunks, new, spark.createDataFrame([("a",)], "doc_key string"))
    assert [d.count() for d in left] == [1, 0]


def test_write_only_if_changed(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = lambda n, stamp: spark.createDataFrame([("a", n, stamp), ("b", 1, stamp)], "doc_key string, n long, at string")
    assert S.write_if_changed(rows(1, "x"), path, ("at",)) and not S.write_if_changed(rows(1, "y"), path, ("at",))
    assert S.write_if_changed(rows(2, "y"), path, ("at",)) and spark.read.parquet(path).where("at = 'y'").count() == 2


def test_runs_are_seen_from_their_commit_on(spark, tmp_path):
    path, schema = str(tmp_path / "chunks"), "doc_key string, n long"
    rows = lambda *xs: spark.createDataFrame(list(xs), schema)
    docs = lambda *xs: spark.createDataFrame(list(xs), "doc_key string, retired boolean, stamp string")
    now = lambda: sorted(tuple(r) for r in V.current_rows(spark, path, schema).collect())
    assert now() == []
    assert V.replace_documents(rows(("a", 1), ("a", 2), ("b", 3)), docs(("a", False, "t1"), ("b", False, "t1")), path, "one")
    assert now() == [("a", 1), ("a", 2), ("b", 3)]
    # killed before its commit: nothing changes, and the same run can be done again
    V.write_run(rows(("a", 8), ("c", 8)), path, "two")
    assert now() == [("a", 1), ("a", 2), ("b", 3)]
    assert V.replace_documents(rows(("a", 9)), docs(("a", False, "t2")), path, "two")
    assert now() == [("a", 9), ("b", 3)]
    # a committed run isn't written twice, whatever it brings
    assert not V.replace_documents(rows(("a", 10)), docs(("a", False, "t3")), path, "two") and now() == [("a", 9), ("b", 3)]
    # a document without rows, and one that is retired
    assert V.replace_documents(rows(), docs(("a", False, "t4"), ("b", True, None)), path, "10")
    assert now() == [] and [tuple(r) for r in V.current_documents(spark, path).collect()] == [("a", "10", "t4")]
    assert V.replace_documents(rows(("b", 5)), spark.createDataFrame([("b",), ("b",)], "doc_key string"), path, "9") and now() == [("b", 5)]
