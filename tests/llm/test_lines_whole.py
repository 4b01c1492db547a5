import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline as P
from lodestone.llm import lines as L
from tests.oracle import compare


def run(spark, tmp_path, rows):
    """Text by id, after a comparison with the SQL twin."""
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    pq.write_table(table, tmp_path / "documents.parquet")
    got, want = compare(spark, L.op5_line_dedup, L.OP5_SQL, str(tmp_path))
    assert got == want
    return {r.doc_id: r.text for r in L.op5_line_dedup(spark, str(tmp_path)).collect()}


def test_short_lines(spark, tmp_path):
    rows = [(i, f"Les.\n\nAll rights reserved.\npage {i}\n{'abcd'[i]}") for i in range(4)] + [(9, None), (10, ""), (11, " \n\n"), (12, "x\nx\nx")]
    got = run(spark, tmp_path, rows)
    assert got == {**dict(rows), 1: "\nb", 2: "\nc", 3: "\nd"}


def test_pipeline_drops_short_lines(spark):
    docs = spark.createDataFrame([(i, f"Les.\nonly here {'abcd'[i]}", 1) for i in range(4)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in P.lines(spark, docs, "").collect()}
    assert got == {0: "Les.\nonly here a", **{i: f"only here {'abcd'[i]}" for i in (1, 2, 3)}}


def test_long_lines_of_two_documents(spark, tmp_path):
    long = " ".join(f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(51))
    fifty = long.rpartition(" ")[0]
    rows = [(i, f"{long} {end}\n{fifty}\nown {'abc'[i]}") for i, end in ((1, ""), (2, ""))] + [(None, f"{long} \nelsewhere")]
    got = run(spark, tmp_path, rows)
    # fifty words stand in two documents only and stay, the longer line stays in the first
    assert got == {1: rows[0][1], 2: f"{fifty}\nown c", None: "elsewhere"}
    (tmp_path / "null").mkdir()
    assert run(spark, tmp_path / "null", [rows[0], rows[2]]) == {1: rows[0][1], None: "elsewhere"}


def test_rows_that_share_an_id(spark, tmp_path):
    """Each text loses its own lines only, whatever other rows of its id lose."""
    head = "all rights reserved by the owner"
    rows = [(k, head) for k in (1, 2, 3)] + [(9, "unique precious first content alpha\n" + head), (9, head + "\nsecond text of nine"), (9, head + "\nsecond text of nine")]
    rows += [(None, head + "\nnameless"), (None, "nameless other\n" + head), (None, None)]
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    pq.write_table(table, tmp_path / "documents.parquet")
    got, want = compare(spark, L.op5_line_dedup, L.OP5_SQL, str(tmp_path))
    assert got == want
    found = sorted(((r.doc_id or 0), r.text) for r in L.op5_line_dedup(spark, str(tmp_path)).collect() if r.text is not None)
    assert found == [(0, "nameless"), (0, "nameless other"), (1, head), (2, ""), (3, ""), (9, "second text of nine"), (9, "second text of nine"), (9, "unique precious first content alpha")]
