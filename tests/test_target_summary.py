import duckdb
import pytest

from lodestone.plans import answers
from tests.oracle import compare

#: The list as it was made in one string, and its totals.
LISTED = f"""WITH {answers._CHUNKS}, {answers._TARGETS}, n AS (SELECT case_id, target, count(c.doc_id) AS n FROM t LEFT JOIN c ON {answers._MATCH} GROUP BY case_id, target)
SELECT count(*) FILTER (n > 0), count(*), string_agg(lpad(CAST(case_id AS VARCHAR), 6, '0') || '/' || target, ',' ORDER BY lpad(CAST(case_id AS VARCHAR), 6, '0') || '/' || target) FILTER (n = 0) FROM n"""


def test_every_unsatisfied_target_is_listed(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    satisfied, total, listed = con.execute(LISTED).fetchone()
    got = answers.target_summary(spark, d).collect()
    assert len(got) == total - satisfied > 0
    assert ",".join(sorted(r.unsatisfied for r in got)) == listed
    assert {(r.satisfied, r.total, r.ratio) for r in got} == {(satisfied, total, round(satisfied / total, 6))}


@pytest.mark.parametrize("ids, names", [([], [""]), ([0], [""]), ([0, 12, 12, 1_234_567, None], ["/0", "/1", "000012/1", "1234567/0", "1234567/1"])])
def test_no_cases_satisfied_ones_repeated_and_long_ids(spark, tmp_path, ids, names):
    """The documents satisfy both targets of case 0 and the first of case 12."""
    docs = [(n, "t", "en", "s", 1) for n in (1000, 401, 24)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "x") for i in ids], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got, want = compare(spark, answers.target_summary, answers.ORACLE["target_summary"], tmp_path)
    assert got == want
    assert sorted(r[3] for r in got[1]) == names
