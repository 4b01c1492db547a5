import math

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import topk


def brute(rows, k=5):
    out = []
    vectors = [(i, v) for i, v in rows if i is not None and v is not None]
    for q, a in sorted({i: v for i, v in sorted(vectors, reverse=True)}.items()):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in vectors if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, v array<long>, score string")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "FEW", 6)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-60, 60, 8).tolist()) for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_ties_repeated_rows_and_lengths(spark):
    rows = [(i, [1, 2, 3]) for i in range(300)] + [(7, [1, 2, 3])] * 3 + [(500, [5]), (501, []), (None, [1, 1, 1]), (502, None), (50, [1, 2, 3])]
    assert run(spark, rows) == brute(rows)


def test_fewer_than_k_and_large_components(spark):
    rows = [(0, [2**40, 3]), (1, [2**20, 1]), (2, [-5, 2**40])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1])]) == [] and run(spark, []) == [] and run(spark, [(3, [1])]) == []


def test_query_filters_unsound_vectors(spark, tmp_path):
    rows = [(0, [0.5, -0.25], 1), (1, [math.nan, 1.0], 1), (2, [math.inf, 1.0], 1), (3, [None, 1.0], 1), (4, None, 1), (5, [0.1, 0.1], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [tuple(r) for r in topk.op8_exact_topk(spark, str(tmp_path)).collect()] == [(0, 1, 5, 128 * 25 - 64 * 25)]


def test_copies_of_queries_never_pass_through_the_driver(spark):
    """There are as many copies of the queries as parts of the candidates; Spark's estimate doesn't see that."""
    df = spark.createDataFrame([(i, [i, 1]) for i in range(60)], "vec_id long, v array<long>")
    plan = topk.top_k(df, F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_vectors_are_packed_without_loss(spark):
    for big in (1, 2**15 - 1, -(2**15), 2**15, 2**29):
        rows = [(i, [big, i, -i]) for i in range(55)]
        assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, []), (1, []), (2, [])]) == brute([(0, []), (1, []), (2, [])])
