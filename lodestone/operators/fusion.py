"""Fusion of ranked legs, weak results, rerank readings, caps, picks and draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.search import ranked

#: Reciprocal-rank constant, pool, answer size.
RRF_K, POOL, TOP = 60, 40, 8
LEGS = ["vector", "lexical", "vector_expansion", "lexical_expansion", "vector_steps", "lexical_steps"]


def rrf_term(rank: Column, weight: Column | float = 1.0, k: int = RRF_K) -> Column:
    """weight / (k + rank); a missing rank gives nothing."""
    return F.coalesce((F.lit(weight) if isinstance(weight, float) else weight) / (F.lit(float(k)) + rank), F.lit(0.0))


def fuse_legs(legs: dict[str, DataFrame], limit: int | None = POOL, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, <leg>_rank …, pos): weighted reciprocal-rank fusion.

    Legs are (query_id, id, rank[, weight]). They are united and summed, so all legs share one shuffle,
    and a leg that lacks a row leaves its rank null.
    """
    rows = reduce(DataFrame.unionByName, (leg.select("query_id", "id", F.lit(name).alias("leg"), "rank", (F.col("weight") if "weight" in leg.columns else F.lit(1.0)).alias("weight")) for name, leg in legs.items()))
    ranks = [F.max(F.when(F.col("leg") == name, F.col("rank"))).alias(f"{name}_rank") for name in legs]
    # parts are added in the order of the legs, so the sum does not depend on how rows arrive
    parts = [F.max(F.when(F.col("leg") == name, rrf_term(F.col("rank"), F.col("weight"), k))) for name in legs]
    score = F.round(reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for p in parts)), 12)
    fused = rows.groupBy("query_id", "id").agg(score.alias("score"), *ranks)
    return ranked(fused, [F.desc("score"), F.col("id")], ["query_id"], "pos", limit)


def fuse_two_full_outer(vector: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """The two-leg form as a full outer join."""
    v, l = vector.select("query_id", "id", F.col("rank").alias("vector_rank")), lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"))
    rows = v.join(l, ["query_id", "id"], "full_outer")
    score = F.round(rrf_term(F.col("vector_rank"), 1.0, k) + rrf_term(F.col("lexical_rank"), 1.0, k), 12)
    return rows.withColumn("score", score)


def corroborated(fused: DataFrame) -> DataFrame:
    """``corroborated``: near by vector (own or expansion) and found by the query's own words; steps never witness."""
    ok = (F.col("vector_rank").isNotNull() | F.col("vector_expansion_rank").isNotNull()) & F.col("lexical_rank").isNotNull()
    return fused.withColumn("corroborated", ok)


def weak_queries(queries: DataFrame, fused: DataFrame) -> DataFrame:
    """(query_id, is_weak): healthy queries are weak without a corroborated row, degraded ones (``degraded``) without a row found by words."""
    by_query = corroborated(fused).groupBy("query_id").agg(F.bool_or("corroborated").alias("c"), F.bool_or(F.col("lexical_rank").isNotNull()).alias("l"))
    rows = queries.join(by_query, "query_id", "left")
    return rows.select("query_id", (~F.coalesce(F.when(F.col("degraded"), F.col("l")).otherwise(F.col("c")), F.lit(False))).alias("is_weak"))


def retry_as_typed(first: DataFrame, first_weak: DataFrame, retry: DataFrame, retry_weak: DataFrame) -> DataFrame:
    """Rows of the first search, or of the retry where the first is weak and the retry is not."""
    better = first_weak.where("is_weak").join(retry_weak.where("NOT is_weak"), "query_id", "left_semi").select("query_id")
    return first.join(better, "query_id", "left_anti").withColumn("retried", F.lit(False)).unionByName(retry.join(better, "query_id", "left_semi").withColumn("retried", F.lit(True)))


def fuse_readings(pool: DataFrame, readings: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, index, score, pos): the best score over rerank readings.

    pool: (query_id, index); readings: (query_id, reading, pos, index, score). Indexes outside the pool
    and scores that are no numbers go; ties go by the place in the first reading that came back, then by index.
    """
    sound = readings.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))).join(pool, ["query_id", "index"], "left_semi")
    first = sound.groupBy("query_id").agg(F.min("reading").alias("first"))
    best = sound.join(first, "query_id").groupBy("query_id", "index").agg(F.max("score").alias("score"), F.min(F.when(F.col("reading") == F.col("first"), F.col("pos"))).alias("place"))
    return ranked(best, [F.desc("score"), F.asc_nulls_last("place"), F.col("index")], ["query_id"], "rank", limit).drop("place")


def reading_accounts(asked: DataFrame, readings: DataFrame) -> DataFrame:
    """(query_id, asked, returned, dropped): asked is (query_id, reading, cause); ``dropped`` lists causes in order of reading."""
    got = readings.select("query_id", "reading").distinct().withColumn("ok", F.lit(True))
    rows = asked.join(got, ["query_id", "reading"], "left")
    dropped = F.array_sort(F.collect_list(F.when(F.col("ok").isNull(), F.struct("reading", F.coalesce("cause", F.lit("unreadable")).alias("cause")))))
    return rows.groupBy("query_id").agg(F.count("*").alias("asked"), F.count("ok").alias("returned"), F.transform(dropped, lambda x: x["cause"]).alias("dropped"))


def cap_by_document(rows: DataFrame, top: int = TOP, cap: int | None = None) -> DataFrame:
    """The first ``top`` rows by rank with at most ``cap`` of a document; deferred rows fill up behind the taken ones."""
    if cap is None:
        return ranked(rows, [F.col("rank")], ["query_id"], "pos", top)
    inside = rows.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank")))
    return ranked(inside.withColumn("deferred", F.col("__n") > cap), [F.col("deferred"), F.col("rank")], ["query_id"], "pos", top).drop("__n")


def step_picks(scores: DataFrame) -> DataFrame:
    """(query_id, id, score, sentence): each sentence's best row (the first of equals), rows picked twice once with their best score."""
    best = scores.groupBy("query_id", "sentence").agg(F.max_by(F.struct("id", "score"), F.struct("score", (-F.col("pos")).alias("p"))).alias("x"))
    return best.groupBy("query_id", F.col("x.id").alias("id")).agg(F.max("x.score").alias("score"), F.min("sentence").alias("sentence"))


def append_picks(cut: DataFrame, picks: DataFrame, n: int = 2) -> DataFrame:
    """The cut (query_id, id, pos) and behind it up to ``n`` picks (…, rank, score) that it lacks, by rank then score."""
    fresh = ranked(picks.join(cut.select("query_id", "id"), ["query_id", "id"], "left_anti"), [F.asc_nulls_last("rank"), F.desc("score"), F.col("id")], ["query_id"], "n", n)
    last = cut.groupBy("query_id").agg(F.max("pos").alias("last"))
    added = fresh.join(last, "query_id", "left").select("query_id", "id", (F.coalesce("last", F.lit(0)) + F.col("n")).alias("pos"), F.lit(True).alias("pinned"))
    return cut.select("query_id", "id", "pos", F.lit(False).alias("pinned")).unionByName(added)


def displace_by_picks(cut: DataFrame, picks: DataFrame, n: int = 2) -> DataFrame:
    """Up to ``n`` fresh picks each take the place of the lowest row that is not ``protected``; the size stays."""
    fresh = ranked(picks.join(cut.select("query_id", "id"), ["query_id", "id"], "left_anti"), [F.asc_nulls_last("rank"), F.desc("score"), F.col("id")], ["query_id"], "n", n)
    free = ranked(cut.where("NOT protected"), [F.desc("pos")], ["query_id"], "n", n)
    swap = free.select("query_id", F.col("id").alias("out"), "n").join(fresh.select("query_id", F.col("id").alias("into"), "n"), ["query_id", "n"])
    rows = cut.join(swap.select("query_id", F.col("out").alias("id"), "into"), ["query_id", "id"], "left")
    return rows.select("query_id", F.coalesce("into", "id").alias("id"), "pos", F.col("into").isNotNull().alias("pinned"))


def merge_draws(draws: DataFrame, pool: int = POOL, top: int = TOP, k: int = RRF_K) -> DataFrame:
    """Several draws (query_id, draw, id, rank, score, place) as one: summed RRF picks the pool, then best score, best place, RRF."""
    summed = draws.groupBy("query_id", "id").agg(F.round(F.sum(rrf_term(F.col("rank"), 1.0, k)), 9).alias("rrf"), F.max("score").alias("score"), F.min("place").alias("place"))
    pooled = ranked(summed, [F.desc("rrf"), F.col("id")], ["query_id"], "pool_pos", pool)
    return ranked(pooled, [F.desc_nulls_last("score"), F.asc_nulls_last("place"), F.desc("rrf"), F.col("id")], ["query_id"], "pos", top)


def first_citations(rows: DataFrame) -> DataFrame:
    """Of each (query, document, label) the first row in fused order."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "doc_id", "label").orderBy("pos")))
    return first.where("__n = 1").drop("__n")
