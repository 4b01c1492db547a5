"""Measures of evaluation runs and classes of asks, as functions over DataFrames of stated columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands behind a declared claim where one of its literals was missed.
REMARK = r" \([^()]*: (?:absent|present but uncited)\)$"
#: What a new answer set must reach: gain of the mean share, share of equal picks, of hits, and rows more at most.
LEAST_GAIN, LEAST_SAME, LEAST_HITS, MOST_MORE = 0.1, 0.9, 0.94, 2


def requirement_coverage(cases: DataFrame, base: str) -> DataFrame:
    """(run, stated, total, coverage, delta) of (run, case_id, declared, misses); cases that a run couldn't read have null misses and are skipped.

    A case states what it declares less its misses, nothing at least; ``delta`` is the distance from the run ``base``.
    """
    sums = cases.where("misses IS NOT NULL").groupBy("run").agg(F.sum(F.greatest(F.lit(0), F.col("declared") - F.col("misses"))).alias("stated"), F.sum("declared").alias("total"))
    share = F.round(F.col("stated") / F.col("total"), 6)
    # a row for each run
    return sums.withColumn("coverage", share).withColumn("delta", F.round(share - F.max(F.when(F.col("run") == base, share)).over(Window.partitionBy()), 6))


def central_misses(cases: DataFrame, declared: DataFrame) -> DataFrame:
    """(case_id, missed, stale) of (case_id, central, missing, literals), for cases with a central claim.

    It is missed if it is listed as missing, or with a remark on a literal behind it. ``stale`` counts the
    misses that name no claim of ``declared`` (claim).
    """
    missed = F.array_contains("missing", F.col("central")) | F.exists("literals", lambda x: F.startswith(x, F.concat("central", F.lit(" ("))))
    rows = cases.where("central IS NOT NULL").select("case_id", missed.alias("missed"), F.concat("missing", F.transform("literals", lambda x: F.regexp_replace(x, REMARK, ""))).alias("named"))
    names = rows.select("case_id", F.explode("named").alias("claim")).join(declared.select("claim").distinct(), "claim", "left_anti")
    stale = names.groupBy("case_id").agg(F.count("*").alias("stale"))
    return rows.select("case_id", "missed").join(stale, "case_id", "left").select("case_id", "missed", F.coalesce("stale", F.lit(0)).alias("stale"))


def gates(figures: DataFrame, baselines: DataFrame) -> DataFrame:
    """(gate, value, floor, passed) of figures (gate, value) and baselines (gate, baseline, margin); a gate without a figure fails."""
    floor = F.col("baseline") - F.col("margin")
    return baselines.join(figures, "gate", "left").select("gate", "value", floor.alias("floor"), F.coalesce(F.col("value") >= floor, F.lit(False)).alias("passed"))


def part_cause(in_corpus: Column, found: Column) -> Column:
    """Why a part is missed: 1 not in the corpus, 2 not found, 3 not said."""
    return F.when(~in_corpus, 1).when(~found, 2).otherwise(3)


def requirement_causes(parts: DataFrame) -> DataFrame:
    """(requirement, cause, split) of missed parts (requirement, in_corpus, found): the least of the parts' causes, and whether they differ."""
    cause = part_cause(F.col("in_corpus"), F.col("found"))
    return parts.groupBy("requirement").agg(F.min(cause).alias("cause"), (F.countDistinct(cause) > 1).alias("split"))


def answer_set_bars(cases: DataFrame) -> DataFrame:
    """One row: gain, same, hit, more and the bars r1 to r4 of cases (old, new: shares of carriers found; same: equal picks; hit; more: rows more than before)."""
    sums = cases.agg(F.round(F.avg("new") - F.avg("old"), 6).alias("gain"), F.round(F.avg(F.col("same").cast("int")), 6).alias("same"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit"), F.max("more").alias("more"))
    return sums.withColumns({"r1": F.col("gain") >= LEAST_GAIN, "r2": F.col("same") >= LEAST_SAME, "r3": F.col("hit") >= LEAST_HITS, "r4": F.col("more") <= MOST_MORE})


def ask_outcome(failed: Column, charged: Column, degraded: Column, abort: Column, answered: Column) -> Column:
    """A failure comes first (charged or given back), then a degraded answer unless the reader left, then answered or declined."""
    return F.when(failed, F.when(charged, "charged_error").otherwise("refunded_error")).when(degraded & ~abort.eqNullSafe(F.lit("client")), "degraded").when(answered, "ok").otherwise("declined")


def drop_class(cause: Column, status: Column) -> Column:
    """The class of a dropped reading: its cause, or of an HTTP answer 429, 4xx, 5xx or other."""
    by_status = F.when(status == 429, "429").when(status.between(400, 499), "4xx").when(status.between(500, 599), "5xx").otherwise("other_status")
    return F.when(cause != "http", cause).otherwise(by_status)


def stage_sums(timers: DataFrame, stages: list[str]) -> DataFrame:
    """One row for each ask with the seconds of each stage summed over its retries (ask_id, stage, seconds); null for a stage that never ran."""
    return timers.groupBy("ask_id").pivot("stage", stages).agg(F.round(F.sum("seconds"), 6))
