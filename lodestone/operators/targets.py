"""Targets of evaluation cases: which chunks of a corpus satisfy them, and which of an answer set do.

A target (case_id, target, doc_key, article, path) wants a chunk of its document, with its article's label where
it names one (case doesn't matter), and with its path among what the chunk holds where it names one. The
corpus is counted by document, label and path first, so a target meets one row of counts and never the chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for "any" among labels and paths.
ANY = "\u0000"


def _index(chunks: DataFrame) -> DataFrame:
    """(doc_key, label, path, n) of chunks (doc_key, label, holds: array), each counted under its label and under any, and under each path and any."""
    labels = F.array(F.lit(ANY), F.lower("label"))
    paths = F.array_union(F.array(F.lit(ANY)), F.array_compact(F.coalesce("holds", F.array().cast("array<string>"))))
    rows = chunks.select("doc_key", F.explode(F.array_distinct(F.array_compact(labels))).alias("label"), paths.alias("paths"))
    return rows.select("doc_key", "label", F.explode("paths").alias("path")).groupBy("doc_key", "label", "path").agg(F.count("*").alias("n"))


def target_counts(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, target, n, unsatisfiable): how many chunks satisfy each target."""
    asked = targets.select("case_id", "target", "doc_key", F.coalesce(F.lower("article"), F.lit(ANY)).alias("label"), F.coalesce("path", F.lit(ANY)).alias("path"))
    found = asked.join(_index(chunks), ["doc_key", "label", "path"], "left")
    return found.select("case_id", "target", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("unsatisfiable"))


def _satisfies() -> Column:
    article = F.col("article").isNull() | (F.lower("label") == F.lower("article"))
    return article & (F.col("path").isNull() | F.array_contains("holds", F.col("path")))


def target_places(targets: DataFrame, answers: DataFrame) -> DataFrame:
    """(case_id, target, pos): the first place of an answer set (case_id, pos, doc_key, label, holds) that satisfies each target, or null."""
    met = targets.join(answers, ["case_id", "doc_key"]).where(_satisfies()).groupBy("case_id", "target").agg(F.min("pos").alias("pos"))
    return targets.select("case_id", "target").join(met, ["case_id", "target"], "left")
