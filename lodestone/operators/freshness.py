"""Freshness: what a manifest's years, phrases and evidence withhold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covers(year: int, effective: Column, verified: Column) -> Column:
    """Whether an entry holds for ``year``: up to its verified, else its effective year; without any it covers nothing.

    Without an effective year its start is open.
    """
    last = F.coalesce(verified, effective)
    return F.coalesce((last >= year) & (effective.isNull() | (effective <= year)), F.lit(False))


def series_key(doc_key: Column) -> Column:
    """A document's key without the year at its end."""
    return F.regexp_replace(doc_key, r"-\d{4}$", "")


def withheld(chunks: DataFrame, manifest: DataFrame, year: int, key: str = "doc_key", text: str = "text") -> DataFrame:
    """``chunks`` with ``withheld``. The manifest has one row a document: the key, effective, verified, retired, phrase, evidence.

    A chunk is withheld if its document is retired or doesn't cover the year, if it holds the overridden
    phrase, or lacks the evidence. Documents that the manifest doesn't know pass. A null text holds nothing.
    """
    known = manifest.select(F.col(key).alias("__key"), "effective", "verified", "retired", "phrase", "evidence")
    body = F.coalesce(F.col(text), F.lit(""))
    stale = F.coalesce("retired", F.lit(False)) | ~covers(year, F.col("effective"), F.col("verified"))
    overridden = F.coalesce(F.contains(body, F.col("phrase")), F.lit(False))
    unproved = F.coalesce(~F.contains(body, F.col("evidence")), F.lit(False))
    rows = chunks.join(known, F.col(key) == F.col("__key"), "left")
    return rows.withColumn("withheld", F.col("__key").isNotNull() & (stale | overridden | unproved)).drop(*known.columns)
