"""Exchanges as they are kept: appended with what the reader saw, listed and deleted by their owner; event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def question_rows(exchanges: DataFrame) -> DataFrame:
    """What is stored of (id, user_id, created_at, question, condensed, answer, citations: array): markers without a citation behind them are deleted."""
    answer = T.drop_unbacked_markers(F.col("answer"), F.coalesce(F.size("citations"), F.lit(0)))
    return exchanges.select("id", "user_id", "created_at", "question", F.col("condensed").alias("condensed_question"), answer.alias("answer"), "citations")


def history(rows: DataFrame, users: DataFrame) -> DataFrame:
    """The rows of the users (user_id), numbered by ``pos`` for each from the newest on (of equal times the larger id first); rows without an owner are nobody's."""
    own = rows.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return own.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))))


def without(rows: DataFrame, deletions: DataFrame) -> DataFrame:
    """The rows but those that their own owner deletes (id, user_id); another's deletion changes nothing."""
    return rows.join(deletions.select("id", "user_id").distinct(), ["id", "user_id"], "left_anti")


def event_lines(prefix: str, *fields: str | Column) -> Column:
    """A log line: the prefix, a blank, and the fields as one JSON object (nulls left out)."""
    return F.concat(F.lit(f"{prefix} "), F.to_json(F.struct(*fields)))
