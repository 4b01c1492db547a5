"""Writes that replace: a document's chunks as a whole, and an index only where its rows changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize


def replaced(old: DataFrame, new: DataFrame, key: str = "doc_key") -> DataFrame:
    """The old rows of other keys and the new rows, stored, so that the result may overwrite what it was read from."""
    return materialize(old.join(new.select(key).distinct(), key, "left_anti").unionByName(new))


def retired(chunks: DataFrame, documents: DataFrame, keys: DataFrame, key: str = "doc_key") -> tuple[DataFrame, DataFrame]:
    """Chunks and documents without the retired keys (the chunks go with their document)."""
    return tuple(rows.join(keys.select(key).distinct(), key, "left_anti") for rows in (chunks, documents))


def digest(rows: DataFrame, ignore: tuple[str, ...] = ()) -> int:
    """A sum over the rows that doesn't depend on their order; columns named in ``ignore`` (stamps) don't count."""
    kept = sorted(c for c in rows.columns if c not in ignore)
    total = rows.agg(F.sum(F.xxhash64(*kept).cast("decimal(38,0)")), F.count("*")).first()
    return hash((int(total[0] or 0), total[1], *kept))


def write_if_changed(rows: DataFrame, path: str, ignore: tuple[str, ...] = ()) -> bool:
    """Overwrite the table at ``path`` unless it holds the same rows but for the ignored columns."""
    spark = rows.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # a path that isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    rows = materialize(rows)
    if old is not None and sorted(old.columns) == sorted(rows.columns) and digest(old, ignore) == digest(rows, ignore):
        return False
    rows.write.mode("overwrite").parquet(path)
    return True
