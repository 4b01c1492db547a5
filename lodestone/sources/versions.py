"""A table of documents' chunks that is replaced by whole runs, each visible from its commit on.

A run writes its rows into a folder of its own and, when these are there, a commit: one row for each
document that it replaces or retires, with the run's number and a stamp. Readers see of every document the
rows of its newest committed run. So a run that was killed leaves what was there before, and a run whose name is
committed is not written again. Runs that write at once are ordered by number, then by name; the later wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialize

COMMIT = "doc_key string, retired boolean, stamp string, number long, run string"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, retired, stamp, number, run) of all commits."""
    if not _exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).option("basePath", f"{path}/commits").parquet(f"{path}/commits")


def write_run(rows: DataFrame, path: str, run: str) -> None:
    """The rows of a run, not yet visible; what an earlier attempt left is overwritten."""
    rows.write.mode("overwrite").parquet(f"{path}/rows/run={run}")


def replace_documents(rows: DataFrame, documents: DataFrame, path: str, run: str) -> bool:
    """Replace all rows of ``documents`` (doc_key[, retired, stamp]) by ``rows`` (doc_key and more); False if the run was committed before.

    A document without rows in the run has none afterwards; a retired one is gone with its stamp.
    """
    spark = rows.sparkSession
    known = commits(spark, path)
    if known.where(F.col("run") == run).limit(1).count():
        return False
    write_run(rows, path, run)
    number = known.agg(F.coalesce(F.max("number"), F.lit(0)) + 1).first()[0]
    column = lambda c, kind: (F.col(c) if c in documents.columns else F.lit(None)).cast(kind).alias(c)
    committed = documents.select("doc_key", F.coalesce(column("retired", "boolean"), F.lit(False)).alias("retired"), column("stamp", "string"), F.lit(number).cast("long").alias("number")).dropDuplicates(["doc_key"])
    # one file, renamed into place: there as a whole or not at all
    committed.coalesce(1).write.mode("errorifexists").parquet(f"{path}/commits/run={run}")
    return True


def current_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, run, stamp) of the documents that aren't retired."""
    newest = commits(spark, path).groupBy("doc_key").agg(F.max_by(F.struct("run", "stamp", "retired"), F.struct("number", "run")).alias("at"))
    return newest.where("NOT at.retired").select("doc_key", "at.run", "at.stamp")


def current_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows (of the given schema, with doc_key) of every document's newest committed run."""
    if not _exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, run string").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(materialize(current_documents(spark, path).select("doc_key", "run")), ["doc_key", "run"]).drop("run")
