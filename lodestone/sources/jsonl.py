"""Lines of JSON, manifests, and server-sent events as DataFrames; line files as sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, schema: str, id_col: str = "id", line_col: str = "value") -> DataFrame:
    """One row for each line that isn't blank: the fields of ``schema``, ``malformed``, and ``repeated`` for ids that came before in the table."""
    rows = lines.where(F.trim(line_col) != "").select(F.from_json(line_col, schema).alias("j"), F.get_json_object(line_col, "$").isNull().alias("malformed"))
    rows = rows.select("j.*", "malformed")
    twice = rows.where(~F.col("malformed")).groupBy(id_col).agg((F.count("*") > 1).alias("repeated"))
    return rows.join(twice, id_col, "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))


def read_jsonl(spark: SparkSession, path: str, schema: str, id_col: str = "id") -> DataFrame:
    return parse_lines(spark.read.text(path), schema, id_col)


def write_jsonl(rows: DataFrame, path: str) -> str:
    """Write lines of JSON to a new folder: the path, or the path with the first numeric suffix that isn't taken when it is written."""
    target, n = path, 0
    while True:
        try:
            rows.write.mode("errorifexists").json(target)
            return target
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
        n += 1
        target = f"{path}-{n}"


def manifest_rows(manifest: DataFrame, allowed: list[str] | None, key: str = "doc_key") -> DataFrame:
    """The manifest's rows of the allowed keys (all without a list); an unknown key is an error that names them all."""
    if allowed is None:
        return manifest
    wanted = manifest.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(allowed)], f"{key} string")
    unknown = sorted(r[0] for r in wanted.join(manifest.select(key).distinct(), key, "left_anti").collect())
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    return manifest.join(F.broadcast(wanted), key, "left_semi")


def event_data(line: Column) -> Column:
    """Payload of a ``data:`` line of a stream, null for other lines and for the end mark."""
    found = F.trim(F.regexp_extract(line, r"^data:(.*)$", 1))
    return F.when((found != "") & (found != "[DONE]"), found)
