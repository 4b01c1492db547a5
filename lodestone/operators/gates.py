"""What must hold before documents may replace what is served: evidence, pins, keep-lists and excerpts.

Each gate gives rows with a ``problem`` (null where all is well) instead of failing the job, so one document's
problem keeps only that document back. Manifests are joined by document; their rows are few, those of chunks many,
and nothing is gathered but a document's own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of facts whose article must carry the evidence in each chunk; of the others one chunk is enough.
EVERY = ("year", "dated")


def _plain(text: Column) -> Column:
    """Blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def evidence_gate(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_key, article, kind, evidence, problem) of facts (doc_key, article, kind, evidence) over chunks (doc_key, article, content).

    ``missing``: the document has no chunk of that article; ``lacking``: a chunk of a year's or a dated fact doesn't
    carry the evidence, or none of an overridden figure's does.
    """
    carries = F.coalesce(F.contains("content", F.col("evidence")), F.lit(False))
    found = facts.join(chunks.select("doc_key", "article", "content"), ["doc_key", "article"]).groupBy("doc_key", "article", "kind", "evidence").agg(F.bool_and(carries).alias("all"), F.bool_or(carries).alias("some"))
    held = F.when(F.col("kind").isin(*EVERY), F.col("all")).otherwise(F.col("some"))
    keys = ["doc_key", "article", "kind", "evidence"]
    return facts.select(*keys).join(found, keys, "left").select(*keys, F.when(held.isNull(), "missing").when(~held, "lacking").alias("problem"))


def pinned_binaries(files: DataFrame, pins: DataFrame, accepted: list[str] | None = None) -> DataFrame:
    """(doc_key, sha256, state) of files (doc_key, content): ``matches`` its pin (doc_key, sha256), ``accepted`` though changed, ``changed``, ``bad_pin``, or ``unpinned``."""
    rows = files.select("doc_key", F.sha2("content", 256).alias("sha256")).join(pins.select("doc_key", F.col("sha256").alias("pin")), "doc_key", "left")
    state = F.when(F.col("pin").isNull(), "unpinned").when(~F.col("pin").rlike("^[a-f0-9]{64}$"), "bad_pin").when(F.col("pin") == F.col("sha256"), "matches").when(F.col("doc_key").isin(accepted or []), "accepted").otherwise("changed")
    return rows.select("doc_key", "sha256", state.alias("state"))


def kept_articles(chunks: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks that a document's list keeps, problems): chunks (doc_key, n, article, path: array), keep (doc_key, label).

    Labels are compared without regard to case and blanks. Problems (doc_key, label, problem): ``twice`` listed,
    ``nowhere`` in the document, or under ``several_paths``. Chunks keep their order ``n``; those of documents
    without a list stay as they are.
    """
    label = lambda c: F.lower(_plain(F.col(c)))
    listed = keep.groupBy("doc_key", label("label").alias("key")).agg(F.min("label").alias("label"), F.count("*").alias("times"))
    keyed = chunks.withColumn("__key", label("article"))
    found = keyed.where("__key IS NOT NULL").groupBy("doc_key", F.col("__key").alias("key")).agg(F.countDistinct("path").alias("paths"))
    problem = F.when(F.col("times") > 1, "twice").when(F.col("paths").isNull(), "nowhere").when(F.col("paths") > 1, "several_paths")
    problems = listed.join(found, ["doc_key", "key"], "left").select("doc_key", "label", problem.alias("problem")).where("problem IS NOT NULL")
    lists = listed.groupBy("doc_key").agg(F.collect_set("key").alias("__keys"))
    kept = keyed.join(lists, "doc_key", "left").where(F.col("__keys").isNull() | F.coalesce(F.array_contains("__keys", F.col("__key")), F.lit(False)))
    return kept.drop("__key", "__keys"), problems


def excerpts(texts: DataFrame, slices: DataFrame) -> DataFrame:
    """(doc_id, text, problem) of texts (doc_id, text) and their slices (doc_id, place, from, to), whose lines are joined by a blank line.

    A marker names one line: the only one that equals it, else the only one that holds it (blanks collapsed). A slice
    runs from its line to before the line of ``to``, or to the end. Of several problems the first slice's first is
    told: ``from`` or ``to`` with ``_nowhere`` or ``_ambiguous``, ``empty``, or ``crossing`` the slice before.
    """
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).withColumn("flat", _plain(F.col("line")))
    sizes = lines.groupBy("doc_id").agg(F.count("*").alias("n"))
    ends = F.explode(F.array(F.struct(F.lit("from").alias("end"), F.col("from").alias("marker")), F.struct(F.lit("to").alias("end"), F.col("to").alias("marker"))))
    markers = slices.select("doc_id", "place", ends.alias("e")).select("doc_id", "place", "e.*").where("marker IS NOT NULL").withColumn("marker", _plain(F.col("marker")))
    hit = markers.join(lines.select("doc_id", "i", "flat"), "doc_id").where(F.contains("flat", F.col("marker")))
    equal = F.col("flat") == F.col("marker")
    places = hit.groupBy("doc_id", "place", "end").agg(F.count_if(equal).alias("equal"), F.count("*").alias("hits"), F.min(F.when(equal, F.col("i"))).alias("exact"), F.min("i").alias("any"))
    state = F.when(F.col("hits").isNull(), "nowhere").when((F.col("equal") > 1) | ((F.col("equal") == 0) & (F.col("hits") > 1)), "ambiguous")
    placed = markers.join(places, ["doc_id", "place", "end"], "left").select("doc_id", "place", "end", F.coalesce("exact", "any").alias("i"), state.alias("state"))
    by_slice = slices.select("doc_id", "place").join(placed, ["doc_id", "place"], "left").groupBy("doc_id", "place").agg(
        *(F.max(F.when(F.col("end") == e, F.col(c))).alias(f"{e}_{c}") for e in ("from", "to") for c in ("i", "state")), F.max(F.when(F.col("end") == "to", 1)).alias("bounded")
    )
    rows = by_slice.join(sizes, "doc_id", "left").withColumn("stop", F.when(F.col("bounded") == 1, F.col("to_i")).otherwise(F.col("n")))
    before = F.lag("stop").over(Window.partitionBy("doc_id").orderBy("place"))
    wrong = lambda e: F.concat(F.lit(f"{e}_"), F.col(f"{e}_state"))
    own = F.coalesce(F.when(F.col("n").isNull(), "from_nowhere"), wrong("from"), wrong("to"), F.when(F.col("stop") <= F.col("from_i"), "empty"))
    rows = rows.withColumns({"own": own, "crossing": F.coalesce(F.col("from_i") < before, F.lit(False))})
    first = rows.groupBy("doc_id").agg(F.min_by("own", F.when(F.col("own").isNotNull(), F.col("place"))).alias("own"), F.bool_or("crossing").alias("crossing"), F.array_sort(F.collect_list(F.struct("place", "from_i", "stop"))).alias("ranges"))
    problem = F.coalesce("own", F.when(F.col("crossing"), "crossing"))
    split = F.split("text", "\n", -1)
    joined = F.array_join(F.transform("ranges", lambda r: F.array_join(F.slice(split, r["from_i"] + 1, (r["stop"] - r["from_i"]).cast("int")), "\n")), "\n\n")
    out = texts.select("doc_id", "text").join(first.withColumn("problem", problem), "doc_id")
    return out.select("doc_id", F.when(F.col("problem").isNull(), joined).alias("text"), "problem")
