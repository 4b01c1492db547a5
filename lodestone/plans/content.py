"""Queries of freshness, citations, pages, classes, quota refunds and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answers as A
from lodestone.operators import freshness as V
from lodestone.session import table

YEAR = 2027
#: A small manifest of sources: key, effective and verified year, retired, overridden phrase, evidence.
MANIFEST = [
    ("src1", 2026, None, False, None, None),
    ("src2", 2026, 2027, False, None, None),
    ("src3", None, None, False, None, None),
    ("src4", 2020, 2030, True, None, None),
    ("src5", None, 2027, False, " the ", None),
    ("src6", 2027, None, False, None, " der "),
]
_SCHEMA = "doc_key string, effective int, verified int, retired boolean, phrase string, evidence string"
#: Words that tell the classes of the classifier queries.
CLASSES = {"en": ["the", "and", "of"], "de": ["der", "die", "und"], "fr": ["le", "la", "et"], "es": ["el", "la", "en"]}


def withhold_expired(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select("doc_id", F.col("source").alias("doc_key"), "text")
    return V.withheld(chunks, spark.createDataFrame(MANIFEST, _SCHEMA), YEAR).select("doc_id", "withheld")


def annual_series(spark: SparkSession, d: str) -> DataFrame:
    """Series of yearly documents: whether one covers the year, and whether the next year still lacks one."""
    year = (F.lit(2020) + F.col("doc_id") % 8).cast("int")
    rows = table(spark, d, "documents").select(V.series_key(F.concat_ws("-", "source", year)).alias("series"), year.alias("year"))
    held = lambda y: F.bool_or(V.covers(y, F.col("year"), F.lit(None).cast("int")))
    return rows.groupBy("series").agg(held(2026).alias("covered"), (held(2026) & ~held(2027)).alias("due"), F.max("year").alias("latest"))


def html_to_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    parts = T.html_paragraphs(F.col("html"))
    return table(spark, d, "pages").where("html IS NOT NULL").select("page_id", F.size(parts).alias("n"), F.md5(F.array_join(parts, "\n")).alias("digest"))


def link_extract(spark: SparkSession, d: str) -> DataFrame:
    """Distinct https links of each page."""
    links = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))
    rows = table(spark, d, "pages").select("page_id", "url", links.alias("link"))
    return rows.select("page_id", A.https_link(F.col("link"), F.col("url")).alias("link")).where("link IS NOT NULL").distinct()


def routing_classify(spark: SparkSession, d: str) -> DataFrame:
    """The first of the best classes."""
    return table(spark, d, "documents").select("doc_id", A.classify(T.fold(F.col("text")), CLASSES, True).alias("class"))


def family_classify(spark: SparkSession, d: str) -> DataFrame:
    """The last of the best classes."""
    return table(spark, d, "documents").select("doc_id", A.classify(T.fold(F.col("text")), CLASSES, False).alias("class"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Turns as answers that cite up to three sources."""
    mark = lambda n: F.concat(F.lit(" ["), n.cast("string"), F.lit("]"))
    cited = F.when(F.col("conv_id") % 5 > 0, F.concat(mark(F.col("turn") + 1), mark(F.col("conv_id") % 7), mark(F.col("turn")))).otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", T.markers(F.concat(F.coalesce("text", F.lit("")), cited)).alias("numbers"))


def citation_invariant(spark: SparkSession, d: str) -> DataFrame:
    """Answers over three sources."""
    rows = _answers(spark, d).withColumn("v", A.invariant(F.col("numbers"), F.lit(3)))
    return rows.select("conv_id", "turn", "v.kind", F.array_join(F.col("v.unresolved").cast("array<string>"), ",").alias("unresolved"))


def citation_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Six sources each, of which two at a time are the same."""
    rows = _answers(spark, d)
    sources = rows.select("conv_id", "turn", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("number")).withColumn("identity", F.col("number") % 3)
    return A.ordinals(rows, sources, ["conv_id", "turn"], "numbers")


def refund_clamp(spark: SparkSession, d: str) -> DataFrame:
    """A day's counter of a user after each event: views and clicks count, errors refund, never below 0.

    Clamped at each step, the counter is the running sum less its lowest value so far (or 0).
    """
    day = T.local_date(F.col("ts"))
    step = F.when(F.col("event_type").isin("view", "click"), 1).when(F.col("event_type") == "error", -1)
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", day.alias("day"), step.alias("step")).where("step IS NOT NULL AND user_id IS NOT NULL")
    so_far = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("step").over(so_far)).withColumn("low", F.least(F.lit(0), F.min("sum").over(so_far)))
    return rows.select("event_id", "user_id", "day", (F.col("sum") - F.col("low")).alias("count"))


def divergence_stage(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbouring events as two runs of a case: which has it, and the first stage in which they differ."""
    rows = table(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("case_id"), (F.col("event_id") % 2).alias("run"), (F.col("user_id") % 3).alias("query"), F.col("event_type").alias("pool"), F.floor(F.col("value") / 50).alias("cut"))
    one, two = (rows.where(F.col("run") == k).drop("run").alias(a) for k, a in ((0, "x"), (1, "y")))
    where = F.when(F.col("x.case_id").isNull(), "only_two").when(F.col("y.case_id").isNull(), "only_one").otherwise("both")
    stage = F.when(where != "both", "unknown")
    for c in ("query", "pool", "cut"):
        stage = stage.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), c)
    joined = one.join(two, F.col("x.case_id") == F.col("y.case_id"), "full_outer")
    return joined.groupBy(where.alias("runs"), stage.otherwise("same").alias("stage")).agg(F.count("*").alias("n"))


def coverage_delta(spark: SparkSession, d: str) -> DataFrame:
    """Requirements met: declared less misses, never below 0, over all declared; by toxic mark."""
    declared, misses = F.col("doc_id") % 4, (1 - F.col("quality")) * 2
    rows = table(spark, d, "labels").where("quality IS NOT NULL")
    sums = rows.groupBy("toxic").agg(F.sum(F.greatest(F.lit(0), declared - misses)).alias("met"), F.sum(declared).alias("declared"))
    return sums.select("toxic", "met", "declared", F.round(F.col("met") / F.nullif("declared", F.lit(0)), 6).alias("share"))


def carrier_recall(spark: SparkSession, d: str) -> DataFrame:
    """A requirement is carried if each of its parts has a carrier (a document of good quality)."""
    rows = table(spark, d, "labels").select(F.floor(F.col("doc_id") / 10).alias("requirement"), (F.col("doc_id") % 3).alias("part"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("ok"))
    parts = rows.groupBy("requirement", "part").agg(F.bool_or("ok").alias("ok"))
    return parts.groupBy("requirement").agg(F.bool_and("ok").alias("carried"), F.count("*").alias("parts"))


def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


def replace_partition(spark: SparkSession, d: str) -> DataFrame:
    """All rows of a source are replaced by one row for each of its languages; other sources stay."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    new = docs.where("source = 'src1'").groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))
    return docs.where("source IS DISTINCT FROM 'src1'").unionByName(new)


QUERIES = {f.__name__: f for f in (withhold_expired, annual_series, html_to_paragraphs, link_extract, routing_classify, family_classify, citation_invariant, citation_ordinals, refund_clamp, divergence_stage, coverage_delta, carrier_recall, customers_without_orders, replace_partition)}

# -- the same in SQL -----------------------------------------------------------------------------


def _value(v: object) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def _class_sql(first_wins: bool) -> str:
    names = list(CLASSES) if first_wins else list(reversed(CLASSES))
    hits = ", ".join(" + ".join(rf"CAST(regexp_matches(f, '(^|\W){k}(\W|$)') AS INTEGER)" for k in CLASSES[n]) for n in names)
    folded = rf"trim(regexp_replace(lower(translate(text, '{T.MARKED}', '{T.PLAIN}')), '\s+', ' ', 'g'))"
    return f"""WITH h AS (SELECT doc_id, CASE WHEN f IS NOT NULL THEN [{hits}] END AS h FROM (SELECT doc_id, {folded} AS f FROM documents))
        SELECT doc_id, CASE WHEN list_max(h) > 0 THEN list_extract({names}, list_position(h, list_max(h))) END AS class FROM h"""


_ROWS = ", ".join(f"({', '.join(map(_value, r))})" for r in MANIFEST)
_MARKS = r"""a AS (SELECT conv_id, turn, list_transform(regexp_extract_all(coalesce(text, '') || CASE WHEN conv_id % 5 > 0 THEN ' [' || (turn + 1) || '] [' || (conv_id % 7) || '] [' || turn || ']' ELSE '' END, '\[(\d{1,4})\]', 1), lambda n: n::INTEGER) AS numbers FROM conversations)"""
_BLOCKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|title|head|body|section|article|nav|header|footer|blockquote|pre|hr"
_BARE = rf"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style\b.*?</style\s*>|<script\b.*?</script\s*>|<!--.*?-->', ' ', 'g'), '(?i)</?(?:{_BLOCKS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"""
for _entity, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_entity}', '{_sign}')"

ORACLE = {
    "withhold_expired": f"""WITH m(k, effective, verified, retired, phrase, evidence) AS (VALUES {_ROWS})
        SELECT doc_id, k IS NOT NULL AND (retired OR NOT coalesce(coalesce(verified, effective) >= {YEAR} AND (effective IS NULL OR effective <= {YEAR}), false)
            OR coalesce(contains(coalesce(text, ''), phrase), false) OR coalesce(NOT contains(coalesce(text, ''), evidence), false)) AS withheld
        FROM documents LEFT JOIN m ON source = k""",
    "annual_series": """WITH s AS (SELECT coalesce(source, '') AS s, source, CAST(2020 + doc_id % 8 AS INTEGER) AS y FROM documents)
        SELECT s AS series, bool_or(y = 2026) AS covered, bool_or(y = 2026) AND NOT bool_or(y = 2027) AS due, max(y) AS latest FROM s GROUP BY s""",
    "html_to_paragraphs": rf"""WITH p AS (SELECT page_id, list_filter(list_transform(string_split({_BARE}, chr(10)), lambda s: trim(regexp_replace(s, '[ \t\r\f]+', ' ', 'g'))), lambda s: s <> '') AS p FROM pages WHERE html IS NOT NULL)
        SELECT page_id, CAST(len(p) AS INTEGER) AS n, md5(array_to_string(p, chr(10))) AS digest FROM p""",
    "link_extract": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS l, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
        r AS (SELECT page_id, CASE WHEN starts_with(l, 'https://') THEN l WHEN starts_with(l, '/') AND NOT starts_with(l, '//') AND host <> '' THEN 'https://' || host || l END AS link FROM l)
        SELECT DISTINCT page_id, link FROM r WHERE link IS NOT NULL""",
    "routing_classify": _class_sql(True),
    "family_classify": _class_sql(False),
    "citation_invariant": f"""WITH {_MARKS}, u AS (SELECT *, list_filter(numbers, lambda n: n < 1 OR n > 3) AS u FROM a)
        SELECT conv_id, turn, CASE WHEN len(u) = len(numbers) THEN 'no_markers' WHEN len(u) > 0 THEN 'unresolved' ELSE 'ok' END AS kind,
            array_to_string(list_filter(u, lambda n, i: list_position(u, n) = i), ',') AS unresolved FROM u""",
    "citation_ordinals": f"""WITH {_MARKS}, e AS (SELECT conv_id, turn, unnest(numbers) AS n, generate_subscripts(numbers, 1) AS pos FROM a),
        f AS (SELECT conv_id, turn, n % 3 AS identity, min(pos) AS pos FROM e WHERE n BETWEEN 1 AND 6 GROUP BY ALL)
        SELECT conv_id, turn, identity, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS INTEGER) AS ordinal FROM f""",
    # the clamp step by step, as the counter does it
    "refund_clamp": """WITH e AS (SELECT event_id, user_id, strftime(ts - INTERVAL 6 HOURS, '%Y-%m-%d') AS day, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS step, ts FROM events
            WHERE event_type IN ('view', 'click', 'error') AND user_id IS NOT NULL),
        l AS (SELECT *, list(step) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS steps FROM e)
        SELECT event_id, user_id, day, list_reduce(list_prepend(0, steps), lambda c, x: greatest(c + x, 0)) AS count FROM l""",
    "divergence_stage": """WITH r AS (SELECT event_id // 2 AS c, event_id % 2 AS run, user_id % 3 AS q, event_type AS p, floor(value / 50) AS k FROM events),
        j AS (SELECT x.c AS a, y.c AS b, x.q IS NOT DISTINCT FROM y.q AS sq, x.p IS NOT DISTINCT FROM y.p AS sp, x.k IS NOT DISTINCT FROM y.k AS sk
            FROM (FROM r WHERE run = 0) x FULL JOIN (FROM r WHERE run = 1) y ON x.c = y.c),
        s AS (SELECT CASE WHEN a IS NULL THEN 'only_two' WHEN b IS NULL THEN 'only_one' ELSE 'both' END AS runs,
            CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN NOT sq THEN 'query' WHEN NOT sp THEN 'pool' WHEN NOT sk THEN 'cut' ELSE 'same' END AS stage FROM j)
        SELECT runs, stage, count(*) AS n FROM s GROUP BY ALL""",
    "coverage_delta": """WITH s AS (SELECT toxic, CAST(sum(greatest(0, doc_id % 4 - (1 - quality) * 2)) AS BIGINT) AS met, CAST(sum(doc_id % 4) AS BIGINT) AS declared FROM labels WHERE quality IS NOT NULL GROUP BY toxic)
        SELECT *, round(met / nullif(declared, 0), 6) AS share FROM s""",
    "carrier_recall": """WITH p AS (SELECT doc_id // 10 AS requirement, doc_id % 3 AS part, bool_or(coalesce(quality = 1, false)) AS ok FROM labels GROUP BY ALL)
        SELECT requirement, bool_and(ok) AS carried, count(*) AS parts FROM p GROUP BY requirement""",
    "customers_without_orders": "SELECT c_custkey, c_nationkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey",
    "replace_partition": "SELECT doc_id, source, lang FROM documents WHERE source IS DISTINCT FROM 'src1' UNION ALL SELECT min(doc_id), source, lang FROM documents WHERE source = 'src1' GROUP BY source, lang",
}
