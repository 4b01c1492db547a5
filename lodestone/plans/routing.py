"""Queries over routes, families, step probes, named sources and declines.

Fixtures: a question is a document's first words with three keywords of the tables behind them, picked by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import routing
from lodestone.session import table

_WORDS = [k for words in (*routing.ROUTES.values(), *routing.FAMILIES.values()) for k in words]
#: How far apart the keywords of a question are in the tables; every fifth question has none.
_STEPS = (7, 31, 113)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    keyword = lambda k: F.get(F.array(*map(F.lit, _WORDS)), (F.col("doc_id") * k % len(_WORDS)).cast("int"))
    said = F.when(F.col("doc_id") % 5 > 0, F.concat_ws(" ", F.lit("¿Qué:"), *(keyword(k) for k in _STEPS), F.lit("y más?"))).otherwise("")
    head = F.substring_index(F.translate("text", "\n", " "), " ", 12)
    return table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.concat(F.upper(head), F.lit(" "), said).alias("text"))


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as the families' sentences."""
    names = F.array(*map(F.lit, routing.FAMILIES))
    rows = table(spark, d, "benchmark").select(F.get(names, (F.col("item_id") % len(routing.FAMILIES)).cast("int")).alias("family"), F.col("item_id").alias("place"), F.col("text").alias("sentence"))
    return rows.where("sentence IS NOT NULL")


def question_routes(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("query_id", routing.route(F.col("text")).alias("route"), routing.family(F.col("text")).alias("family"))


def step_probes(spark: SparkSession, d: str) -> DataFrame:
    return routing.step_probes(_questions(spark, d), _catalogue(spark, d)).select("query_id", "family", "place", F.md5("sentence").alias("sentence"))


def named_source_questions(spark: SparkSession, d: str) -> DataFrame:
    return routing.named_sources(_questions(spark, d))


def declines(spark: SparkSession, d: str) -> DataFrame:
    """How often each decline is said."""
    route = routing.route(F.col("text"))
    return _questions(spark, d).where("text IS NOT NULL").groupBy(routing.decline(route).alias("said")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (question_routes, step_probes, named_source_questions, declines)}

_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_TABLE = lambda name, classes: f"{name}(class, place, keyword) AS (VALUES " + ", ".join(f"('{c}', {k}, '{w}')" for k, (c, ws) in enumerate(classes.items()) for w in ws) + ")"
_Q = rf"""q AS (SELECT doc_id AS query_id, upper(array_to_string(string_split(translate(text, chr(10), ' '), ' ')[1:12], ' ')) || ' ' || CASE WHEN doc_id % 5 > 0 THEN
    concat_ws(' ', '¿Qué:', {", ".join(f"{_list(_WORDS)}[CAST(doc_id * {k} % {len(_WORDS)} AS INTEGER) + 1]" for k in _STEPS)}, 'y más?') ELSE '' END AS text FROM documents),
f AS (SELECT query_id, text, trim(regexp_replace(lower(translate(text, '{T.MARKED}', '{T.PLAIN}')), '\s+', ' ', 'g')) AS folded FROM q),
{_TABLE("routes", routing.ROUTES)}, {_TABLE("families", routing.FAMILIES)},
hit AS (SELECT query_id, 'route' AS kind, class, place, count(*) AS n FROM f JOIN routes ON contains(folded, keyword) AND regexp_matches(folded, '(^|[^a-zA-Z0-9_])' || keyword || '([^a-zA-Z0-9_]|$)') GROUP BY ALL
  UNION ALL SELECT query_id, 'family', class, place, count(*) FROM f JOIN families ON contains(folded, keyword) AND regexp_matches(folded, '(^|[^a-zA-Z0-9_])' || keyword || '([^a-zA-Z0-9_]|$)') GROUP BY ALL),
best AS (SELECT query_id, arg_max(class, (n, -place)) FILTER (kind = 'route' AND place > 1) AS outside, coalesce(max(n) FILTER (kind = 'route' AND place = 0), 0) - coalesce(max(n) FILTER (kind = 'route' AND place = 1), 0) AS ahead,
  arg_max(class, (n, place)) FILTER (kind = 'family') AS family FROM hit GROUP BY query_id),
routed AS (SELECT f.query_id, CASE WHEN text IS NOT NULL THEN coalesce(outside, CASE WHEN ahead > 0 THEN 'hacienda' WHEN ahead < 0 THEN 'ccss' ELSE 'general' END) END AS route, family FROM f LEFT JOIN best USING (query_id))"""
_LINKS = lambda *names: " || chr(10) || ".join(f"'- {routing.INSTITUTIONS[n][0]}: {routing.INSTITUTIONS[n][1]}'" for n in names)
_NAMES = "institutions(class, institution, url) AS (VALUES " + ", ".join(f"('{k}', '{i}', '{u}')" for k, (i, u) in routing.INSTITUTIONS.items()) + ")"
_GAP = "chr(10) || chr(10)"
ORACLE = {
    "question_routes": f"WITH {_Q} SELECT * FROM routed",
    "step_probes": f"WITH {_Q} SELECT query_id, family, item_id AS place, md5(text) AS sentence FROM routed JOIN benchmark ON family = {_list(routing.FAMILIES)}[CAST(item_id % {len(routing.FAMILIES)} AS INTEGER) + 1] WHERE text IS NOT NULL",
    "named_source_questions": f"WITH {_Q} SELECT query_id, 'cabys-dev' AS doc_key FROM f WHERE regexp_matches(folded, '(^|[^a-zA-Z0-9_])cabys([^a-zA-Z0-9_]|$)')",
    "declines": f"""WITH {_Q}, {_NAMES} SELECT '{routing.OPENING}' || {_GAP} || CASE WHEN route = 'general' THEN '{routing.SOURCES}' || {_GAP} || {_LINKS("hacienda", "ccss")}
  ELSE CASE WHEN route IN ('hacienda', 'ccss') THEN '{routing.SOURCE}' WHEN route = 'contadores' THEN '{routing.FACTS["contadores"]}' || {_GAP} || '{routing.OUTSIDE.format(scope=routing.SCOPE)}' || {_GAP} || '{routing.COLLEGE}'
    ELSE 'Por el tema, la pregunta parece corresponder a ' || institution || ', que está fuera de lo que cubro: {routing.SCOPE}.' || {_GAP} || CASE WHEN route = 'mtss' THEN '{routing.FACTS["mtss"]}' || {_GAP} ELSE '' END || '{routing.SOURCE}' END
    || {_GAP} || '- ' || institution || ': ' || url END AS said, count(*) AS n FROM routed LEFT JOIN institutions ON class = route WHERE route IS NOT NULL GROUP BY 1""",
}
