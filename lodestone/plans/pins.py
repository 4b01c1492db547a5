"""Queries over pins: what is appended to an answer set after the cut.

Fixtures: twenty documents in order of id are the pool of a question, ranked by 7·id modulo 20, and the
first eight are its answer set. Labels, documents and parts are those of ``plans.answers``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import pins
from lodestone.plans import answers

#: (figure, kin, input, name, value, document)
INPUTS = [
    (1, "base", 1, "a", 100.0, "doc-1"), (1, "base", 2, "b", 0.13, "doc-7"), (2, "base", 1, "a", 250.0, "doc-4"), (2, "base", 2, "c", 2.5, "doc-12"),
    (3, None, 1, "d", 12.0, "doc-20"), (3, None, 2, "e", 7.0, "doc-2"), (4, None, 1, "d", 3.0, "doc-9"),
]
FORMULAS = {1: "a * b", 2: "(a + c) / 2", 3: "-d + e * 3", 4: "d"}
SERIES = "doc-3"
_MADE = """concat('Según el artículo ', doc_id % 40, ' y el monto de los Artículos 3, ', doc_id % 7, ', y 012 de esta Ley; la tasa del artículo ', doc_id % 11, ' inciso b) de la Ley N.º 6826. El porcentaje del ARTÍCULO ', doc_id % 13,
  ' bis (*) de este Reglamento, el artículo primero; artículos 5 al 9 y el artículo 7 de la Ley: ', text)"""


def _laws(spark: SparkSession) -> DataFrame:
    """Every even document regulates the next one; every fourth of these laws has the number that the texts name."""
    rows = spark.range(0, 25, 2)
    name = lambda k: F.concat(F.lit("doc-"), (k % 25).cast("string"))
    norma = F.when(F.col("id") % 4 == 0, "Ley 6826").otherwise("Ley 1234")
    return rows.select(name(F.col("id")).alias("doc_key"), name(F.col("id") + 1).alias("regulates"), F.lit("Ley General (texto vigente)").alias("title"), norma.alias("norma"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, id, rank, doc_key, article, part, text, withheld)."""
    rows = answers._chunks(spark, d).withColumn("article", T.article_key(F.col("label")))
    return rows.select(F.floor(F.col("doc_id") / 20).alias("query_id"), F.col("doc_id").alias("id"), (F.col("doc_id") * 7 % 20 + 1).alias("rank"), "doc_key", "article", "label", "part", F.expr(_MADE).alias("text"), (F.col("doc_id") % 17 == 0).alias("withheld"))


def _cut(cases: DataFrame) -> DataFrame:
    return cases.where("rank <= 8").select("query_id", "id", F.col("rank").alias("pos"))


def _inputs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INPUTS, "figure int, kin string, input int, name string, value double, doc_key string")


def article_references(spark: SparkSession, d: str) -> DataFrame:
    return pins.article_references(_cases(spark, d), _laws(spark)).select("id", "doc_key", "article", "figure", "pos")


def cross_reference_pin(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d)
    return pins.referenced(_cut(cases), cases, pins.article_references(cases, _laws(spark)))


def derived_input_pin(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d)
    return pins.derived_inputs(_cut(cases), cases, _inputs(spark))


def derived_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures that an answer set can resolve: their value and the places that are cited for it."""
    cases, inputs = _cases(spark, d), _inputs(spark)
    found = pins.resolved_figures(_cut(cases).join(cases.select("id", "doc_key"), "id"), inputs)
    value = F.lit(None).cast("double")
    for figure, said in FORMULAS.items():
        value = F.when(F.col("figure") == figure, pins.formula(said, {x[3] for x in INPUTS if x[0] == figure})).otherwise(value)
    return found.select("query_id", "figure", F.array_join(F.col("markers").cast("array<string>"), ",").alias("markers"), F.round(value, 6).alias("value"))


def series_pin(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d).withColumns({"triggers": F.col("id") % 11 == 0, "in_series": F.col("doc_key") == SERIES})
    cases = cases.withColumn("servable", F.col("in_series") & (F.col("id") % 4 > 0))
    newest = cases.where("servable").select("id", (F.col("id") % 50).alias("effective"))
    return pins.series_pin(cases.where("rank <= 8"), cases, newest)


def named_source_pin(spark: SparkSession, d: str) -> DataFrame:
    """Each question names two documents."""
    cases = _cases(spark, d)
    doc = lambda k: F.concat(F.lit("doc-"), (F.col("query_id") * k % 25).cast("string"))
    named = cases.select("query_id").distinct().select("query_id", F.posexplode(F.array(doc(3), doc(7))).alias("place", "doc_key"))
    return pins.named_sources(_cut(cases), cases, named)


def pinned_sets(spark: SparkSession, d: str) -> DataFrame:
    """Answer sets with the pins of all four kinds behind them."""
    kinds = [cross_reference_pin(spark, d), derived_input_pin(spark, d), series_pin(spark, d).where("id IS NOT NULL").select("query_id", "id", F.lit(1).alias("pos")), named_source_pin(spark, d)]
    rows = kinds[0].withColumn("kind", F.lit(pins.KINDS[0]))
    for kind, more in zip(pins.KINDS[1:], kinds[1:], strict=True):
        rows = rows.unionByName(more.withColumn("kind", F.lit(kind)))
    return pins.append_kinds(_cut(_cases(spark, d)), rows)


QUERIES = {f.__name__: f for f in (article_references, cross_reference_pin, derived_input_pin, derived_figures, series_pin, named_source_pin, pinned_sets)}

# -- the same in SQL -----------------------------------------------------------------------------

_fold = lambda x: rf"trim(regexp_replace(lower(translate({x}, '{T.MARKED}', '{T.PLAIN}')), '\s+', ' ', 'g'))"
_P = rf"""{answers._CHUNKS}, k AS (SELECT *, regexp_extract({answers._FOLDED}, {answers._KEY}, 1) AS number, regexp_extract({answers._FOLDED}, {answers._KEY}, 2) AS suffix FROM c),
p AS (SELECT doc_id // 20 AS query_id, doc_id AS id, doc_id * 7 % 20 + 1 AS rank, doc_key, CASE WHEN number <> '' THEN trim(CAST(CAST(number AS BIGINT) AS VARCHAR) || ' ' || upper(suffix)) END AS article,
    part, CASE WHEN text IS NOT NULL THEN {_MADE} END AS text, doc_id % 17 = 0 AS withheld FROM k),
i(figure, kin, input, name, value, doc_key) AS (VALUES {", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in x) + ")" for x in INPUTS)}),
g AS (SELECT * REPLACE (coalesce(kin, 'figure ' || figure) AS kin) FROM i)"""
# what the made sentences say, told from their numbers: place, article, words of an amount, and whose article it is
_REF = """r1 AS (SELECT id, doc_key, article AS own, CASE WHEN id % 25 % 2 = 0 THEN 'doc-' || ((id % 25 + 1) % 25) END AS regulates, id % 25 % 4 = 0 AS numbered FROM p WHERE text IS NOT NULL),
r2 AS (SELECT id, doc_key, own, regulates, numbered, unnest([
    {'spot': 1, 'article': '' || id % 40, 'figure': false, 'of': 'own'}, {'spot': 2, 'article': '3', 'figure': true, 'of': 'law'}, {'spot': 3, 'article': '' || id % 7, 'figure': true, 'of': 'law'},
    {'spot': 4, 'article': '12', 'figure': true, 'of': 'law'}, {'spot': 5, 'article': '' || id % 11, 'figure': true, 'of': 'numbered'}, {'spot': 6, 'article': id % 13 || ' BIS', 'figure': true, 'of': 'own'},
    {'spot': 7, 'article': '1', 'figure': true, 'of': 'own'}, {'spot': 8, 'article': '7', 'figure': false, 'of': 'regulated'}]) AS m FROM r1),
r3 AS (SELECT id, doc_key AS home, own, m.spot AS spot, m.article AS article, m.figure AS figure, CASE WHEN m.of = 'own' THEN doc_key ELSE coalesce(regulates, doc_key) END AS doc_key
  FROM r2 WHERE m.of IN ('own', 'law') OR (m.of = 'numbered' AND regulates IS NOT NULL AND numbered) OR (m.of = 'regulated' AND regulates IS NOT NULL)),
r4 AS (SELECT id, doc_key, article, bool_or(figure) AS figure, min(spot) AS spot FROM r3 WHERE NOT (doc_key = home AND own IS NOT DISTINCT FROM article) GROUP BY ALL),
r AS (SELECT id, doc_key, article, figure, CAST(row_number() OVER (PARTITION BY id ORDER BY spot) AS INTEGER) AS pos FROM r4)"""
_CROSS = f"""WITH {_P}, {_REF}, w AS (SELECT p.query_id, r.doc_key, r.article, bool_or(r.figure) AS figure, min((p.rank, r.pos)) AS place FROM p JOIN r USING (id) WHERE p.rank <= 8
        AND NOT EXISTS (FROM p h WHERE h.query_id = p.query_id AND h.rank <= 8 AND h.doc_key = r.doc_key AND h.article = r.article) GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY figure DESC, place, article) AS n FROM w),
    s AS (SELECT doc_key, article, any_value(id) AS id FROM p WHERE part = 0 AND article IS NOT NULL GROUP BY ALL HAVING count(*) = 1 AND NOT bool_or(withheld))
    SELECT query_id, arg_min(s.id, n) AS id, 1 AS pos FROM n JOIN s USING (doc_key, article) WHERE n <= 12 GROUP BY query_id"""
_DERIVED = f"""WITH {_P}, q AS (SELECT DISTINCT query_id FROM p), a AS (SELECT q.query_id, g.*, EXISTS (FROM p WHERE p.query_id = q.query_id AND p.doc_key = g.doc_key AND rank <= 8) AS held,
        (SELECT arg_min(id, rank) FROM p WHERE p.query_id = q.query_id AND p.doc_key = g.doc_key) AS id FROM q, g),
    b AS (SELECT *, bool_or(held) OVER (PARTITION BY query_id, kin) AS reached, bool_and(held OR id IS NOT NULL) OVER (PARTITION BY query_id, figure) AS whole FROM a)
    SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY spot, id) AS INTEGER) AS pos FROM (SELECT query_id, id, min((figure, input)) AS spot FROM b WHERE reached AND whole AND NOT held GROUP BY query_id, id)"""
_SERIES = f"""WITH {_P}, s AS (SELECT query_id, bool_or(rank <= 8 AND id % 11 = 0) AS t, bool_or(rank <= 8 AND doc_key = '{SERIES}') AS s, arg_min(id, rank) FILTER (doc_key = '{SERIES}' AND id % 4 > 0) AS pooled FROM p GROUP BY query_id HAVING bool_or(rank <= 8)),
    n AS (SELECT arg_max(id, (id % 50, -id)) AS newest FROM p WHERE doc_key = '{SERIES}' AND id % 4 > 0),
    o AS (SELECT *, CASE WHEN NOT t THEN 'not_triggered' WHEN s THEN 'already_in_set' WHEN coalesce(pooled, newest) IS NULL THEN 'missing' ELSE 'appended' END AS outcome FROM s, n)
    SELECT query_id, outcome, CASE WHEN outcome = 'appended' THEN coalesce(pooled, newest) END AS id FROM o"""
_NAMED = f"""WITH {_P}, d AS (SELECT DISTINCT query_id, f, 'doc-' || (query_id * f % 25) AS doc_key FROM p, (VALUES (3), (7)) v(f)),
    x AS (SELECT d.query_id, f, arg_min(p.id, p.rank) AS id FROM d JOIN p USING (query_id, doc_key) GROUP BY d.query_id, f, doc_key HAVING min(p.rank) > 8)
    SELECT query_id, arg_min(id, f) AS id, 1 AS pos FROM x GROUP BY query_id"""

ORACLE = {
    "article_references": f"WITH {_P}, {_REF} SELECT * FROM r",
    "cross_reference_pin": _CROSS,
    "derived_input_pin": _DERIVED,
    "derived_figures": f"""WITH {_P}, a AS (SELECT query_id, figure, input, min(rank) AS pos FROM p JOIN i USING (doc_key) WHERE rank <= 8 GROUP BY ALL),
        f AS (SELECT query_id, figure, array_to_string(list_sort(list_distinct(list(pos))), ',') AS markers FROM a GROUP BY query_id, figure HAVING count(*) = (SELECT count(*) FROM i WHERE i.figure = a.figure))
        SELECT *, CAST(CASE figure WHEN 1 THEN 13 WHEN 2 THEN 126.25 WHEN 3 THEN 9 WHEN 4 THEN 3 END AS DOUBLE) AS value FROM f""",
    "series_pin": _SERIES,
    "named_source_pin": _NAMED,
    "pinned_sets": f"""WITH a AS (SELECT *, 0 AS o FROM ({_CROSS}) UNION ALL SELECT *, 1 FROM ({_DERIVED}) UNION ALL SELECT query_id, id, 1, 2 FROM ({_SERIES}) WHERE id IS NOT NULL UNION ALL SELECT *, 3 FROM ({_NAMED})),
        t AS (SELECT doc_id // 20 AS query_id, doc_id AS id, doc_id * 7 % 20 + 1 AS pos FROM documents WHERE doc_id * 7 % 20 < 8),
        f AS (SELECT query_id, id, min((o, pos)) AS place, min(o) AS o FROM a ANTI JOIN t USING (query_id, id) GROUP BY query_id, id),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS n FROM f)
        SELECT query_id, id, pos, NULL::VARCHAR AS pin FROM t
        UNION ALL SELECT query_id, id, coalesce((SELECT max(pos) FROM t WHERE t.query_id = n.query_id), 0) + n, {list(pins.KINDS)}[o + 1] FROM n""",
}
