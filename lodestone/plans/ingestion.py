"""Queries over gates before documents are replaced, and over kept exchanges.

Fixtures: chunks are those of ``plans.pins``; benchmark passages give facts and keep-lists, texts their own
digests, and turns are exchanges of seven users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import gates, layouts
from lodestone.plans import pins
from lodestone.session import table
from lodestone.sources import history

_KIND, _EVIDENCE = "CASE item_id % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'dated' ELSE 'overridden' END", "CASE item_id % 4 WHEN 0 THEN 'artículo' WHEN 1 THEN 'e t' ELSE 'de ' END"
_TEXT = "concat('Inicio', chr(10), text, CASE WHEN doc_id % 5 > 0 THEN concat(chr(10), 'Fin', chr(10), 'resto') ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), ' Fin ') ELSE '' END)"
_PIN = "CASE WHEN doc_id % 3 = 0 THEN sha2(concat(text, '!'), 256) WHEN doc_id % 11 = 1 THEN 'unknown' ELSE sha2(text, 256) END"


def evidence_gates(spark: SparkSession, d: str) -> DataFrame:
    chunks = pins._cases(spark, d).select("doc_key", "article", F.col("text").alias("content"))
    n = F.col("item_id")
    facts = table(spark, d, "benchmark").select(F.concat(F.lit("doc-"), (n % 27).cast("string")).alias("doc_key"), (n % 40).cast("string").alias("article"), F.expr(_KIND).alias("kind"), F.expr(_EVIDENCE).alias("evidence"))
    return gates.evidence_gate(chunks, facts.distinct())


def binary_pins(spark: SparkSession, d: str) -> DataFrame:
    """Documents as binaries against their digests, some of which have changed."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").withColumn("doc_key", F.col("doc_id").cast("string"))
    pinned = rows.where("doc_id % 7 > 0").select("doc_key", F.expr(_PIN).alias("sha256"))
    return gates.pinned_binaries(rows.select("doc_key", F.col("text").cast("binary").alias("content")), pinned, ["3", "9", "27"])


def _kept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = pins._cases(spark, d).select("doc_key", F.col("id").alias("n"), "article", F.array((F.col("id") % 2).cast("string")).alias("path"))
    n = F.col("item_id")
    keep = table(spark, d, "benchmark").select(F.concat(F.lit("doc-"), (n % 10).cast("string")).alias("doc_key"), F.concat(F.lit(" "), (n % 30).cast("string"), F.when(n % 4 == 0, "  bis").otherwise("")).alias("label"))
    return gates.kept_articles(chunks, keep)


def kept_articles(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d)[0].select("doc_key", "n", "article")


def keep_list_problems(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d)[1]


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Each text from its first line to the end mark, which some texts lack and some have twice."""
    texts = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.expr(_TEXT).alias("text"))
    slices = texts.select("doc_id", F.lit(0).alias("place"), F.lit("Inicio").alias("from"), F.lit(" Fin").alias("to"))
    return gates.excerpts(texts, slices).select("doc_id", F.md5("text").alias("text"), "problem")


def question_history(spark: SparkSession, d: str) -> DataFrame:
    """The exchanges of users 1 to 3, newest first, after each tenth was deleted by its owner and each other tenth by somebody else."""
    n = F.col("conv_id") * 100 + F.col("turn")
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit(" [1][9] [2]"))
    rows = table(spark, d, "conversations").select(n.alias("id"), (F.col("conv_id") % 7).alias("user_id"), (F.col("turn") % 4).alias("created_at"), F.col("role").alias("question"), F.lit(None).cast("string").alias("condensed"), answer.alias("answer"), F.array(F.lit("a"), F.lit("b")).alias("citations"))
    gone = rows.where("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"))
    listed = history.history(history.without(history.question_rows(rows), gone), spark.range(1, 4).withColumnRenamed("id", "user_id"))
    return listed.select("user_id", "pos", "id", F.md5("answer").alias("answer"))


def event_log_lines(spark: SparkSession, d: str) -> DataFrame:
    line = history.event_lines("ask:", "event_id", F.col("event_type").alias("outcome"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 9).alias("drops"))
    return table(spark, d, "events").select("event_id", line.alias("line"))


_WRAPPED = "CASE n % 6 WHEN 0 THEN concat('    Ventas de hasta 90% y más      ', n % 7, '%') WHEN 1 THEN '' WHEN 2 THEN '        sujetas' WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE concat('x', line) END ELSE line END"


def wrapped_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines with table rows whose left cell goes on behind a blank line, in every second document with nothing below."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return layouts.wrapped_rows(lines.select("doc_id", "n", F.expr(_WRAPPED).alias("line"))).select("doc_id", "n", F.md5("line").alias("line"))


_ROW = "concat(rpad('fila {0}', 12, ' '), rpad(concat(doc_id % 100, ',5%'), 12, ' '), rpad(concat(doc_id % 7, '%'), 9, ' '), '{0}')"
_GRID = f"concat('Antes: ', doc_id, chr(10), chr(10), 'Encabezado de esta tabla, que no parte columnas', chr(10), {_ROW.format(1)}, chr(10), {_ROW.format(2)}, chr(10), {_ROW.format(3)}, chr(10), chr(10), text)"


def grid_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts behind a table of four columns; every fourth text is said to have five."""
    labels = F.when(F.col("doc_id") % 4 > 0, F.array(*map(F.lit, "abcd"))).otherwise(F.array(*map(F.lit, "abcde")))
    # the text itself is parted by single blanks, so the table is the only grid
    rows = table(spark, d, "documents").where("text IS NOT NULL").withColumn("text", F.regexp_replace("text", r"[^\S\n]+", " "))
    return layouts.grid_texts(rows.select("doc_id", F.expr(_GRID).alias("text"), labels.alias("labels"))).select("doc_id", F.md5("text").alias("text"), "problem")


QUERIES = {f.__name__: f for f in (wrapped_rows, grid_texts, evidence_gates, binary_pins, kept_articles, keep_list_problems, excerpts, question_history, event_log_lines)}

_KEPT = f"""{pins._P}, l AS (SELECT doc_key, key, min(label) AS label, count(*) AS times FROM (SELECT 'doc-' || item_id % 10 AS doc_key, ' ' || item_id % 30 || CASE WHEN item_id % 4 = 0 THEN '  bis' ELSE '' END AS label, item_id % 30 || CASE WHEN item_id % 4 = 0 THEN ' bis' ELSE '' END AS key FROM benchmark) GROUP BY doc_key, key)"""
ORACLE = {
    "evidence_gates": f"""WITH {pins._P}, x AS (SELECT DISTINCT 'doc-' || item_id % 27 AS doc_key, '' || item_id % 40 AS article, {_KIND} AS kind, {_EVIDENCE} AS evidence FROM benchmark)
SELECT x.doc_key, x.article, kind, evidence, CASE WHEN count(p.id) = 0 THEN 'missing' WHEN NOT (CASE WHEN kind = 'overridden' THEN bool_or(coalesce(contains(text, evidence), false)) ELSE bool_and(coalesce(contains(text, evidence), false)) END) THEN 'lacking' END AS problem
FROM x LEFT JOIN p ON p.doc_key = x.doc_key AND p.article = x.article GROUP BY x.doc_key, x.article, kind, evidence""",
    "binary_pins": "SELECT '' || doc_id AS doc_key, sha256(text) AS sha256, CASE WHEN doc_id % 7 = 0 THEN 'unpinned' WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id IN (3, 9, 27) THEN 'accepted' ELSE 'changed' END WHEN doc_id % 11 = 1 THEN 'bad_pin' ELSE 'matches' END AS state FROM documents WHERE text IS NOT NULL",
    "kept_articles": f"WITH {_KEPT} SELECT doc_key, id AS n, article FROM p WHERE doc_key NOT IN (SELECT doc_key FROM l) OR EXISTS (FROM l WHERE l.doc_key = p.doc_key AND l.key = lower(p.article))",
    "keep_list_problems": f"""WITH {_KEPT}, f AS (SELECT doc_key, lower(article) AS key, count(DISTINCT id % 2) AS paths FROM p WHERE article IS NOT NULL GROUP BY ALL)
SELECT doc_key, label, CASE WHEN times > 1 THEN 'twice' WHEN paths IS NULL THEN 'nowhere' ELSE 'several_paths' END AS problem FROM l LEFT JOIN f USING (doc_key, key) WHERE times > 1 OR paths IS NULL OR paths > 1""",
    "excerpts": """WITH t AS (SELECT doc_id, text, CAST(doc_id % 5 > 0 AS INTEGER) + CAST(doc_id % 3 = 0 AS INTEGER) AS marks FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'Fin'))) AS other FROM t)
SELECT doc_id, CASE WHEN marks = 1 THEN md5('Inicio' || chr(10) || text) END AS text, CASE WHEN marks = 2 OR (marks = 0 AND other > 1) THEN 'to_ambiguous' WHEN marks = 0 AND other = 0 THEN 'to_nowhere' END AS problem FROM t JOIN l USING (doc_id)""",
    "question_history": """WITH r AS (SELECT conv_id * 100 + turn AS id, conv_id % 7 AS user_id, turn % 4 AS created_at, coalesce(text, '') || '[1][2]' AS answer FROM conversations WHERE (conv_id * 100 + turn) % 10 <> 0)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS pos, id, md5(answer) AS answer FROM r WHERE user_id BETWEEN 1 AND 3""",
    "event_log_lines": """SELECT event_id, 'ask: {"event_id":' || event_id || CASE WHEN event_type IS NOT NULL THEN ',"outcome":"' || event_type || '"' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN ',"drops":' || event_id % 9 ELSE '' END || '}' AS line FROM events""",
    "wrapped_rows": rf"""WITH x AS (SELECT doc_id, n, {_WRAPPED} AS line FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
y AS (SELECT *, lead(line, 2) OVER w IS NOT NULL AND n % 6 = 0 AND trim(coalesce(lead(line, 3) OVER w, '')) = '' AS fits FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
z AS (SELECT *, coalesce(lag(fits) OVER w, false) OR coalesce(lag(fits, 2) OVER w, false) AS taken FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY n))
SELECT doc_id, n, md5(CASE WHEN fits THEN '    Ventas de hasta 90% y más sujetas   ' || n % 7 || '%' ELSE line END) AS line FROM z WHERE NOT taken""",
    "grid_texts": rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '[\t\r\f\v \x{{a0}}]+', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN {_GRID} ELSE 'Antes: ' || doc_id || chr(10) || chr(10) || chr(10) || 'Columnas de la tabla: a | b | c | d.' || chr(10) || chr(10)
  || {" || ".join(f"'a: fila {k} | b: ' || doc_id % 100 || ',5% | c: ' || doc_id % 7 || '% | d: {k}.' || chr(10) || chr(10)" for k in (1, 2, 3))} || chr(10) || text END) AS text, CASE WHEN doc_id % 4 = 0 THEN 'no_grid' END AS problem FROM t""",
}
