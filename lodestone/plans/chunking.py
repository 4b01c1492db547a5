"""Queries that cut documents into labelled chunks.

Fixture: the lines of a document are the paragraphs of a law; line n gets a heading, an article or a
sentence that only looks like one, by (doc_id + n) modulo 9.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunks
from lodestone.session import table

_MADE = """CASE (doc_id + n) % 9 WHEN 0 THEN 'TÍTULO I. DE LOS SUJETOS' WHEN 1 THEN concat('CAPÍTULO ', n + 2) WHEN 2 THEN 'Sección Única: De la base' WHEN 3 THEN concat('ARTÍCULO ', n, ' BIS.- ', line)
  WHEN 4 THEN concat('Artículo 25 del presente Reglamento. ', line) WHEN 5 THEN concat('Transitorio IV.- ', line) WHEN 6 THEN concat('Título I, a un nuevo marco ', line) WHEN 7 THEN concat(line, ' Artículo 8- ', line) ELSE line END"""
_LAWS = "doc_id % 10 > 0"  # every tenth document has no structure


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    made = F.when(F.expr(_LAWS), F.expr(_MADE)).otherwise(F.col("line"))
    cut = lines.select("doc_id", "n", F.posexplode(chunks.split_inline(made)).alias("k", "p"))
    return cut.select("doc_id", (F.col("n") * 1000 + F.col("k")).alias("n"), "p")


def heading_grammar(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs by what they open."""
    p = F.col("p")
    rows = _paragraphs(spark, d).select("doc_id", chunks.heading_level(p).alias("level"), chunks.article_label(p).alias("label"))
    return rows.groupBy("doc_id", "level", "label").agg(F.count("*").alias("n"))


def inline_headings(spark: SparkSession, d: str) -> DataFrame:
    return _paragraphs(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("chars"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return chunks.labelled_parts(chunks.structural_chunks(_paragraphs(spark, d)), F.concat(F.lit("Ley "), F.col("doc_id").cast("string")))


def structural_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d)
    return rows.select("doc_id", "chunk", "label", F.array_join("path", "|").alias("path"), "part", F.md5("content").alias("digest"))


_FRONT = """CASE n WHEN 0 THEN 'Ley de prueba' WHEN 1 THEN CASE doc_id % 4 WHEN 0 THEN 'Considerando: que' WHEN 1 THEN 'Con' WHEN 2 THEN 'Visto' ELSE 'En uso de las facultades' END
  WHEN 2 THEN CASE doc_id % 4 WHEN 1 THEN concat('fundamento en las leyes, ', line) ELSE line END WHEN 3 THEN 'el artículo 5 dispone: nada' WHEN 4 THEN 'Por tanto, DECRETAN:' WHEN 5 THEN concat('Artículo 1.- ', line) ELSE line END"""


def preambles(spark: SparkSession, d: str) -> DataFrame:
    """Recitals of documents of six lines and more; two of four open by words, the others by a long sentence or not at all."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return chunks.preambles(lines.select("doc_id", "n", F.expr(_FRONT).alias("p"))).select("doc_id", F.md5("body").alias("body"))


def fixed_label_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents without articles of their own: one label for all parts."""
    body = F.trim(F.array_join(F.split("text", "\n", -1), " "))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.lit(0).alias("chunk"), F.lit("Acta").alias("label"), F.array().cast("array<string>").alias("path"), body.alias("body"))
    rows = chunks.labelled_parts(rows, F.concat(F.lit("Ley "), F.col("doc_id").cast("string")))
    return rows.select("doc_id", "part", F.md5("content").alias("digest"))


def chunk_content(spark: SparkSession, d: str) -> DataFrame:
    """Documents that gave no chunk, or none with text of its own."""
    return chunks.carries_content(table(spark, d, "documents"), _parts(spark, d))


QUERIES = {f.__name__: f for f in (heading_grammar, inline_headings, structural_chunks, preambles, fixed_label_chunks, chunk_content)}

# -- the same in SQL -----------------------------------------------------------------------------

_CAPTION = f"trim(regexp_extract(p, '{chunks.HEADING}', 2))"
_WORDS = rf"len(regexp_split_to_array({_CAPTION}, '\s+'))"
_P = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, n, string_split(regexp_replace(CASE WHEN {_LAWS} THEN {_MADE} ELSE line END, '(.)({chunks.INLINE})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM l),
f AS (SELECT doc_id, n, list_filter(list_transform(ps, lambda x: trim(x)), lambda x: x <> '') AS ps FROM m),
p AS (SELECT doc_id, n * 1000 + generate_subscripts(ps, 1) - 1 AS n, unnest(ps) AS p FROM f),
g AS (SELECT *, coalesce(nullif(regexp_extract(p, '{chunks.ARTICLE}', 1), ''), nullif(regexp_extract(p, '{chunks.TRANSITORY}', 1), '')) AS label,
    CASE WHEN regexp_matches(p, '{chunks.HEADING}') AND ({_CAPTION} = '' OR (regexp_matches({_CAPTION}, '^[A-ZÁÉÍÓÚÑÜ]') AND CASE WHEN regexp_matches({_CAPTION}, '[a-záéíóúñü]')
        THEN {_WORDS} <= 20 AND NOT regexp_matches({_CAPTION}, '{chunks.DANGLING}') ELSE {_WORDS} <= 40 END)) THEN CAST(position(upper(p[1]) IN 'TCS') - 1 AS INTEGER) END AS level FROM p)"""
_CUT = lambda w, source: f"SELECT *, string_split(body, ' ') AS {w}, unnest(range(0, 1 + CAST(ceil(greatest(0, len(string_split(body, ' ')) - 1000) / 900) AS BIGINT))) AS part FROM {source} WHERE trim(body) <> ''"
_SLICE = "array_to_string(w[part * 900 + 1 : part * 900 + 1000], ' ')"
_PARTS = f"""{_P}, e AS (SELECT *, level IS NOT NULL OR label IS NOT NULL AS edge, max(CASE WHEN level = 0 THEN n END) OVER s AS n0, max(CASE WHEN level = 1 THEN n END) OVER s AS n1, max(CASE WHEN level = 2 THEN n END) OVER s AS n2 FROM g WINDOW s AS (PARTITION BY doc_id ORDER BY n)),
c AS (SELECT *, sum(edge::INTEGER) OVER (PARTITION BY doc_id ORDER BY n) AS chunk, sum(edge::INTEGER) OVER (PARTITION BY doc_id) AS edges FROM e),
h AS (SELECT c.*, t.p AS p0, CASE WHEN n1 > coalesce(n0, -1) THEN k.p END AS p1, CASE WHEN n2 > greatest(coalesce(n0, -1), coalesce(n1, -1)) THEN x.p END AS p2
    FROM c LEFT JOIN p t ON t.doc_id = c.doc_id AND t.n = n0 LEFT JOIN p k ON k.doc_id = c.doc_id AND k.n = n1 LEFT JOIN p x ON x.doc_id = c.doc_id AND x.n = n2 WHERE level IS NULL AND (chunk > 0 OR edges = 0)),
b AS (SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, max(label) AS label, any_value(concat_ws('|', p0, p1, p2)) AS path, string_agg(p, ' ' ORDER BY n) AS body FROM h GROUP BY ALL),
q AS ({_CUT("w", "b")}), r AS (SELECT doc_id, chunk, label, coalesce(path, '') AS path, CAST(part AS INTEGER) AS part,
    '[' || concat_ws(' — ', 'Ley ' || doc_id, nullif(replace(path, '|', ' — '), ''), label) || '] ' || {_SLICE} AS content FROM q)"""

ORACLE = {
    "heading_grammar": f"WITH {_P} SELECT doc_id, level, label, count(*) AS n FROM g GROUP BY ALL",
    "inline_headings": f"WITH {_P} SELECT doc_id, count(*) AS n, CAST(sum(length(p)) AS BIGINT) AS chars FROM p GROUP BY doc_id",
    "structural_chunks": f"WITH {_PARTS} SELECT doc_id, chunk, label, path, part, md5(content) AS digest FROM r",
    "fixed_label_chunks": f"""WITH b AS (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS body FROM documents WHERE text IS NOT NULL), q AS ({_CUT("w", "b")})
        SELECT doc_id, CAST(part AS INTEGER) AS part, md5('[Ley ' || doc_id || ' — Acta] ' || {_SLICE}) AS digest FROM q""",
    "chunk_content": rf"""WITH {_PARTS}, y AS (SELECT doc_id, count(*) AS parts, bool_or(trim(regexp_replace(content, '^\[[^\]]*\]\s*', '')) <> '') AS carries FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(parts, 0) AS parts, CASE WHEN parts IS NULL THEN 'no_chunks' WHEN NOT carries THEN 'only_headers' END AS problem FROM documents LEFT JOIN y USING (doc_id)""",
    "preambles": rf"""WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
f AS (SELECT doc_id, string_agg({_FRONT}, ' ' ORDER BY n) FILTER (n < 4) || ' Por tanto,' AS r FROM l GROUP BY doc_id HAVING max(n) >= 5),
g AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN substr(r, length('Ley de prueba ') + 1) WHEN 1 THEN substr(r, length('Ley de prueba ') + 1) WHEN 3 THEN substr(r, length('Ley de prueba ') + 1) WHEN 2 THEN CASE WHEN regexp_matches(r, '{chunks.RECITAL_PROSE}') THEN r END END AS body FROM f)
SELECT doc_id, md5(body) AS body FROM g WHERE body IS NOT NULL""",
}
