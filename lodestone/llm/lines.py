"""Line dedup by a log-template tree, in DataFrame functions only.

Method. A line is parsed to a fixed depth: its number of tokens, then its leading tokens, tokens with
digits generalised to ``<*>``. Below that leaf the line's tokens are three fields, of which one may
vary: a template is the leaf, two constant fields and the third generalised, so that lines of the
same template share at least two thirds of their tokens in place; shorter lines are templates by all
their tokens. Every line that isn't blank is looked at. A template that recurs in ``min_docs``
documents is boilerplate, and one of more than ``LONG_TOKENS`` tokens from ``LONG_DOCS`` documents on,
since so long a passage isn't repeated by chance: its lines are dropped from every document but the
first (the smallest id), so what it says is kept once.

Lines that recur within one document only stay. Null texts stay null; empty texts and blank lines stay
as they are. Rows that share an id count as one document, but each loses its own lines only; repeated
rows get the same result, and rows under a null id are one document that is never the first where
another has the template. A document may lose all its lines; its text is then empty. An empty table
gives no rows; columns whose names begin with two underscores are the operator's own. Only 64-bit keys
of templates are shuffled for the counts; one very common template is a single row after the map-side
sums, and the join back is a plain equi-join of two stored tables, so adaptive execution can split its
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialize, table

#: Leading tokens of the tree, tokens from which a field may vary, and the documents that make a template recur.
DEPTH, FIELDS_FROM, MIN_DOCS = 3, 6, 3
#: The tokens above which fewer documents are enough, and how many.
LONG_TOKENS, LONG_DOCS = 50, 2


def tokens_of(line: Column) -> Column:
    """Tokens between white space, those with digits as ``<*>``; a blank line has one empty token."""
    plain = F.trim(F.when(line.rlike(r"[\t\r\f\x0b]|  "), F.regexp_replace(line, r"[\t\r\f\x0b ]+", " ")).otherwise(line))
    return F.split(F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"(?<![^ ])[^ ]*?[0-9][^ ]*", "<*>")).otherwise(plain), " ", -1)


def template_keys(tokens: Column) -> Column:
    """Keys of the templates that a line may belong to; a blank line has none. Keys are odd for more than ``LONG_TOKENS`` tokens and else even."""
    n = F.size(tokens)
    first, second = F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int")
    fields = [F.slice(tokens, 1, first), F.slice(tokens, first + 1, second - first), F.slice(tokens, second + 1, n - second)]
    leaf = [n, F.slice(tokens, 1, DEPTH)]
    varying = F.array(*(F.xxhash64(*leaf, F.lit(k), *(f for j, f in enumerate(fields) if j != k)) for k in range(3)))
    found = F.when(n >= FIELDS_FROM, varying).when(F.get(tokens, 0) != "", F.array(F.xxhash64(*leaf, tokens))).otherwise(F.array().cast("array<bigint>"))
    odd = F.when(n > LONG_TOKENS, 1).otherwise(0).cast("bigint")
    return F.transform(found, lambda key: key.bitwiseAND(F.lit(-2)).bitwiseOR(odd))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, hash, dropped): the numbers (from 0) of the lines that go, for each id and text that loses any."""
    lines = F.split(F.col(text_col), "\n", -1)
    keyed = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("hash"), F.transform(F.transform(lines, tokens_of), template_keys).alias("lines"))
    keyed = materialize(keyed)
    in_document = keyed.select("doc", F.explode(F.array_distinct(F.flatten("lines"))).alias("key")).distinct()
    recurring = in_document.groupBy("key").agg(F.count("*").alias("docs"), F.min("doc").alias("first"))
    needed = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, LONG_DOCS).otherwise(min_docs)
    recurring = materialize(recurring.where((F.col("docs") >= needed) & F.col("first").isNotNull()).select("key", "first"))
    placed = keyed.select("doc", "hash", F.posexplode("lines").alias("line", "keys")).select("doc", "hash", "line", F.explode("keys").alias("key"))
    # the recurring keys and the cut documents grow with the input, so they are never broadcast
    again = placed.join(recurring.hint("merge"), "key").where(~F.col("doc").eqNullSafe(F.col("first")))
    return again.groupBy("doc", "hash").agg(F.collect_set("line").alias("dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text cut, and ``__n_lines`` and ``__n_dropped``."""
    drops = materialize(dropped_lines(docs, min_docs, id_col, text_col).select(F.col("doc").alias("__doc"), F.col("hash").alias("__hash"), F.col("dropped").alias("__dropped")))
    # the hash of the text comes first: an id that many rows share is no hot key
    rows = docs.join(drops.hint("merge"), (F.xxhash64(F.col(text_col)) == F.col("__hash")) & F.col(id_col).eqNullSafe(F.col("__doc")), "left")
    # the lines are a column of their own, or else a text would be split again for each of its lines
    rows = rows.withColumn("__lines", F.split(F.col(text_col), "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__dropped"))
    cut = F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    size = lambda array: F.when(F.col(array).isNull(), 0).otherwise(F.size(array)).cast("long")
    return rows.withColumns({"__n_lines": size("__lines"), "__n_dropped": size("__dropped"), text_col: cut}).drop("__doc", "__hash", "__lines", "__dropped")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without recurring lines: doc_id, n_lines, n_dropped, text."""
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text")


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM d),
t AS (SELECT r, doc_id, i, string_split(regexp_replace(trim(regexp_replace(line, '[\\t\\r\\f\\x0b ]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS t FROM l),
f AS (SELECT r, doc_id, i, t, len(t) AS n, len(t) // 3 AS a, len(t) * 2 // 3 AS b FROM t WHERE t[1] <> ''),
k AS (SELECT r, doc_id, i, unnest(CASE WHEN n >= {FIELDS_FROM} THEN [
    {{'n': n, 'lead': t[1:{DEPTH}], 'k': 0, 'x': t[a+1:b], 'y': t[b+1:n]}},
    {{'n': n, 'lead': t[1:{DEPTH}], 'k': 1, 'x': t[1:a], 'y': t[b+1:n]}},
    {{'n': n, 'lead': t[1:{DEPTH}], 'k': 2, 'x': t[1:a], 'y': t[a+1:b]}}]
  ELSE [{{'n': n, 'lead': t[1:{DEPTH}], 'k': 3, 'x': t, 'y': []}}] END) AS key FROM f),
c AS (SELECT key, min(doc_id) AS first FROM (SELECT DISTINCT key, doc_id FROM k) GROUP BY key HAVING count(*) >= CASE WHEN key.n > {LONG_TOKENS} THEN {LONG_DOCS} ELSE {MIN_DOCS} END),
x AS (SELECT DISTINCT k.r, k.i FROM k JOIN c USING (key) WHERE k.doc_id IS DISTINCT FROM c.first),
g AS (SELECT r, list(i) AS dropped FROM x GROUP BY r)
SELECT d.doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.dropped), 0) AS BIGINT) AS n_dropped,
  CASE WHEN g.dropped IS NULL THEN d.text
       ELSE array_to_string(list_filter(d.lines, lambda s, i: NOT list_contains(g.dropped, i - 1)), chr(10)) END AS text
FROM d LEFT JOIN g USING (r)
"""
