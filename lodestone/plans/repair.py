"""Queries over the repair of extracted texts.

Fixtures: a document's lines are the nodes of a page; by number they count as flagged, unchecked or checked,
and every fourth line lacks the blank behind «de» and «la».
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunks, fragments, words
from lodestone.session import table

_LINE = "CASE WHEN n % 4 = 1 THEN replace(replace(line, ' de ', ' de'), ' la ', ' la') ELSE line END"
_PROOFING = "CASE (doc_id + n) % 3 WHEN 0 THEN 'flagged' WHEN 1 THEN 'unchecked' ELSE 'checked' END"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.select(F.col("doc_id").alias("doc"), F.col("n").alias("node"), F.lit("").alias("part"), F.expr(_LINE).alias("text"), F.expr(_PROOFING).alias("proofing"), (F.col("n") % 5 == 0).alias("grammar"))


def joined_words(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that their document's own usage splits in two."""
    return words.joined_words(_nodes(spark, d))


def repaired_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line with its joined words split and, where it was complained about, its punctuation spaced."""
    return words.repaired_nodes(_nodes(spark, d)).select("doc", "node", F.md5("fixed").alias("fixed"))


_FRAGMENT = """CASE n % 12 WHEN 0 THEN 'ARTÍCULO' WHEN 1 THEN concat(n, '.- ', line) WHEN 2 THEN 'Artículo 64' WHEN 3 THEN concat('bis.—', line) WHEN 4 THEN 'CAPÍTULO' WHEN 5 THEN 'III' WHEN 6 THEN 'De los saldos a favor y del'
  WHEN 7 THEN 'impuesto general' WHEN 8 THEN concat('Artículo 7.- ', line) WHEN 10 THEN 'TÍTULO II' ELSE line END"""
_QUESTION = """CASE WHEN doc_id % 10 = 0 THEN line ELSE CASE n % 21 WHEN 0 THEN 'Pagos y plazos' WHEN 1 THEN concat('1. ¿', line, '?') WHEN 3 THEN concat('2. Si pasa, ¿', line, '?') WHEN 5 THEN '¿Otra cosa?' WHEN 6 THEN '4. ¿Cuál?'
  WHEN 10 THEN '12 Trámites 5. ¿Dónde?' WHEN 11 THEN 'Declaraciones y Pagos' WHEN 15 THEN 'Otra parte' WHEN 16 THEN '1. ¿De nuevo?' ELSE line END END"""
#: Questions that a list has at least.
MINIMUM = 3


def _made(spark: SparkSession, d: str, said: str) -> DataFrame:
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.select("doc_id", "n", F.expr(said).alias("p"))


def joined_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Lines of which articles, suffixes, headings and captions were cut off, together again."""
    return fragments.joined_fragments(_made(spark, d, _FRAGMENT)).select("doc_id", "n", F.md5("p").alias("p"))


def question_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Numbered questions with their answers, under their sections."""
    found = fragments.question_chunks(_made(spark, d, _QUESTION))
    return found.select("doc_id", "section", "number", F.col("chunk").cast("int").alias("chunk"), F.md5("body").alias("body"))


def too_few_questions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return fragments.too_few_questions(docs, fragments.question_chunks(_made(spark, d, _QUESTION)), MINIMUM)


QUERIES = {f.__name__: f for f in (joined_words, repaired_lines, joined_fragments, question_chunks, too_few_questions)}


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_JOINS = rf"""
n AS (SELECT doc_id AS doc, n, {_LINE} AS text, {_PROOFING} AS proofing, n % 5 = 0 AS grammar FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
t AS (SELECT doc, n, proofing, grammar, unnest(w) AS token, generate_subscripts(w, 1) AS k FROM (SELECT *, regexp_extract_all(text, '{words.WORD}') AS w FROM n)),
l AS (SELECT *, lower(token) AS low, regexp_matches(token, '{words.CAPITALS}') AS caps FROM t),
uses AS (SELECT doc, low, count(*) AS uses, count(*) FILTER (proofing = 'checked' AND NOT grammar AND NOT caps) AS words FROM l GROUP BY ALL),
pairs AS (SELECT doc, a, b, count(*) AS score FROM (SELECT doc, low AS a, lead(low) OVER (PARTITION BY doc ORDER BY n, k) AS b FROM l) WHERE b IS NOT NULL GROUP BY ALL),
asked AS (SELECT DISTINCT doc, token, low, proofing, CASE WHEN proofing <> 'flagged' AND caps THEN 'unchecked' ELSE proofing END AS read FROM l WHERE NOT contains(low, '-')),
cut AS (SELECT *, substr(low, 1, at_) AS a, substr(low, at_ + 1) AS b FROM (SELECT a.*, u.uses, u.words, unnest(range(1, length(token))) AS at_ FROM asked a JOIN uses u USING (doc, low) WHERE length(token) > 1)),
said AS (SELECT *, list_position({_list(words.FUNCTION_WORDS)}, a) AS fa, list_position({_list(words.FUNCTION_WORDS)}, b) AS fb, length(a) AS la, length(b) AS lb FROM cut),
kinds AS (SELECT *, fa IS NOT NULL AND la > 1 AND (lb >= 4 OR (lb > 1 AND fb IS NOT NULL)) AND b NOT IN {_list(words.INTERROGATIVES)} AS opens, fb IS NOT NULL AND lb > 1 AND la >= 4 AND b NOT IN {_list(words.ENCLITICS)} AS closes,
  fa IS NOT NULL AND fb IS NOT NULL AS two,
  read = 'flagged' AND words = 0 AND b NOT IN {_list(words.INTERROGATIVES)} AND (fa IS NOT NULL OR (fb IS NOT NULL AND b NOT IN {_list(words.ENCLITICS)}) OR (la >= 4 AND lb >= 4 AND a NOT IN {_list(words.PREFIXES)})) AS vocabulary FROM said),
held AS (SELECT k.*, (opens OR closes) AND k.low NOT IN {_list(words.NOT_JOINS)} AND (read <> 'checked' OR two) AS phrase, least(CASE WHEN opens THEN fa * 2 END, CASE WHEN closes THEN fb * 2 + 1 END) AS turn,
  coalesce(p.score, 0) AS score, nullif(x.words, 0) AS wa, nullif(y.words, 0) AS wb
  FROM kinds k LEFT JOIN pairs p ON p.doc = k.doc AND p.a = k.a AND p.b = k.b LEFT JOIN uses x ON x.doc = k.doc AND x.low = k.a LEFT JOIN uses y ON y.doc = k.doc AND y.low = k.b WHERE vocabulary OR opens OR closes),
best AS (SELECT doc, token, proofing, read, words,
  arg_max(at_, (least(coalesce(wa, 1000000000), coalesce(wb, 1000000000)), -at_)) FILTER (vocabulary AND CASE WHEN la = 1 THEN a IN {_list(words.ONE_LETTER)} ELSE wa IS NOT NULL END AND CASE WHEN lb = 1 THEN b IN {_list(words.ONE_LETTER)} ELSE wb IS NOT NULL END) AS by_words,
  arg_max({{'at_': at_, 'two': two}}, (score, -turn)) FILTER (phrase AND score >= CASE read WHEN 'flagged' THEN 2 ELSE 3 END AND (uses <= CASE read WHEN 'flagged' THEN 2 ELSE 0 END OR score >= CASE read WHEN 'flagged' THEN 5 ELSE 3 END * uses)) AS by_phrase
  FROM held GROUP BY ALL),
chosen AS (SELECT *, coalesce(by_words, CASE WHEN NOT (read = 'unchecked' AND words > 0 AND NOT by_phrase.two) THEN by_phrase.at_ END) AS at_, regexp_extract(token, '^(.[^\p{{Lu}}]*)\p{{Lu}}', 1) AS head FROM best),
joins AS (SELECT doc, token, proofing, substr(token, 1, at_) || ' ' || substr(token, at_ + 1) AS split FROM chosen
  WHERE at_ IS NOT NULL AND (NOT (regexp_matches(substr(token, 2), '\p{{Lu}}') AND NOT regexp_matches(token, '^\p{{Lu}}+$')) OR (regexp_matches(head, '^\p{{Ll}}+$') AND head IN {_list(words.FUNCTION_WORDS)} AND length(head) = at_)))"""
# without look-behind: a mark between letters is put back with both of them, twice, as neighbouring marks share a letter
_SPACED = r"""regexp_replace(regexp_replace(regexp_replace(text, '(\p{L})([,;])(\p{L})', '\1\2 \3', 'g'), '(\p{L})([,;])(\p{L})', '\1\2 \3', 'g'), '(\p{Ll})\.(\p{Lu})', '\1. \2', 'g')"""
ORACLE = {
    "joined_words": f"WITH {_JOINS} SELECT * FROM joins",
    "repaired_lines": rf"""WITH {_JOINS}, m AS (SELECT doc, proofing, map_from_entries(list((token, split))) AS splits FROM joins GROUP BY ALL),
s AS (SELECT n.doc, n.n, splits, CASE WHEN n.proofing = 'flagged' OR grammar THEN {_SPACED} ELSE text END AS text FROM n LEFT JOIN m USING (doc, proofing))
SELECT doc, n AS node, md5(CASE WHEN splits IS NULL THEN text ELSE array_to_string(list_transform(regexp_extract_all(text, '(?s){words.TOKEN}|.'), lambda x: CASE WHEN regexp_matches(x, '[@/.]') THEN x ELSE coalesce(splits[x], x) END), '') END) AS fixed FROM s""",
}
_LINES = "SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)"
# what the made lines call for, told by their numbers; only the line behind «TÍTULO II» is looked at
ORACLE["joined_fragments"] = rf"""WITH x AS (SELECT doc_id, n, line, {_FRAGMENT} AS p FROM ({_LINES})),
y AS (SELECT *, n % 12 AS j, lead(p) OVER w AS p1, lead(p, 2) OVER w AS p2, lead(p, 3) OVER w AS p3 FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
z AS (SELECT *, j = 10 AND p1 IS NOT NULL AND NOT (regexp_matches(p1, '[a-záéíóúñü]') AND regexp_matches(p1, '[.:;]')) AND regexp_matches(p1, '^[A-ZÁÉÍÓÚÑÜ]')
  AND CASE WHEN regexp_matches(p1, '[a-záéíóúñü]') THEN len(string_split_regex(p1, '\s+')) <= 20 AND NOT regexp_matches(p1, '{chunks.DANGLING}') ELSE len(string_split_regex(p1, '\s+')) <= 40 END AS owned FROM y),
g AS (SELECT *, lag(owned) OVER (PARTITION BY doc_id ORDER BY n) AS taken FROM z)
SELECT doc_id, n, md5(CASE WHEN j IN (0, 2) AND p1 IS NOT NULL THEN p || ' ' || p1 WHEN j = 4 AND p3 IS NOT NULL THEN p || ' ' || p1 || ' ' || p2 || ' ' || p3 WHEN j = 4 AND p1 IS NOT NULL THEN p || ' ' || p1 WHEN owned THEN p || ' ' || p1 ELSE p END) AS p
FROM g WHERE j NOT IN (1, 3, 5) AND NOT (j IN (6, 7) AND EXISTS (FROM g e WHERE e.doc_id = g.doc_id AND e.n = g.n - g.j + 7)) AND NOT (j = 11 AND coalesce(taken, false))"""
_ASKS = r"(\d{1,3})\.\s+(?:¿|[^.?!]{1,180}¿)"
_NAME = lambda x: rf"CASE WHEN trim(regexp_replace({x}, '{fragments.PAGE_NUMBER}', '')) <> '' AND len(string_split_regex(trim(regexp_replace({x}, '{fragments.PAGE_NUMBER}', '')), '\s+')) <= 12 AND NOT regexp_matches(trim(regexp_replace({x}, '{fragments.PAGE_NUMBER}', '')), '[.!?¿:;]') THEN replace(trim(regexp_replace({x}, '{fragments.PAGE_NUMBER}', '')), 'Declaraciones y Pagos', 'Declaraciones del RUT') END"
_ASKED = rf"""a AS (SELECT doc_id, n, trim({_QUESTION}) AS p FROM ({_LINES})),
b AS (SELECT *, nullif(regexp_extract(p, '(?:^|\s){_ASKS}', 1), '') AS number, regexp_extract(p, '(?s)^(|.*?\s){_ASKS}', 1) AS head FROM a),
c AS (SELECT *, lead(number) OVER (PARTITION BY doc_id ORDER BY n) AS next FROM b),
d AS (SELECT *, CASE WHEN number IS NULL AND next IS NOT NULL THEN {_NAME("p")} END AS alone, CASE WHEN number IS NOT NULL THEN {_NAME("head")} END AS named FROM c WHERE p <> ''),
e AS (SELECT *, number IS NOT NULL AND (named IS NOT NULL OR coalesce(bool_or(coalesce(alone, named) IS NOT NULL) OVER w, false)) AS accepted FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, coalesce(bool_or(accepted) OVER w, false) AS counting, last_value(CASE WHEN accepted THEN CAST(number AS INTEGER) END IGNORE NULLS) OVER w AS last FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN alone IS NOT NULL AND (NOT counting OR next = '1') THEN alone WHEN accepted THEN named END AS opens FROM f),
h AS (SELECT *, counting AND number IS NULL AND opens IS NULL AND regexp_matches(p, '{fragments.UNNUMBERED}') AND coalesce(CAST(next AS INTEGER) = last + 2, false) AS inferred FROM g),
i AS (SELECT *, accepted OR inferred AS starts, sum(CAST(accepted OR inferred AS INTEGER)) OVER w AS chunk, last_value(opens IGNORE NULLS) OVER w AS section FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, max(CASE WHEN starts THEN section END) AS section, max(CASE WHEN accepted THEN CAST(number AS INTEGER) WHEN inferred THEN last + 1 END) AS number,
  md5(trim(string_agg(CASE WHEN accepted THEN trim(substr(p, length(head) + 1)) WHEN starts THEN p ELSE trim(regexp_replace(p, '{fragments.PAGE_NUMBER}', '')) END, ' ' ORDER BY n))) AS body FROM i WHERE chunk > 0 AND (starts OR opens IS NULL) GROUP BY ALL)"""
ORACLE["question_chunks"] = f"WITH {_ASKED} SELECT * FROM k"
ORACLE["too_few_questions"] = f"WITH {_ASKED} SELECT documents.doc_id, count(k.chunk) AS found FROM documents LEFT JOIN k USING (doc_id) GROUP BY documents.doc_id HAVING count(k.chunk) < {MINIMUM}"
