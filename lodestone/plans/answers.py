"""Queries over answers and their sources: labels, markers, citations, context, targets and selections.

Fixtures: a document stands for a chunk, with a label made from its id; a benchmark item for a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import fusion, targets
from lodestone.plans import retrieval
from lodestone.session import materialize, table

# The viewer that a versioned law is shown in.
VIEWER = "https://sinalevi.go.cr/ResultadosNormativa/Informacion"
#: Minutes that an account must be old.
ACCOUNT_MINUTES = 90

_LABEL = """CASE doc_id % 7 WHEN 0 THEN concat('Artículo ', doc_id % 40, ' bis') WHEN 1 THEN concat('ARTICULO  ', doc_id % 40, '°') WHEN 2 THEN concat('artículo ', doc_id % 40)
  WHEN 3 THEN concat('Transitorio ', doc_id % 40) WHEN 4 THEN concat('Artículo 0', doc_id % 40, '.º ter') WHEN 5 THEN concat('Artículo ', doc_id % 40, '°, sesión 9') ELSE NULL END"""
_CHUNKS = f"c AS (SELECT doc_id, concat('doc-', doc_id % 25) AS doc_key, {_LABEL} AS label, source, n_chars, lang, text, doc_id % 3 AS part FROM documents)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, doc_key, label, source, n_chars, lang, text, part)."""
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.concat(F.lit("doc-"), (F.col("doc_id") % 25).cast("string")).alias("doc_key"), F.expr(_LABEL).alias("label"), "source", "n_chars", "lang", "text", (F.col("doc_id") % 3).alias("part"))


def article_keys(spark: SparkSession, d: str) -> DataFrame:
    """The number that a reference to a label would name, or null."""
    return _chunks(spark, d).select("doc_id", "label", T.article_key(F.col("label")).alias("article_key"))


def text_guard(spark: SparkSession, d: str) -> DataFrame:
    """Turns that may not be stored: NUL in the text (every eleventh conversation gets one)."""
    text = F.when(F.col("conv_id") % 11 == 0, F.concat("text", F.lit("\u0000"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.contains(text, F.lit("\u0000")), F.lit(False)).alias("refused"))


def rewrite_clean(spark: SparkSession, d: str) -> DataFrame:
    """The first line of a turn in quotes, cleaned; unusable rewrites are null."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean_rewrite(F.concat(F.lit(" «“"), F.col("text"), F.lit("»\n"))).alias("rewrite"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.select("doc_id", "pos", "sentence")


def answer_markers(spark: SparkSession, d: str) -> DataFrame:
    """Closed and unclosed markers of a turn with both kinds behind it."""
    n = F.col("turn").cast("string")
    text = F.concat("text", F.lit(" [1"), n, F.lit("] [2"), n, F.lit(" [3: [1.500] [4, x [5,5 [12x] ["), n)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.markers(text).cast("array<string>"), ",").alias("closed"), F.array_join(T.unclosed_markers(text).cast("array<string>"), ",").alias("unclosed"))


def renumbered_answers(spark: SparkSession, d: str) -> DataFrame:
    """Turns with runs of markers, rewritten to the ordinals of three of five sources, and with those beyond two dropped."""
    n = F.col("turn").cast("string")
    text = F.concat(F.lit("x  [1][3] [2]"), "text", F.lit(" \t[5][4][1], [9][0] y["), n, F.lit("] [2"))
    ordinals = F.array(*map(F.lit, (2, 1, 2, 0, 3)))
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.renumber_markers(text, ordinals).alias("whole"), T.renumber_markers(text, ordinals, streaming=True).alias("shown"), T.drop_unbacked_markers(text, F.lit(2)).alias("backed"))
    return rows.select("conv_id", "turn", *(F.md5(c).alias(c) for c in ("whole", "shown", "backed")))


_REPLY = r"""CASE turn % 6 WHEN 0 THEN concat('Sure: {"verdict":"pass","reason":"a } in {a string} \\" quoted"} then {x} ', text) WHEN 1 THEN 'nothing { here' WHEN 2 THEN concat('{"verdict": "fail", "reason": {"a": 1}}', text)
  WHEN 3 THEN concat('{"verdict": "maybe"} {"verdict": "pass"} ', text) WHEN 4 THEN '{"verdict": "pass", }' ELSE concat('json {"verdict":"fail","nested":{"b":{}},"reason":"x"}}', text) END"""


def json_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of replies with prose around, braces in strings, several objects and broken ones."""
    reply = F.expr(_REPLY)
    rows = table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", T.first_json_object(reply).alias("object"), T.judge_verdict(reply).alias("v"))
    return rows.select("conv_id", "turn", "object", "v.verdict", "v.reason", "v.error")


_TYPOS = "concat(text, ' deeeclarar ppagado llano dedeclarar vivienda iii XXX CCSS a@ppago.cr www.sseguro.cr ', CASE WHEN doc_id % 2 = 0 THEN 'eel' ELSE 'papas' END)"


def typo_runs(spark: SparkSession, d: str) -> DataFrame:
    """Words that look like slips of the pen, each once, in order; documents without a text have none."""
    return table(spark, d, "documents").select("doc_id", F.array_join(T.typo_runs(F.coalesce(F.expr(_TYPOS), F.lit(""))), ",").alias("runs"))


def figure_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Amounts and percentages of a sentence, each once, and those that its source doesn't have."""
    price, k = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey")
    said = F.concat(F.lit("Se pagan ₡"), price.cast("string"), F.lit(" y ₡ "), (k % 7).cast("string"), F.lit(", es decir "), (k % 13).cast("string"), F.lit(",5 % o "), (k % 13).cast("string"), F.lit(",5 %."))
    source = F.concat(F.lit("El monto es ₡"), price.cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", T.figures(said).alias("found"), T.figures(source).alias("known"))
    return rows.select("o_orderkey", F.array_join("found", "|").alias("mentions"), F.array_join(F.filter("found", lambda x: ~F.array_contains("known", x)), "|").alias("unsourced"))


def number_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.format_number(F.col("o_totalprice"), 2).alias("two"), T.format_number(F.col("o_totalprice"), 0).alias("whole"))


def long_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.long_date(F.col("o_orderdate")).alias("long_date"))


def fiscal_days(spark: SparkSession, d: str) -> DataFrame:
    """Local date, fiscal year, whether it is December, and the days a week before and after."""
    day = F.to_date(T.local_time(F.col("ts")))
    rows = table(spark, d, "events").select("event_id", day.alias("day"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select("event_id", shown("day").alias("day"), F.year("day").alias("fiscal_year"), (F.month("day") == 12).alias("december"), shown(F.date_add("day", -7)).alias("notice_from"), shown(F.date_add("day", 7)).alias("notice_to"))


def dated_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose last day is an order's date, read on 1996-06-15: ending within a week, or ended within one."""
    today, last = F.lit("1996-06-15").cast("date"), F.to_date("o_orderdate")
    state = F.when((today <= last) & (today >= F.date_add(last, -7)), "ending_soon").when((today > last) & (today <= F.date_add(last, 7)), "just_ended")
    return table(spark, d, "orders").select("o_orderkey", state.alias("state")).where("state IS NOT NULL")


def account_age(spark: SparkSession, d: str) -> DataFrame:
    """Accounts too young to delete a day's data; a time that can't be read counts as too young."""
    created = F.when(F.col("user_id") % 5 == 0, F.lit("soon")).when(F.col("user_id") % 5 == 1, F.lit(None).cast("string")).otherwise(F.date_format(F.col("ts") - F.make_interval(mins=(F.col("event_id") % 180).cast("int")), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.try_to_timestamp(created))
    return table(spark, d, "events").select("event_id", F.coalesce(age < ACCOUNT_MINUTES * 60_000_000, F.lit(True)).alias("too_young"))


def error_classes(spark: SparkSession, d: str) -> DataFrame:
    """Names of errors that may be logged as they are, counted."""
    name = F.when(F.col("event_id") % 9 == 0, F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string"))).when(F.col("event_id") % 9 == 1, F.repeat("event_type", 12)).otherwise(F.concat(F.lit("E."), F.col("event_type")))
    return table(spark, d, "events").groupBy(T.error_description(name).alias("error")).agg(F.count("*").alias("n"))


def _anchor(label: Column) -> Column:
    """The number of a plain article label."""
    return F.nullif(F.regexp_extract(F.trim(label), r"(?iu)^ART[ÍI]CULO\s+(\d+)$", 1), F.lit(""))


def citation_projection(spark: SparkSession, d: str) -> DataFrame:
    """A chunk's citation and its address: the viewer's root or article, a page of a file, or none for other schemes."""
    rows = _chunks(spark, d).withColumns({"ficha": F.nullif(F.col("doc_id") % 90, F.lit(0)), "version": F.nullif(F.col("doc_id") % 4, F.lit(0))})
    key = _anchor(F.col("label"))
    article = F.when(key.cast("long") > 0, F.concat(F.lit("7"), key))
    at = lambda *parts: F.concat(F.lit(VIEWER), F.lit("?param1="), F.col("ficha").cast("string"), *parts)
    law = F.coalesce(at(F.lit("&param2="), F.col("version").cast("string"), F.lit("&param3=3&param4="), article, F.lit("&param5=")), at(F.lit("&param2=&param3=1&param4=")))
    address = F.concat(F.when(F.col("doc_id") % 10 == 3, "ftp").otherwise("HTTPS"), F.lit("://x.org/"), F.col("doc_key"), F.when(F.col("doc_id") % 10 == 5, "#top").otherwise(""))
    page = F.nullif(F.regexp_extract(F.concat((F.col("doc_id") % 30).cast("string"), F.lit("-40")), r"^(\d+)-\d+$", 1).cast("long"), F.lit(0))
    file = F.when(address.rlike(r"(?i)^https?://"), F.when(page.isNotNull() & ~F.contains(address, F.lit("#")), F.concat(address, F.lit("#page="), page.cast("string"))).otherwise(address))
    return rows.select("doc_id", "doc_key", F.col("label").alias("article"), F.when(F.col("doc_id") % 2 == 0, law).otherwise(file).alias("url"))


def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    """The numbered sources of each answer set (eight chunks in order of id) as a model is shown them, as a digest."""
    head = F.concat(F.concat_ws(" — ", "source", "label"), F.when(F.col("lang").isNotNull(), F.concat(F.lit(" ("), "lang", F.lit(")"))).otherwise(""))
    body = F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")))
    listed = _chunks(spark, d).groupBy(F.floor(F.col("doc_id") / 8).alias("answer_set")).agg(F.array_sort(F.collect_list(F.struct("doc_id", body.alias("body")))).alias("all"))
    shown = F.transform("all", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["body"]))
    return listed.select("answer_set", F.md5(F.array_join(shown, "\n\n")).alias("context_md5"), F.size("all").alias("n"))


def label_forms(spark: SparkSession, d: str) -> DataFrame:
    """``doc·article·#part`` and what is read back from it, by the first and the last sign."""
    form = F.concat("doc_key", F.lit("·"), F.coalesce("label", F.lit("")), F.lit("·#"), F.col("part").cast("string"))
    rows = _chunks(spark, d).select("doc_id", form.alias("form"))
    read = lambda k: F.regexp_extract("form", r"^([^·]*)·(.*)·#(\d+)$", k)
    return rows.select("doc_id", "form", read(1).alias("doc_key"), F.nullif(read(2), F.lit("")).alias("label"), read(3).cast("long").alias("part"))


def null_defaults(spark: SparkSession, d: str) -> DataFrame:
    """A fused row as a chunk: absent ranks stay null, an absent source is the empty one."""
    fused = retrieval.rrf_two_legs(spark, d)
    rows = fused.join(_chunks(spark, d).withColumnRenamed("doc_id", "id"), "id")
    return rows.select("query_id", F.col("id").alias("chunkId"), F.col("doc_key").alias("docKey"), F.col("label").alias("articulo"), F.coalesce(F.nullif("source", F.lit("src0")), F.lit("{}")).alias("source"), F.col("vector_rank").alias("vectorRank"), F.col("lexical_rank").alias("lexicalRank"))


def blank_queries(spark: SparkSession, d: str) -> DataFrame:
    """Blank questions are answered at once as weak with nothing found; every fifth question is blank here."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 5 == 0, F.lit(" \t\n")).otherwise(F.col("text")).alias("text"))
    found = retrieval.lexical_leg_strict_or(spark, d).join(asked.where(F.col("text").rlike(r"\S")), "query_id", "left_semi")
    counted = found.groupBy("query_id").agg(F.count("*").alias("n"))
    return asked.join(counted, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_found"), F.col("n").isNull().alias("is_weak"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, target, doc_key, article, path): two targets a case; article and path only where the case asks for them."""
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("target"))
    n = F.col("case_id") * 2 + F.col("target")
    return cases.select("case_id", "target", F.concat(F.lit("doc-"), (n % 27).cast("string")).alias("doc_key"), F.when(n % 3 > 0, F.concat(F.lit("ARTÍCULO "), (n % 40).cast("string"))).alias("article"), F.when(n % 4 == 1, F.lit("en")).alias("path"))


_TARGETS = """t AS (SELECT item_id AS case_id, target, concat('doc-', (item_id * 2 + target) % 27) AS doc_key, CASE WHEN (item_id * 2 + target) % 3 > 0 THEN concat('ARTÍCULO ', (item_id * 2 + target) % 40) END AS article,
  CASE WHEN (item_id * 2 + target) % 4 = 1 THEN 'en' END AS path FROM benchmark CROSS JOIN (SELECT unnest([0, 1]) AS target))"""
_MATCH = "c.doc_key = t.doc_key AND (t.article IS NULL OR lower(c.label) = lower(t.article)) AND (t.path IS NULL OR list_contains([c.lang, c.source], t.path))"


def _holding(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("doc_id", "doc_key", "label", F.array("lang", "source").alias("holds"))


def target_census(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks satisfy each target; none makes it unsatisfiable."""
    return targets.target_counts(_targets(spark, d), _holding(spark, d))


def target_summary(spark: SparkSession, d: str) -> DataFrame:
    """Satisfied targets of all, their share, and which aren't: a row for each of those, with the totals (one row without a name if there is none)."""
    # a row each, since one list of them all would be made in one task
    census = materialize(target_census(spark, d).select("case_id", "target", "unsatisfiable").distinct())
    totals = census.agg(F.count_if(~F.col("unsatisfiable")).alias("satisfied"), F.count("*").alias("total"))
    totals = totals.withColumn("ratio", F.coalesce(F.round(F.try_divide("satisfied", "total"), 6), F.lit(float("nan"))))
    case = F.col("case_id").cast("string")
    name = F.concat(F.coalesce(F.lpad(case, F.greatest(F.length(case), F.lit(6)), F.lit("0")), F.lit("")), F.lit("/"), F.col("target").cast("string"))
    names = census.where("unsatisfiable").select(name.alias("unsatisfied")).union(totals.where("satisfied = total").select(F.lit("")))
    return names.crossJoin(F.broadcast(totals)).select("satisfied", "total", "unsatisfied", "ratio")


def unsatisfied_targets(spark: SparkSession, d: str) -> DataFrame:
    return target_census(spark, d).where("unsatisfiable").select("case_id", "target")


def target_places(spark: SparkSession, d: str) -> DataFrame:
    """Of each case: whether any and whether every target is in the answer set of eight, the first rank, and where that is."""
    fused = retrieval.hydrated_top8(spark, d).select(F.col("query_id").alias("case_id"), F.col("id").alias("doc_id"), "pos").join(_holding(spark, d), "doc_id")
    held = targets.target_places(_targets(spark, d), fused)
    rows = held.groupBy("case_id").agg(F.bool_or(F.col("pos").isNotNull()).alias("hit"), F.bool_and(F.col("pos").isNotNull()).alias("all_reached"), F.min("pos").alias("first_rank"))
    return rows.withColumn("place", F.when(F.col("first_rank") <= 3, "top").when(F.col("first_rank").isNotNull(), "cut").otherwise("missed"))


def case_selection(spark: SparkSession, d: str) -> DataFrame:
    """What a lane does with a list of wanted case ids: nothing named, unknown ids, none of its own, or those of its own."""
    lanes = spark.createDataFrame([(1, None), (2, [1, 2, 99999]), (3, [1, 3]), (4, [2, 4, 4, 6])], "lane long, ids array<long>")
    known = table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    wanted = lanes.select("lane", F.explode(F.array_distinct("ids")).alias("id"))
    unknown = wanted.join(known, "id", "left_anti").groupBy("lane").agg(F.array_sort(F.collect_list("id")).alias("unknown"))
    # a lane holds the cases of even ids
    own = wanted.join(known.where("id % 2 = 0"), "id", "left_semi").groupBy("lane").agg(F.array_sort(F.collect_list("id")).alias("own"))
    rows = lanes.join(unknown, "lane", "left").join(own, "lane", "left")
    mode = F.when(F.col("ids").isNull(), "full").when(F.col("unknown").isNotNull(), "unknown").when(F.col("own").isNull(), "skip").otherwise("scoped")
    return rows.select("lane", mode.alias("mode"), F.array_join(F.when(F.col("unknown").isNotNull(), F.col("unknown")).otherwise(F.coalesce("own", F.array_sort(F.array_distinct("ids")))), ",").alias("ids"))


def citation_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Of each document and label the first row in fused order; the top score is the first row's."""
    top = retrieval.hydrated_top8(spark, d).join(_chunks(spark, d).select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("doc_id"), F.coalesce("lang", F.lit("")).alias("label")), "id")
    first = fusion.first_citations(top.select("query_id", "pos", "doc_id", "label", "score"))
    return first.withColumn("top_score", F.first("score").over(Window.partitionBy("query_id").orderBy("pos"))).select("query_id", "pos", "doc_id", "label", "top_score")


def reading_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Readings asked for, returned and dropped with their causes."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("reading"))
    n = F.col("query_id") * 3 + F.col("reading")
    rows = asked.withColumn("cause", F.when(n % 4 == 0, "http").when(n % 4 == 1, "timeout"))
    got = asked.where(n % 5 > 1)
    found = fusion.reading_accounts(rows, got)
    return found.withColumn("dropped", F.array_join("dropped", ","))


QUERIES = {f.__name__: f for f in (article_keys, text_guard, rewrite_clean, sentence_split, answer_markers, renumbered_answers, json_verdicts, typo_runs, figure_mentions, number_format, long_dates, fiscal_days, dated_facts, account_age, error_classes, citation_projection, prompt_context, label_forms, null_defaults, blank_queries, target_census, target_summary, unsatisfied_targets, target_places, case_selection, citation_dedupe, reading_accounting)}

_FOLDED = rf"trim(regexp_replace(lower(translate(label, '{T.MARKED}', '{T.PLAIN}')), '\s+', ' ', 'g'))"
_KEY = r"'^articulo (\d+) ?(?:\.?[°º])?(?: (bis|ter|quater|quinquies))?$'"
_LIST = lambda xs: f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"
_FIGURE = r"'[¢₡]\s?\d[\d.,]*\d|[¢₡]\s?\d|\d+(?:[.,]\d+)?\s?%'"
_MONTHS = "[" + ", ".join(f"'{m}'" for m in T.MONTHS) + "]"


def _twin(name: str) -> str:
    return retrieval.ORACLE[name]


ORACLE = {
    "article_keys": rf"WITH {_CHUNKS} SELECT doc_id, label, CASE WHEN regexp_extract({_FOLDED}, {_KEY}, 1) <> '' THEN trim(CAST(CAST(regexp_extract({_FOLDED}, {_KEY}, 1) AS BIGINT) AS VARCHAR) || ' ' || upper(regexp_extract({_FOLDED}, {_KEY}, 2))) END AS article_key FROM c",
    "text_guard": "SELECT conv_id, turn, coalesce(contains(CASE WHEN conv_id % 11 = 0 THEN text || chr(0) ELSE text END, chr(0)), false) AS refused FROM conversations",
    "rewrite_clean": r"""WITH r AS (SELECT conv_id, turn, trim(string_split(trim(' «“' || text || '»' || chr(10), ' '), chr(10))[1]) AS line FROM conversations),
k AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(line, '^["''«“]+|["''»”]+$', '', 'g')), '\s+', ' ', 'g') AS line FROM r)
SELECT conv_id, turn, CASE WHEN line <> '' AND length(line) <= 1000 THEN line END AS rewrite FROM k""",
    "sentence_split": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([\p{Lu}\p{N}¿¡«"(\[])', '\1' || chr(10) || '\2', 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS sentence FROM s""",
    "answer_markers": r"""WITH t AS (SELECT conv_id, turn, text || ' [1' || turn || '] [2' || turn || ' [3: [1.500] [4, x [5,5 [12x] [' || turn AS t FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(t, '\[(\d+)\]', 1), lambda x: coalesce(TRY_CAST(x AS INTEGER), 2147483647)), ',') AS closed,
  array_to_string(list_transform(regexp_extract_all(t, '\[(\d+)(?:\s|[:;—–-]|[.,]\D|[.,]$|$)', 1), lambda x: coalesce(TRY_CAST(x AS INTEGER), 2147483647)), ',') AS unclosed FROM t""",
    "figure_mentions": rf"""WITH s AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p, o_orderkey AS k FROM orders),
f AS (SELECT o_orderkey, regexp_extract_all('Se pagan ₡' || p || ' y ₡ ' || k % 7 || ', es decir ' || k % 13 || ',5 % o ' || k % 13 || ',5 %.', {_FIGURE}) AS a, regexp_extract_all('El monto es ₡' || p, {_FIGURE}) AS b FROM s),
u AS (SELECT o_orderkey, {_LIST('a')} AS a, b FROM f)
SELECT o_orderkey, array_to_string(a, '|') AS mentions, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), '|') AS unsourced FROM u""",
    "number_format": "SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS two, translate(format('{:,}', CAST(round(CAST(o_totalprice AS DECIMAL(28,8)), 0) AS BIGINT)), ',', '.') AS whole FROM orders",
    "long_dates": f"SELECT o_orderkey, day(o_orderdate) || ' de ' || {_MONTHS}[month(o_orderdate)] || ' de ' || year(o_orderdate) AS long_date FROM orders",
    "fiscal_days": "WITH e AS (SELECT event_id, CAST(ts - INTERVAL 6 HOURS AS DATE) AS day FROM events) SELECT event_id, strftime(day, '%Y-%m-%d') AS day, CAST(year(day) AS INTEGER) AS fiscal_year, month(day) = 12 AS december, strftime(day - 7, '%Y-%m-%d') AS notice_from, strftime(day + 7, '%Y-%m-%d') AS notice_to FROM e",
    "dated_facts": """SELECT o_orderkey, CASE WHEN DATE '1996-06-15' <= CAST(o_orderdate AS DATE) THEN 'ending_soon' ELSE 'just_ended' END AS state FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-06-08' AND DATE '1996-06-22'""",
    "account_age": f"SELECT event_id, user_id % 5 IS NULL OR user_id % 5 <= 1 OR event_id % 180 < {ACCOUNT_MINUTES} AS too_young FROM events",
    "error_classes": "WITH n AS (SELECT CASE WHEN event_id % 9 = 0 THEN event_type || ' of user ' || user_id WHEN event_id % 9 = 1 THEN repeat(event_type, 12) ELSE 'E.' || event_type END AS name FROM events) SELECT CASE WHEN regexp_full_match(name, '[A-Za-z0-9_.:-]{1,48}') THEN name ELSE 'other' END AS error, count(*) AS n FROM n GROUP BY 1",
    "citation_projection": rf"""WITH {_CHUNKS}, k AS (SELECT *, nullif(doc_id % 90, 0) AS ficha, nullif(doc_id % 4, 0) AS version, nullif(regexp_extract(trim(label), '(?i)^ART[ÍI]CULO\s+(\d+)$', 1), '') AS key,
  CASE WHEN doc_id % 10 = 3 THEN 'ftp' ELSE 'HTTPS' END || '://x.org/' || doc_key || CASE WHEN doc_id % 10 = 5 THEN '#top' ELSE '' END AS address FROM c)
SELECT doc_id, doc_key, label AS article, CASE
  WHEN doc_id % 2 = 0 AND ficha IS NULL THEN NULL
  WHEN doc_id % 2 = 0 AND version IS NOT NULL AND CAST(key AS BIGINT) > 0 THEN '{VIEWER}?param1=' || ficha || '&param2=' || version || '&param3=3&param4=7' || key || '&param5='
  WHEN doc_id % 2 = 0 THEN '{VIEWER}?param1=' || ficha || '&param2=&param3=1&param4='
  WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 30 > 0 AND doc_id % 10 <> 5 THEN address || '#page=' || doc_id % 30 ELSE address END AS url FROM k""",
    "prompt_context": rf"""WITH {_CHUNKS}, b AS (SELECT doc_id // 8 AS answer_set, doc_id, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS i, concat_ws(' — ', source, label) || CASE WHEN lang IS NOT NULL THEN ' (' || lang || ')' ELSE '' END || chr(10) || coalesce(text, '') AS body FROM c)
SELECT answer_set, md5(string_agg('[' || i || '] ' || body, chr(10) || chr(10) ORDER BY i)) AS context_md5, CAST(count(*) AS INTEGER) AS n FROM b GROUP BY answer_set""",
    "label_forms": f"WITH {_CHUNKS} SELECT doc_id, doc_key || '·' || coalesce(label, '') || '·#' || part AS form, doc_key, label, part FROM c",
    "null_defaults": f"WITH {_CHUNKS}, f AS ({_twin('rrf_two_legs')}) SELECT query_id, id AS \"chunkId\", doc_key AS \"docKey\", label AS articulo, coalesce(nullif(source, 'src0'), '{{}}') AS source, vector_rank AS \"vectorRank\", lexical_rank AS \"lexicalRank\" FROM f JOIN c ON c.doc_id = f.id",
    "blank_queries": f"WITH f AS (SELECT query_id, count(*) AS n FROM ({_twin('lexical_leg_strict_or')}) GROUP BY query_id) SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN 0 ELSE coalesce(n, 0) END AS n_found, item_id % 5 = 0 OR n IS NULL AS is_weak FROM benchmark LEFT JOIN f ON query_id = item_id",
    "target_census": f"WITH {_CHUNKS}, {_TARGETS} SELECT case_id, target, count(c.doc_id) AS n, count(c.doc_id) = 0 AS unsatisfiable FROM t LEFT JOIN c ON {_MATCH} GROUP BY case_id, target",
    "target_summary": f"""WITH {_CHUNKS}, {_TARGETS}, n AS (SELECT case_id, target, count(c.doc_id) AS n FROM t LEFT JOIN c ON {_MATCH} GROUP BY case_id, target),
s AS (SELECT count(*) FILTER (n > 0) AS satisfied, count(*) AS total, round(count(*) FILTER (n > 0) / count(*), 6) AS ratio FROM n),
u AS (SELECT coalesce(lpad(CAST(case_id AS VARCHAR), CAST(greatest(length(CAST(case_id AS VARCHAR)), 6) AS INTEGER), '0'), '') || '/' || target AS unsatisfied FROM n WHERE n = 0)
SELECT satisfied, total, coalesce(unsatisfied, '') AS unsatisfied, ratio FROM s LEFT JOIN u ON true""",
    "unsatisfied_targets": f"WITH {_CHUNKS}, {_TARGETS} SELECT case_id, target FROM t WHERE NOT EXISTS (FROM c WHERE {_MATCH})",
    "target_places": f"""WITH {_CHUNKS}, {_TARGETS}, f AS ({_twin('hydrated_top8')}), p AS (SELECT case_id, target, min(f.pos) AS pos FROM t LEFT JOIN (c JOIN f ON f.id = c.doc_id) ON f.query_id = t.case_id AND {_MATCH} GROUP BY case_id, target)
SELECT case_id, bool_or(pos IS NOT NULL) AS hit, bool_and(pos IS NOT NULL) AS all_reached, min(pos) AS first_rank, CASE WHEN min(pos) <= 3 THEN 'top' WHEN min(pos) IS NOT NULL THEN 'cut' ELSE 'missed' END AS place FROM p GROUP BY case_id""",
    "case_selection": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'full', NULL), (2, 'unknown', '99999'), (3, 'skip', '1,3'), (4, 'scoped', '2,4,6')) AS v(lane, mode, ids)",
    "citation_dedupe": f"""WITH f AS ({_twin('hydrated_top8')}), n AS (SELECT query_id, pos, id % 4 AS doc_id, coalesce(d.lang, '') AS label, score, row_number() OVER (PARTITION BY query_id, id % 4, coalesce(d.lang, '') ORDER BY pos) AS n FROM f JOIN documents d ON d.doc_id = f.id)
SELECT query_id, pos, doc_id, label, first_value(score) OVER (PARTITION BY query_id ORDER BY pos) AS top_score FROM n WHERE n = 1""",
    "reading_accounting": """WITH a AS (SELECT item_id AS query_id, unnest([0, 1, 2]) AS reading FROM benchmark), n AS (SELECT *, query_id * 3 + reading AS n FROM a)
SELECT query_id, count(*) AS asked, count(*) FILTER (n % 5 > 1) AS returned, coalesce(string_agg(CASE n % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'timeout' ELSE 'unreadable' END, ',' ORDER BY reading) FILTER (n % 5 <= 1), '') AS dropped FROM n GROUP BY query_id""",
    "renumbered_answers": r"""WITH t AS (SELECT conv_id, turn, text AS x, '' || turn AS n FROM conversations),
w AS (SELECT conv_id, turn, 'x[2]' AS a, '[1]' || x AS b, '[3][2], y' || CASE n WHEN '1' THEN '[2]' WHEN '2' THEN '[1]' WHEN '3' THEN '[2]' WHEN '5' THEN '[3]' ELSE '' END AS c,
   'x[1]' || '[2]' || x || '[1], y' || CASE WHEN n IN ('1', '2') THEN '[' || n || ']' ELSE '' END || ' [2' AS backed FROM t)
SELECT conv_id, turn, md5(a || b || c || ' [2') AS whole, md5(a || b || c) AS shown, md5(backed) AS backed FROM w""",
    "json_verdicts": r"""SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN '{"verdict":"pass","reason":"a } in {a string} \" quoted"}' WHEN 2 THEN '{"verdict": "fail", "reason": {"a": 1}}' WHEN 3 THEN '{"verdict": "maybe"}'
  WHEN 4 THEN '{"verdict": "pass", }' WHEN 5 THEN '{"verdict":"fail","nested":{"b":{}},"reason":"x"}' END AS object,
  CASE turn % 6 WHEN 0 THEN 'pass' WHEN 2 THEN 'fail' WHEN 5 THEN 'fail' END AS verdict, CASE turn % 6 WHEN 0 THEN 'a } in {a string} " quoted' WHEN 2 THEN '' WHEN 5 THEN 'x' END AS reason,
  CASE turn % 6 WHEN 1 THEN 'no_object' WHEN 3 THEN 'bad_verdict' WHEN 4 THEN 'malformed' END AS error FROM conversations WHERE text IS NOT NULL""",
    # RE2 has no back-references: the doubled beginnings are compared letter by letter
    "typo_runs": rf"""WITH w AS (SELECT doc_id, list_distinct_in_order AS w FROM (SELECT doc_id, {_LIST("ws")} AS list_distinct_in_order FROM (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce({_TYPOS}, ''), '(?i){T.ADDRESS}', ' ', 'g'), '\p{{L}}+') AS ws FROM documents))),
k AS (SELECT doc_id, list_filter(w, lambda v: NOT regexp_matches(lower(v), '^[ivxlcdm]+$') AND NOT (length(v) > 1 AND v = upper(v)) AND (
    len(list_filter(range(1, length(v) - 1), lambda i: lower(v)[i] = lower(v)[i + 1] AND lower(v)[i] = lower(v)[i + 2])) > 0 OR (length(v) > 1 AND lower(v)[1] = lower(v)[2] AND lower(v)[1] <> 'l')
    OR (NOT regexp_matches(lower(v), '{T.REDUPLICATED}') AND len(list_filter([2, 3, 4], lambda n: length(v) > 2 * n AND lower(v)[1:n] = lower(v)[n + 1:2 * n])) > 0))) AS runs FROM w)
SELECT doc_id, array_to_string(runs, ',') AS runs FROM k""",
}
