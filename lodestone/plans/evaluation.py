"""Queries over evaluation runs: coverage, gates, stability, causes, censuses, orders and selections.

Fixtures: a benchmark item is a case, an event a reading, an event's user a case with several draws.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluation as measures
from lodestone.operators import pins as operators_pins
from lodestone.operators import search
from lodestone.plans import answers, pins, retrieval
from lodestone.session import table

# Baselines of the gates and how far below them a run may fall.
GATES = {"groundedness": (73.0, 4.0), "tier_1": (92.0, 4.0), "tier_2": (0.84, 0.0), "robustness": (27.0, 2.0)}


def requirement_delta(spark: SparkSession, d: str) -> DataFrame:
    """Stated and declared requirements of two runs; cases that a run couldn't read are skipped in it."""
    n = F.col("item_id")
    runs = table(spark, d, "benchmark").select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("run"), n.alias("case_id"), (n % 5 + 1).alias("declared"))
    misses = F.when(F.col("run") == "a", F.col("case_id") % 4).otherwise(F.col("case_id") % 7)
    runs = runs.withColumn("misses", F.when((F.col("case_id") % 9 == 0) & (F.col("run") == "b"), None).otherwise(misses))
    return measures.requirement_coverage(runs, "a")


def central_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Central claims stated: missed if it is listed as missing or with a literal's remark behind it; which misses name no declared claim."""
    n = F.col("item_id")
    cases = table(spark, d, "benchmark").select(n.alias("case_id"), F.when(n % 2 == 0, F.concat(F.lit("claim "), (n % 6).cast("string"))).alias("central"),
        F.array(F.concat(F.lit("claim "), (n % 4).cast("string"))).alias("missing"), F.array(F.concat(F.lit("claim "), (n % 3).cast("string"), F.lit(" (x: absent)"))).alias("literals"))
    declared = spark.createDataFrame([(f"claim {k}",) for k in range(3)], "claim string")
    return measures.central_misses(cases, declared)


def gate_floors(spark: SparkSession, d: str) -> DataFrame:
    """Each gate's floor (baseline less margin) and whether the run's figure holds it."""
    rows = table(spark, d, "benchmark").agg(F.count_if(F.col("item_id") % 10 > 0).alias("tier_1"), F.round(F.count_if(F.col("item_id") % 6 > 0) / F.count("*"), 6).alias("tier_2"), F.lit(69).alias("groundedness"), F.lit(24).alias("robustness"))
    figures = rows.select(F.explode(F.create_map(*(x for g in GATES for x in (F.lit(g), F.col(g).cast("double"))))).alias("gate", "value"))
    return measures.gates(figures, spark.createDataFrame([(g, b, m) for g, (b, m) in GATES.items()], "gate string, baseline double, margin double"))


def _draws(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, draw, ids): four draws of each user's events, as sets of five classes."""
    return table(spark, d, "events").where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("case_id"), (F.col("event_id") % 4).alias("draw")).agg(F.array_sort(F.collect_set(F.col("event_id") % 11)).alias("ids"))


def pairwise_stability(spark: SparkSession, d: str) -> DataFrame:
    """Median of the Jaccard similarities of a case's draws, how many different sets it has, and whether its weakness flips."""
    draws = _draws(spark, d)
    a, b = draws.alias("a"), draws.alias("b")
    pairs = a.join(b, "case_id").where("a.draw < b.draw").select("case_id", (F.size(F.array_intersect("a.ids", "b.ids")) / F.size(F.array_union("a.ids", "b.ids"))).alias("j"))
    sets = draws.groupBy("case_id").agg(F.countDistinct("ids").alias("sets"), (F.countDistinct(F.size("ids") > 2) > 1).alias("weak_flips"))
    return sets.join(pairs.groupBy("case_id").agg(F.round(F.median("j"), 6).alias("median_jaccard")), "case_id", "left")


def draw_subsets(spark: SparkSession, d: str) -> DataFrame:
    """For every subset of two and three of four draws the rows that any of them found."""
    subsets = [(",".join(map(str, s)), list(s)) for k in (2, 3) for s in combinations(range(4), k)]
    chosen = spark.createDataFrame([(name, x) for name, s in subsets for x in s], "subset string, draw long")
    found = _draws(spark, d).join(F.broadcast(chosen), "draw").select("case_id", "subset", F.explode("ids").alias("id"))
    return found.groupBy("case_id", "subset").agg(F.countDistinct("id").alias("reached"))


def cause_classes(spark: SparkSession, d: str) -> DataFrame:
    """Why a requirement is missed: a part's cause is 1 (not in the corpus), 2 (not found) or 3 (not said), the requirement's the least of its parts'."""
    parts = table(spark, d, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("requirement"), F.coalesce(F.col("event_type") != "error", F.lit(True)).alias("in_corpus"), F.coalesce(F.col("value") >= 50, F.lit(True)).alias("found"))
    return measures.requirement_causes(parts).groupBy("cause").agg(F.count("*").alias("requirements"), F.count_if("split").alias("split"))


def cross_reference_census(spark: SparkSession, d: str) -> DataFrame:
    """Per document: chunks whose texts name articles, references, and those that lead to exactly one chunk."""
    cases = pins._cases(spark, d)
    refs = operators_pins.article_references(cases, pins._laws(spark))
    keys = cases.where("part = 0 AND article IS NOT NULL").groupBy("doc_key", "article").agg(F.count("*").alias("n"))
    found = refs.join(keys, ["doc_key", "article"], "left").join(cases.select("id", F.col("doc_key").alias("home")), "id")
    return found.groupBy(F.col("home").alias("doc_key")).agg(F.countDistinct("id").alias("naming"), F.count("*").alias("references"), F.count_if(F.coalesce(F.col("n") == 1, F.lit(False))).alias("resolvable"))


def answer_set_bars(spark: SparkSession, d: str) -> DataFrame:
    """Four bars that a new answer set must clear against the old: mean share + 0.1, same picks, hits, and at most two rows more."""
    n = F.col("item_id")
    rows = table(spark, d, "benchmark").select((n % 10 / 10).alias("old"), (n % 8 / 7).alias("new"), (n % 20 > 0).alias("same"), (n % 17 > 0).alias("hit"), (n % 3).alias("more"))
    return measures.answer_set_bars(rows)


def event_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each local day over the events' JSON, and the share of errors."""
    k = F.get_json_object("props", "$.k").cast("long")
    kinds = ["click", "error", "login", "purchase", "signup", "view"]
    counted = [F.count_if(F.col("event_type") == x).alias(f"n_{x}") for x in kinds]
    rows = table(spark, d, "events").groupBy(T.local_date(F.col("ts")).alias("day")).agg(F.count("*").alias("asks"), *counted, F.count_if(k % 2 == 0).alias("even"), F.count_if(k >= 50).alias("upper"), F.count_if(k.isNull()).alias("without"), F.count_if(F.col("value") > 100).alias("dear"), F.countDistinct("user_id").alias("users"))
    return rows.withColumn("error_rate", F.round((F.col("n_error") + F.col("without")) / F.col("asks"), 6))


def probe_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count("*").alias("n"))


def corpus_shares(spark: SparkSession, d: str) -> DataFrame:
    """One row of three totals, joined as single rows."""
    one = lambda name, of: table(spark, d, name).agg(of)
    rows = one("documents", F.count("*").alias("documents")).crossJoin(one("labels", F.count("*").alias("labels"))).crossJoin(one("pages", F.count("*").alias("pages")))
    return rows.withColumn("labelled", F.round(F.col("labels") / F.col("documents"), 6))


def quote_check(spark: SparkSession, d: str) -> DataFrame:
    """A list of quotes and in how many documents each stands."""
    quotes = spark.createDataFrame([(1, "All rights reserved"), (2, "MIT License"), (3, "never said anywhere")], "quote_id int, quote string")
    found = table(spark, d, "documents").join(F.broadcast(quotes), F.contains("text", F.col("quote"))).groupBy("quote_id").agg(F.count("*").alias("n"))
    return quotes.join(found, "quote_id", "left").select("quote_id", F.coalesce("n", F.lit(0)).alias("n"))


def figure_first(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a conversation in order of turn, those with a digit first, at most twelve."""
    has = F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False))
    w = Window.partitionBy("conv_id").orderBy(F.desc("figure"), "turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", has.alias("figure")).withColumn("pos", F.row_number().over(w))
    return rows.where("pos <= 12")


def withheld_before_limit(spark: SparkSession, d: str) -> DataFrame:
    """The nearest eight of what isn't withheld (every third row is): withheld rows never enter the leg, so no result is short."""
    served = retrieval._vectors(spark, d).where("id % 3 > 0")
    return search.vector_leg(retrieval._asked_vectors(spark, d), served, 8, exclude_self=True).select("query_id", F.col("rank").alias("pos"), "id")


def corpus_index(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (document, label, language): chunks, different parts, and whether they collide."""
    rows = answers._chunks(spark, d).groupBy("doc_key", "label", "lang").agg(F.count("*").alias("chunks"), F.countDistinct("part").alias("parts"))
    return rows.withColumn("collides", F.col("chunks") != F.col("parts"))


def repeated_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that stand under several entries of a document, and whether a list of exceptions allows that; exceptions that don't occur are stale."""
    allowed = spark.createDataFrame([("doc-1", "Artículo 0 bis"), ("doc-2", "artículo 2"), ("doc-9", "nowhere")], "doc_key string, label string").withColumn("allowed", F.lit(True))
    found = corpus_index(spark, d).where("label IS NOT NULL").groupBy("doc_key", "label").agg(F.count("*").alias("n")).where("n > 1")
    rows = found.join(allowed, ["doc_key", "label"], "full")
    return rows.select("doc_key", "label", F.when(F.col("n").isNull(), "stale").when(F.col("allowed"), "allowed").otherwise("unallowed").alias("state"))


def lane_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases of each lane by tier, held-out mark and variant, with the seed that a robustness case varies."""
    n = F.col("item_id")
    rows = table(spark, d, "benchmark").select(n.alias("case_id"), F.when(n % 10 == 0, "abstain").when(n % 3 == 0, "tier-2").otherwise("tier-1").alias("tier"), (n % 4 == 0).alias("held_out"), F.when(n % 7 == 0, "robustness").alias("variant"), F.concat(F.lit("robustness:"), (n - 1).cast("string")).alias("seed"))
    return rows.select("case_id", (F.col("tier") != "abstain").alias("retrieval"), "held_out", F.coalesce(F.col("variant") == "robustness", F.lit(False)).alias("robustness"), F.when(F.col("variant") == "robustness", F.substring("seed", 12, 99)).alias("seed"))


def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Distinct candidates of both legs."""
    return retrieval.vector_leg_top50(spark, d).select("query_id", "id").union(retrieval.lexical_leg_strict_or(spark, d).select("query_id", "id")).distinct()


def accent_patterns(spark: SparkSession, d: str) -> DataFrame:
    """First parts whose label matches a pattern with an open place for the accented letter, then by exact key."""
    c = answers._chunks(spark, d).where("part = 0").where(F.col("label").ilike("art_culo %"))
    wanted = spark.createDataFrame([("doc-0", "2"), ("doc-5", "3 BIS"), ("doc-12", "12"), ("doc-21", "21 BIS")], "doc_key string, key string")
    return c.withColumn("key", T.article_key(F.col("label"))).join(wanted, ["doc_key", "key"]).select("doc_id", "doc_key", "key")


def regex_probes(spark: SparkSession, d: str) -> DataFrame:
    """How many documents ad-hoc probes find."""
    t = F.col("text")
    return table(spark, d, "documents").agg(F.count_if(t.rlike("(?m)^[A-Z][a-z]+\\.$")).alias("short_line"), F.count_if(t.ilike("%license%")).alias("license"), F.count_if(F.instr(t, "©") > 0).alias("copyright"), F.count_if(F.regexp_replace(t, "\\s", "") == "").alias("blank"), F.sum(F.length(t) - F.length(F.translate(t, "0123456789", ""))).alias("digits"))


QUERIES = {f.__name__: f for f in (requirement_delta, central_coverage, gate_floors, pairwise_stability, draw_subsets, cause_classes, cross_reference_census, answer_set_bars, event_counters, probe_strings, corpus_shares, quote_check, figure_first, withheld_before_limit, corpus_index, repeated_labels, lane_cases, candidate_union, accent_patterns, regex_probes)}

_DRAWS = "dr AS (SELECT user_id AS case_id, event_id % 4 AS draw, list_sort(list(DISTINCT event_id % 11)) AS ids FROM events WHERE user_id IS NOT NULL GROUP BY ALL)"
_INDEX = f"{answers._CHUNKS}, ix AS (SELECT doc_key, label, lang, count(*) AS chunks, count(DISTINCT part) AS parts FROM c GROUP BY ALL)"
_LABEL_KEY = f"CASE WHEN regexp_extract({answers._FOLDED}, {answers._KEY}, 1) <> '' THEN trim(CAST(CAST(regexp_extract({answers._FOLDED}, {answers._KEY}, 1) AS BIGINT) AS VARCHAR) || ' ' || upper(regexp_extract({answers._FOLDED}, {answers._KEY}, 2))) END"

ORACLE = {
    "requirement_delta": """WITH r AS (SELECT 'a' AS run, item_id AS n, item_id % 4 AS misses FROM benchmark UNION ALL SELECT 'b', item_id, item_id % 7 FROM benchmark WHERE item_id % 9 <> 0),
s AS (SELECT run, CAST(sum(greatest(0, n % 5 + 1 - misses)) AS BIGINT) AS stated, CAST(sum(n % 5 + 1) AS BIGINT) AS total FROM r GROUP BY run)
SELECT run, stated, total, round(stated / total, 6) AS coverage, round(round(stated / total, 6) - (SELECT round(stated / total, 6) FROM s WHERE run = 'a'), 6) AS delta FROM s""",
    "central_coverage": """WITH m AS (SELECT item_id AS n, item_id % 6 = item_id % 4 OR item_id % 6 = item_id % 3 AS missed, CAST(item_id % 4 > 2 AS INTEGER) AS stale FROM benchmark WHERE item_id % 2 = 0)
SELECT n AS case_id, missed, CAST(stale AS BIGINT) AS stale FROM m""",
    "gate_floors": """WITH v AS (SELECT count(*) FILTER (item_id % 10 > 0) AS t1, round(count(*) FILTER (item_id % 6 > 0) / count(*), 6) AS t2 FROM benchmark),
g AS (SELECT 'groundedness' AS gate, 69.0::DOUBLE AS value, 73.0::DOUBLE - 4 AS floor FROM v UNION ALL SELECT 'tier_1', t1, 92.0::DOUBLE - 4 FROM v UNION ALL SELECT 'tier_2', t2, 0.84::DOUBLE FROM v UNION ALL SELECT 'robustness', 24, 27.0::DOUBLE - 2 FROM v)
SELECT gate, value, floor, value >= floor AS passed FROM g""",
    "pairwise_stability": f"""WITH {_DRAWS}, p AS (SELECT a.case_id, len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids))) AS j FROM dr a JOIN dr b ON a.case_id = b.case_id AND a.draw < b.draw),
m AS (SELECT case_id, round(median(j), 6) AS median_jaccard FROM p GROUP BY case_id)
SELECT case_id, sets, weak_flips, median_jaccard FROM (SELECT case_id, count(DISTINCT ids) AS sets, count(DISTINCT len(ids) > 2) > 1 AS weak_flips FROM dr GROUP BY case_id) LEFT JOIN m USING (case_id)""",
    "draw_subsets": f"""WITH {_DRAWS}, s AS (SELECT subset, CAST(unnest(string_split(subset, ',')) AS BIGINT) AS draw FROM (SELECT unnest(['0,1', '0,2', '0,3', '1,2', '1,3', '2,3', '0,1,2', '0,1,3', '0,2,3', '1,2,3']) AS subset)),
f AS (SELECT case_id, subset, unnest(ids) AS id FROM dr JOIN s USING (draw)) SELECT case_id, subset, count(DISTINCT id) AS reached FROM f GROUP BY ALL""",
    "cause_classes": """WITH p AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 1 WHEN value < 50 THEN 2 ELSE 3 END AS cause FROM events WHERE user_id IS NOT NULL),
r AS (SELECT user_id, min(cause) AS cause, count(DISTINCT cause) > 1 AS split FROM p GROUP BY user_id) SELECT cause, count(*) AS requirements, count(*) FILTER (split) AS split FROM r GROUP BY cause""",
    "cross_reference_census": f"""WITH {pins._P}, {pins._REF}, n AS (SELECT doc_key, article, count(*) AS n FROM p WHERE part = 0 AND article IS NOT NULL GROUP BY ALL)
SELECT p.doc_key, count(DISTINCT r.id) AS naming, count(*) AS "references", count(*) FILTER (n = 1) AS resolvable FROM r JOIN p USING (id) LEFT JOIN n ON n.doc_key = r.doc_key AND n.article = r.article GROUP BY p.doc_key""",
    "answer_set_bars": """WITH s AS (SELECT round(avg(item_id % 8 / 7) - avg(item_id % 10 / 10), 6) AS gain, round(avg(CAST(item_id % 20 > 0 AS INTEGER)), 6) AS same, round(avg(CAST(item_id % 17 > 0 AS INTEGER)), 6) AS hit, max(item_id % 3) AS more FROM benchmark)
SELECT *, gain >= 0.1 AS r1, same >= 0.9 AS r2, hit >= 0.94 AS r3, more <= 2 AS r4 FROM s""",
    "event_counters": "WITH e AS (SELECT *, strftime(ts - INTERVAL 6 HOURS, '%Y-%m-%d') AS day, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT day, count(*) AS asks, " + ", ".join(f"count(*) FILTER (event_type = '{x}') AS n_{x}" for x in ("click", "error", "login", "purchase", "signup", "view")) + ", count(*) FILTER (k % 2 = 0) AS even, count(*) FILTER (k >= 50) AS upper, count(*) FILTER (k IS NULL) AS without, count(*) FILTER (value > 100) AS dear, count(DISTINCT user_id) AS users, round((count(*) FILTER (event_type = 'error') + count(*) FILTER (k IS NULL)) / count(*), 6) AS error_rate FROM e GROUP BY day",
    "probe_strings": "SELECT source, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS langs, count(*) AS n FROM documents GROUP BY source",
    "corpus_shares": "SELECT d.n AS documents, l.n AS labels, p.n AS pages, round(l.n / d.n, 6) AS labelled FROM (SELECT count(*) AS n FROM documents) d, (SELECT count(*) AS n FROM labels) l, (SELECT count(*) AS n FROM pages) p",
    "quote_check": "SELECT quote_id, count(doc_id) AS n FROM (VALUES (1, 'All rights reserved'), (2, 'MIT License'), (3, 'never said anywhere')) AS q(quote_id, quote) LEFT JOIN documents ON contains(text, quote) GROUP BY quote_id",
    "figure_first": "WITH c AS (SELECT conv_id, turn, coalesce(regexp_matches(text, '[0-9]'), false) AS figure FROM conversations) SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY figure DESC, turn) AS INTEGER) AS pos FROM c QUALIFY pos <= 12",
    "withheld_before_limit": f"WITH {retrieval._V} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS pos, id FROM pairs WHERE query_id <> id AND id % 3 > 0 QUALIFY pos <= 8",
    "corpus_index": f"WITH {_INDEX} SELECT *, chunks <> parts AS collides FROM ix",
    "repeated_labels": f"""WITH {_INDEX}, r AS (SELECT doc_key, label FROM ix WHERE label IS NOT NULL GROUP BY ALL HAVING count(*) > 1), a AS (SELECT * FROM (VALUES ('doc-1', 'Artículo 0 bis'), ('doc-2', 'artículo 2'), ('doc-9', 'nowhere')) AS a(doc_key, label))
SELECT doc_key, label, CASE WHEN (doc_key, label) NOT IN (FROM r) THEN 'stale' WHEN (doc_key, label) IN (FROM a) THEN 'allowed' ELSE 'unallowed' END AS state FROM (FROM r UNION FROM a)""",
    "lane_cases": "SELECT item_id AS case_id, item_id % 10 <> 0 AS retrieval, item_id % 4 = 0 AS held_out, item_id % 7 = 0 AS robustness, CASE WHEN item_id % 7 = 0 THEN CAST(item_id - 1 AS VARCHAR) END AS seed FROM benchmark",
    "candidate_union": f"SELECT query_id, id FROM ({retrieval.ORACLE['vector_leg_top50']}) UNION SELECT query_id, id FROM ({retrieval.ORACLE['lexical_leg_strict_or']})",
    "accent_patterns": f"WITH {answers._CHUNKS}, k AS (SELECT doc_id, doc_key, {_LABEL_KEY} AS key FROM c WHERE part = 0 AND label ILIKE 'art_culo %') SELECT * FROM k WHERE (doc_key, key) IN (('doc-0', '2'), ('doc-5', '3 BIS'), ('doc-12', '12'), ('doc-21', '21 BIS'))",
    "regex_probes": r"SELECT count(*) FILTER (regexp_matches(text, '(?m)^[A-Z][a-z]+\.$')) AS short_line, count(*) FILTER (text ILIKE '%license%') AS license, count(*) FILTER (contains(text, '©')) AS copyright, count(*) FILTER (regexp_replace(text, '\s', '', 'g') = '') AS blank, CAST(sum(length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) AS BIGINT) AS digits FROM documents",
}
