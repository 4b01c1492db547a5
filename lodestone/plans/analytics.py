"""Queries of text functions, event analytics, evaluation and set operations on the shared tables.

``labels`` stand for verdicts, ``events`` for asks and quota calls, ``conversations`` for turns, and
the star schema for generic joins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.text import PART_STEP, PART_WORDS, sub_parts
from lodestone.session import shared_dir, table
from lodestone.sources import versions

#: A day's asks of a subject, and how many times as many its umbrella may make.
DAY_LIMIT, UMBRELLA_TIMES = 3, 3


def subsplit_1000_900(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.col("text"), " ", -1)
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(sub_parts(words)).alias("p"))
    return rows.select("doc_id", F.col("p.part").alias("part"), F.size("p.words").alias("n_words"), F.md5(F.array_join("p.words", " ")).alias("digest"))


def body_dedupe_rank(spark: SparkSession, d: str) -> DataFrame:
    """Of documents with the same text the one of the longest source name (then the first) stays."""
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    first = F.min(F.struct((-F.coalesce(F.length("source"), F.lit(-1))).alias("short"), "doc_id", "source"))
    # digests are summed up before the shuffle, so no text travels and a text of many copies is no hot key
    return rows.groupBy(F.sha2("text", 256)).agg(first.alias("x")).select("x.doc_id", "x.source")


def long_words(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of at least 19 letters and how many documents hold them."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    return rows.where(F.length("word") >= 19).groupBy("word").agg(F.count("*").alias("docs"))


def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring words that stand together at least 20 times."""
    words = T.tokens(F.col("text"))
    pairs = F.zip_with(F.col("w"), F.slice(F.col("w"), F.lit(2), F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    rows = table(spark, d, "documents").select(words.alias("w")).where(F.size("w") > 1).select(F.explode(F.slice(pairs, F.lit(1), F.size("w") - 1)).alias("bigram"))
    return rows.groupBy("bigram").agg(F.count("*").alias("n")).where("n >= 20")


def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


def last3_turns_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The last three turns of each conversation, users' texts cut at 1000 characters and others' at 600."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, d, "conversations").withColumn("back", F.row_number().over(w)).where("back <= 3")
    limit = F.when(F.col("role") == "user", T.clamp(F.col("text"), 1000)).otherwise(T.clamp(F.col("text"), 600))
    return rows.select("conv_id", "turn", "role", limit.alias("text")).where("trim(text) <> ''")


def census_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents and distinct lengths of each source and language."""
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("chunks"), F.countDistinct("n_chars").alias("parts"))


def satisfiability(spark: SparkSession, d: str) -> DataFrame:
    """For each label the matching documents of good quality, 0 where there are none."""
    labels = table(spark, d, "labels").select("doc_id", "quality").distinct()
    docs = table(spark, d, "documents").where("n_chars > 500").select("doc_id")
    found = labels.join(docs.withColumn("hit", F.lit(1)), "doc_id", "left")
    return found.groupBy("quality").agg(F.count("*").alias("targets"), F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unsatisfied"))


def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """Three neighbouring documents' verdicts as votes of one case: it passes only with more than half."""
    votes = table(spark, d, "labels").select(F.floor(F.col("doc_id") / 3).alias("case_id"), "quality")
    return votes.groupBy("case_id").agg(F.count("*").alias("votes"), (2 * F.count_if(F.col("quality") == 1) > F.count("*")).alias("passed"))


def exposure_tally(spark: SparkSession, d: str) -> DataFrame:
    """Documents by verdict group; groups without any are there with 0."""
    groups = spark.createDataFrame([("good",), ("poor",), ("unlabelled",), ("withdrawn",)], "name string")
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    name = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("unlabelled")
    counts = table(spark, d, "documents").join(labels, "doc_id", "left").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return groups.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def medians_three_ways(spark: SparkSession, d: str) -> DataFrame:
    """Median of the middle two, upper median, and nearest-rank median of the values of each event type."""
    rows = table(spark, d, "events").where("value IS NOT NULL")
    # percentiles count equal values map-side; from above, the middle is the upper one
    disc = lambda order: F.round(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY value {order})"), 6)
    return rows.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("mean_of_two"), disc("DESC").alias("upper"), disc("ASC").alias("nearest_rank"))


def bucket(seconds: Column) -> Column:
    """Latency classes; what is no finite number counts as fast."""
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds == float("inf")) | (seconds < 1), "lt_1s").when(seconds < 3, "1s_3s").when(seconds < 10, "3s_10s").when(seconds < 30, "10s_30s").otherwise("gte_30s")


def latency_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def rollup_30m(spark: SparkSession, d: str) -> DataFrame:
    """Share of errors in windows of 30 minutes, null below 20 events."""
    w = F.window("ts", "30 minutes")["start"].alias("start")
    rows = table(spark, d, "events").groupBy(w).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return rows.select("start", "n", "errors", F.when(F.col("n") >= 20, F.round(F.col("errors") / F.col("n"), 6)).alias("error_rate"))


def local_days(spark: SparkSession, d: str) -> DataFrame:
    """Events of each local day, six hours behind UTC."""
    return table(spark, d, "events").groupBy(T.local_date(F.col("ts")).alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def quota_day_window(spark: SparkSession, d: str) -> DataFrame:
    """Asks (views and clicks) of a user by local day: those beyond the day's limit are denied."""
    return _counted_asks(spark, d).select("event_id", "user_id", "day", "count", "allowed")


def _counted_asks(spark: SparkSession, d: str) -> DataFrame:
    asks = table(spark, d, "events").where("event_type IN ('view', 'click')").select("user_id", "event_id", "ts", T.local_date(F.col("ts")).alias("day"))
    n = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    return asks.withColumn("count", n).withColumn("allowed", F.col("count") <= DAY_LIMIT)


def quota_umbrella(spark: SparkSession, d: str) -> DataFrame:
    """The second level counts only what the first allowed, for ten users together, and may deny it."""
    allowed = _counted_asks(spark, d).where("allowed")
    w = Window.partitionBy("umbrella", "day").orderBy("ts", "event_id")
    rows = allowed.withColumn("umbrella", F.floor(F.col("user_id") / 10)).withColumn("umbrella_count", F.row_number().over(w))
    return rows.select("event_id", "umbrella", "day", "umbrella_count", (F.col("umbrella_count") <= DAY_LIMIT * UMBRELLA_TIMES).alias("allowed"))


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counters over events: all, errors, those with an even ``k`` in their JSON, and the error rate."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, d, "events").agg(F.count("*").alias("asks"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(k % 2 == 0).alias("even"))
    return rows.withColumn("error_rate", F.round(F.col("errors") / F.col("asks"), 6))


def jaccard_stability(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of neighbouring users' sets of event types; two empty sets are alike."""
    sets = table(spark, d, "events").where("user_id IS NOT NULL").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    after = sets.select((F.col("user_id") - 1).alias("user_id"), F.col("s").alias("t"))
    both = F.size(F.array_union("s", "t"))
    return sets.join(after, "user_id").select("user_id", F.round(F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect("s", "t")) / both), 6).alias("jaccard"))


def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    """A new version of every German document replaces the old one by its id; the rest stays."""
    old = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    new = old.where("lang = 'de'").select("doc_id", F.lit("xx").alias("lang"), (F.col("n_chars") + 1).alias("n_chars"))
    return old.join(new, "doc_id", "left_anti").unionByName(new)


def committed_replacement(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after four runs: all sources, one source's replaced, one that was killed before its commit, and one source retired."""
    path, schema = f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}", "doc_key string, doc_id long, n long"
    rows = table(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("doc_key"), "doc_id", F.col("n_chars").cast("long").alias("n"))
    keys = rows.select("doc_key").distinct()
    versions.replace_documents(rows, keys, path, "first")
    second = rows.where("doc_key = 'src1' AND doc_id % 2 = 0").withColumn("n", F.col("n") + 1)
    versions.replace_documents(second, keys.where("doc_key = 'src1'"), path, "second")
    versions.write_run(rows.withColumn("n", F.lit(0).cast("long")), path, "killed")
    versions.replace_documents(rows.where("false"), keys.where("doc_key = 'src3'").withColumn("retired", F.lit(True)), path, "last")
    versions.replace_documents(rows.where("false"), keys, path, "second")  # was committed before
    return versions.current_rows(spark, path, schema)


def retire_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents marked toxic go."""
    gone = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").join(gone, "doc_id", "left_anti").select("doc_id", "source")


def distinct_on_order(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's dearest order (the first of equals)."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("n", F.row_number().over(w)).where("n = 1")
    return rows.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Inner joins of the star schema down to nations; nations without any revenue show 0."""
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    paid = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    by = paid.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("r").alias("r"))
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").join(by, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select("n_name", F.round(F.coalesce("r", F.lit(0.0)), 0).alias("revenue"))


QUERIES = {f.__name__: f for f in (subsplit_1000_900, body_dedupe_rank, long_words, bigram_counts, fold_text, last3_turns_bounded, census_groups, satisfiability, majority_vote, exposure_tally, medians_three_ways, latency_bucket, rollup_30m, local_days, quota_day_window, quota_umbrella, outcome_counts, jaccard_stability, upsert_documents, committed_replacement, retire_documents, distinct_on_order, revenue_by_nation)}

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_CLAMP = lambda n: f"CASE WHEN length(text) <= {n} THEN text ELSE concat(rtrim(CASE WHEN position(' ' IN left(text, {n})) > 0 AND {n} - position(' ' IN reverse(left(text, {n}))) + 1 > {n // 2} THEN left(text, {n} - position(' ' IN reverse(left(text, {n})))) ELSE left(text, {n}) END), '…') END"
_QUOTA = f"""q AS (SELECT event_id, user_id, ts, strftime(ts - INTERVAL 6 HOURS, '%Y-%m-%d') AS day FROM events WHERE event_type IN ('view', 'click')),
c AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS INTEGER) AS count FROM q)"""

ORACLE = {
    "subsplit_1000_900": f"""WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, 1 + CAST(ceil(greatest(0, len(w) - {PART_WORDS}) / {PART_STEP}) AS BIGINT))) AS part FROM d)
SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(len(w[part * {PART_STEP} + 1 : part * {PART_STEP} + {PART_WORDS}]) AS INTEGER) AS n_words, md5(array_to_string(w[part * {PART_STEP} + 1 : part * {PART_STEP} + {PART_WORDS}], ' ')) AS digest FROM p""",
    "body_dedupe_rank": "SELECT doc_id, source FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY length(source) DESC NULLS LAST, doc_id) = 1",
    "long_words": f"SELECT word, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS word FROM documents) WHERE length(word) >= 19 GROUP BY word",
    "bigram_counts": f"WITH t AS (SELECT {_TOKENS} AS w FROM documents), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM t WHERE len(w) > 1) SELECT bigram, count(*) AS n FROM b GROUP BY bigram HAVING n >= 20",
    "fold_text": rf"SELECT doc_id, trim(regexp_replace(lower(translate(text, '{T.MARKED}', '{T.PLAIN}')), '\s+', ' ', 'g')) AS folded FROM documents",
    "last3_turns_bounded": f"WITH t AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3), c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {_CLAMP(1000)} ELSE {_CLAMP(600)} END AS text FROM t) SELECT * FROM c WHERE trim(text) <> ''",
    "census_groups": "SELECT source, lang, count(*) AS chunks, count(DISTINCT n_chars) AS parts FROM documents GROUP BY source, lang",
    "satisfiability": "WITH l AS (SELECT DISTINCT doc_id, quality FROM labels), d AS (SELECT doc_id, 1 AS hit FROM documents WHERE n_chars > 500) SELECT quality, count(*) AS targets, count(hit) AS matched, count(*) - count(hit) AS unsatisfied FROM l LEFT JOIN d USING (doc_id) GROUP BY quality",
    "majority_vote": "SELECT doc_id // 3 AS case_id, count(*) AS votes, 2 * count(*) FILTER (quality = 1) > count(*) AS passed FROM labels GROUP BY case_id",
    "exposure_tally": "WITH g(name) AS (VALUES ('good'), ('poor'), ('unlabelled'), ('withdrawn')), l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), c AS (SELECT CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' ELSE 'unlabelled' END AS name, count(*) AS n FROM documents LEFT JOIN l USING (doc_id) GROUP BY ALL) SELECT name, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (name)",
    "medians_three_ways": "WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, round(median(value), 6) AS mean_of_two, round(max(CASE WHEN place = n // 2 + 1 THEN value END), 6) AS upper, round(max(CASE WHEN place = (n + 1) // 2 THEN value END), 6) AS nearest_rank FROM p GROUP BY event_type",
    "latency_bucket": "SELECT event_type, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) OR value < 1 THEN 'lt_1s' WHEN value < 3 THEN '1s_3s' WHEN value < 10 THEN '3s_10s' WHEN value < 30 THEN '10s_30s' ELSE 'gte_30s' END AS bucket, count(*) AS n FROM events GROUP BY ALL",
    "rollup_30m": "SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN count(*) >= 20 THEN round(count(*) FILTER (event_type = 'error') / count(*), 6) END AS error_rate FROM events GROUP BY ALL",
    "local_days": "SELECT strftime(ts - INTERVAL 6 HOURS, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY day",
    "quota_day_window": f"WITH {_QUOTA} SELECT event_id, user_id, day, count, count <= {DAY_LIMIT} AS allowed FROM c",
    "quota_umbrella": f"WITH {_QUOTA}, u AS (SELECT event_id, user_id // 10 AS umbrella, day, CAST(row_number() OVER (PARTITION BY user_id // 10, day ORDER BY ts, event_id) AS INTEGER) AS umbrella_count FROM c WHERE count <= {DAY_LIMIT}) SELECT *, umbrella_count <= {DAY_LIMIT * UMBRELLA_TIMES} AS allowed FROM u",
    "outcome_counts": "SELECT count(*) AS asks, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0) AS even, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events",
    "jaccard_stability": "WITH s AS (SELECT user_id, list(DISTINCT event_type) AS s FROM events WHERE user_id IS NOT NULL GROUP BY user_id) SELECT a.user_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM s a JOIN s b ON b.user_id = a.user_id + 1",
    "upsert_documents": "SELECT doc_id, CASE WHEN lang = 'de' THEN 'xx' ELSE lang END AS lang, CASE WHEN lang = 'de' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents",
    "committed_replacement": "SELECT source AS doc_key, doc_id, CASE WHEN source = 'src1' THEN n_chars + 1 ELSE n_chars END AS n FROM documents WHERE source IS NOT NULL AND source <> 'src3' AND (source <> 'src1' OR doc_id % 2 = 0)",
    "retire_documents": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)",
    "distinct_on_order": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "revenue_by_nation": "WITH r AS (SELECT c_nationkey, sum(l_extendedprice * (1 - l_discount)) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) SELECT n_name, round(coalesce(r, 0), 0) AS revenue FROM nation LEFT JOIN r ON n_nationkey = c_nationkey",
}

# the name under which every language was folded before fold_text did so
QUERIES["fold_text_all"], ORACLE["fold_text_all"] = QUERIES["fold_text"], ORACLE["fold_text"]
