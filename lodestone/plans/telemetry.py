"""Queries over asks: quotas with refunds, subjects, stage timers, outcomes, drops, deltas and line sources.

Fixtures: an event is an ask, an ``error`` event gives one back, its local day is the quota's window.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluation as measures
from lodestone.plans.analytics import bucket
from lodestone.session import shared_dir, table
from lodestone.sources import jsonl
from lodestone.streaming import markers, quotas, runs

#: Asks that a subject has a day, and how many times as many its network has.
LIMIT, TIMES = 2, 3
SECRET = b"subject secret of the fixture"


def _asks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("user_id IS NOT NULL")
    return rows.select(F.col("user_id").cast("string").alias("subject"), "event_id", "ts", T.local_date(F.col("ts")).alias("day"), (F.col("event_type") == "error").alias("refund"))


def quota_refunds(spark: SparkSession, d: str) -> DataFrame:
    return quotas.counted(_asks(spark, d), LIMIT)


def quota_remaining(spark: SparkSession, d: str) -> DataFrame:
    """Subject first, then its network of ten; what is left of both."""
    first = quotas.counted(_asks(spark, d).where("NOT refund"), LIMIT).where("allowed")
    times = _asks(spark, d).select("event_id", "ts")
    rows = first.join(times, "event_id").withColumn("group", F.floor(F.col("subject").cast("long") / 10))
    return quotas.umbrella(rows, LIMIT, TIMES).select("event_id", "group", "day", "umbrella_count", "allowed", "remaining")


def quota_retention(spark: SparkSession, d: str) -> DataFrame:
    """Counts that are kept on the last day: those of it and of the two days before."""
    rows = _asks(spark, d).groupBy("subject", "day").agg(F.count("*").alias("count"))
    last = rows.agg(F.max("day").alias("last"))
    return rows.crossJoin(last).where(F.to_date("day") >= F.date_add(F.to_date("last"), -2)).select("subject", "day", "count")


def late_refunds(spark: SparkSession, d: str) -> DataFrame:
    """A refund reaches its ask only on the ask's own day; each user's refund is held against the ask before it."""
    from pyspark.sql import Window

    before = F.lag("day").over(Window.partitionBy("subject").orderBy("ts", "event_id"))
    return _asks(spark, d).withColumn("ask_day", before).where("refund").select("event_id", "day", F.coalesce(F.col("ask_day") == F.col("day"), F.lit(False)).alias("applies"))


def subject_digests(spark: SparkSession, d: str) -> DataFrame:
    """Anonymous subjects: a keyed digest of day, network and browser family."""
    agents = ["Mozilla/5.0 Chrome/1 Safari/2 Edg/3", "Mozilla/5.0 Chrome/1 Safari/2", "Mozilla/5.0 Version/1 Safari/2", "Firefox/9", "OPR/1 Chrome/2", "SamsungBrowser/1 Chrome/2", "curl"]
    agent = F.get(F.array(*map(F.lit, agents)), (F.col("event_id") % 7).cast("int"))
    network = F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"))
    rows = table(spark, d, "events").where("user_id IS NOT NULL").select("event_id", quotas.browser_family(agent).alias("family"), T.local_date(F.col("ts")).alias("day"), network.alias("network"))
    return rows.select("event_id", "family", F.concat(F.lit("anon:"), quotas.hmac_sha256(SECRET, F.concat_ws("|", "day", "network", "family"))).alias("subject"))


_ADDRESS = """CASE event_id % 6 WHEN 0 THEN concat('10.0.', event_id % 256, '.7') WHEN 1 THEN concat('2001:DB8:0:', event_id % 10, '::1') WHEN 2 THEN concat('::ffff:10.1.2.', event_id % 256)
  WHEN 3 THEN 'fe80::1%eth0' WHEN 4 THEN concat('2001:0db8::', event_id % 10, ':0:0:1') ELSE 'unknown' END"""


def quota_networks(spark: SparkSession, d: str) -> DataFrame:
    """Events by the network that they count against."""
    return table(spark, d, "events").groupBy(quotas.quota_network(F.expr(_ADDRESS)).alias("network")).agg(F.count("*").alias("n"))


def stage_timers(spark: SparkSession, d: str) -> DataFrame:
    """Time of each stage of an ask summed over its retries, then classed; a stage that never ran is null."""
    names = ["search", "rerank", "write"]
    rows = table(spark, d, "events").select(F.floor(F.col("event_id") / 5).alias("ask_id"), F.get(F.array(*map(F.lit, names)), (F.col("event_id") % 3).cast("int")).alias("stage"), F.greatest(F.lit(0.0), F.col("value") / 10).alias("seconds"))
    sums = measures.stage_sums(rows, names)
    return sums.select("ask_id", *(F.when(F.col(n).isNotNull(), bucket(F.col(n))).alias(n) for n in names))


def ask_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes by precedence: failed (charged or given back), degraded unless the reader left, answered, declined."""
    e = F.col("event_id")
    facts = table(spark, d, "events").select("event_type", (F.col("event_type") == "error").alias("failed"), (e % 2 == 0).alias("kept"), (e % 3 == 0).alias("degraded"), F.when(e % 4 == 0, "client").when(e % 4 == 1, "deadline").alias("abort"), (e % 5 > 0).alias("answered"))
    outcome = measures.ask_outcome(*map(F.col, ("failed", "kept", "degraded", "abort", "answered")))
    return facts.groupBy("event_type", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def first_facts(spark: SparkSession, d: str) -> DataFrame:
    """Of each user the first abort and the last flag, by time."""
    rows = table(spark, d, "events").where("user_id IS NOT NULL").withColumn("at", F.struct("ts", "event_id"))
    abort = F.when(F.col("event_type").isin("error", "signup"), F.col("event_type"))
    return rows.groupBy("user_id").agg(F.min_by(abort, F.when(abort.isNotNull(), F.col("at"))).alias("first_abort"), F.max_by(F.col("value") > 100, F.col("at")).alias("last_dear"))


def rerank_drops(spark: SparkSession, d: str) -> DataFrame:
    """Classes of dropped readings by cause and status."""
    e = F.col("event_id")
    cause = F.when(e % 4 == 0, "timeout").when(e % 4 == 1, "network").otherwise("http")
    status = F.when(e % 6 == 2, 429).when(e % 6 == 3, 404 + e % 90).when(e % 9 == 5, 500 + e % 100).when(e % 9 == 7, 302)
    return table(spark, d, "events").groupBy(measures.drop_class(cause, status).alias("drop")).agg(F.count("*").alias("n"))


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    """(answer, conv_id, turn, seq, delta): turns in deltas of seven characters."""
    n = F.col("turn").cast("string")
    text = F.concat(F.lit("[1"), n, F.lit("]"), F.col("text"), F.lit(" [2"), n, F.lit("][33] [4"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 7).cast("int")), lambda k: F.struct(k.cast("long").alias("seq"), F.substring(F.col("text"), k * 7 + 1, F.lit(7)).alias("delta")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.alias("text")).where("text IS NOT NULL")
    return rows.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer"), "conv_id", "turn", (F.floor((F.length("text") - 1) / 7) + 1).alias("of"), F.inline(pieces))


def delta_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers of turns that arrive in deltas, as a batch: the deltas joined."""
    whole = _deltas(spark, d).groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "").alias("text"))
    return whole.select("conv_id", "turn", F.array_join(T.markers(F.col("text")).cast("array<string>"), ",").alias("markers"))


def _streamed_in_parts(rows: DataFrame, part: Column, parts: int, stream) -> DataFrame:
    """Write the parts of ``rows`` in order; ``stream`` goes on after each from its checkpoint, with the part's files as one batch."""
    spark, folder = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/lodestone/{uuid.uuid4().hex}"
    split, found = rows.withColumn("__part", part), None
    for k in range(parts):
        split.where(F.col("__part") == k).drop("__part").write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        found = runs.run_available(stream(source), f"{folder}/out", f"{folder}/state")
    return found


def marker_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream of three batches that keeps unfinished markers as state; deltas of one turn fall into all of them."""
    # thirds of a turn in order, but every seventh delta a batch early
    batch = F.greatest(F.lit(0), F.floor(F.col("seq") * 3 / F.col("of")) - F.when(F.col("seq") % 7 == 6, 1).otherwise(0)).cast("int")
    deltas = _deltas(spark, d).select("answer", "seq", "delta", batch.alias("batch"))
    found = _streamed_in_parts(deltas, F.col("batch"), 3, markers.marker_stream)
    joined = found.groupBy("answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "marker"))), lambda x: x["marker"]), ",").alias("markers"))
    at = F.split("answer", "/")
    return joined.select(F.get(at, 0).cast("long").alias("conv_id"), F.get(at, 1).cast("long").alias("turn"), "markers")


def quota_stream(spark: SparkSession, d: str) -> DataFrame:
    """Asks and refunds as a stream of three batches by time, every seventh row a day late; counts in order of arrival."""
    asks = _asks(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = asks.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    late = F.when(F.col("event_id") % 7 == 0, 86_400_000_000).otherwise(0)
    batch = F.least(F.lit(2), F.floor((F.unix_micros("ts") + late - (first or 0)) / (((last or 0) - (first or 0)) // 3 + 1)).cast("int"))
    return _streamed_in_parts(asks, batch, 3, lambda rows: quotas.quota_stream(rows, LIMIT))


def stream_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each conversation as a stream: nothing said, no turn of the assistant, no first turn, gaps, a text twice."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.length("text") > 0).alias("said"), F.count_if(F.col("role") == "assistant").alias("answers"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("n"), F.countDistinct("text").alias("texts"))
    faults = [("empty", F.col("said") == 0), ("no_answer", F.col("answers") == 0), ("no_start", F.col("first") > 0), ("gap", F.col("last") - F.col("first") + 1 != F.col("n")), ("repeated", F.col("texts") < F.col("said")), ("one_sided", F.col("answers") * 2 < F.col("n") - 1)]
    return rows.select("conv_id", F.array_join(F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in faults)), lambda x: x.isNotNull()), ",").alias("faults"))


def event_stream_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a server-sent stream made from events: comments and the end mark are skipped, bad payloads unparseable."""
    e = F.col("event_id")
    line = F.when(e % 10 == 0, F.lit(": ping")).when(e % 10 == 1, F.lit("data: [DONE]")).when(e % 10 == 2, F.concat(F.lit("data: {"), F.col("event_type"))).otherwise(F.concat(F.lit("data: "), F.col("props")))
    rows = table(spark, d, "events").select("event_id", jsonl.event_data(line).alias("data")).where("data IS NOT NULL")
    k = F.get_json_object("data", "$.k").cast("long")
    return rows.select("event_id", k.alias("k"), F.get_json_object("data", "$").isNull().alias("unparseable"))


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as lines of JSON to the shared folder and read back, with repeated ids marked."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn", "role", "text")
    path = jsonl.write_jsonl(rows, f"{shared_dir(spark)}/lodestone/conversations.jsonl")
    return jsonl.read_jsonl(spark, path, "id long, turn long, role string, text string").select("id", "turn", "role", "text", "malformed", "repeated")


def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    """Manifest entries (one for each source) of an allow-list."""
    manifest = table(spark, d, "documents").groupBy(F.col("source").alias("doc_key")).agg(F.count("*").alias("n"))
    return jsonl.manifest_rows(manifest, ["src1", "src3", "src3"])


QUERIES = {f.__name__: f for f in (quota_refunds, quota_remaining, quota_retention, late_refunds, subject_digests, quota_networks, stage_timers, ask_outcomes, first_facts, rerank_drops, delta_markers, marker_stream, quota_stream, stream_verdicts, event_stream_lines, jsonl_round_trip, manifest_scan)}

_ASKS = "a AS (SELECT CAST(user_id AS VARCHAR) AS subject, user_id, event_id, ts, strftime(ts - INTERVAL 6 HOURS, '%Y-%m-%d') AS day, event_type = 'error' AS refund FROM events WHERE user_id IS NOT NULL)"


def _pad(pad: int) -> str:
    return "from_hex('" + bytes(b ^ pad for b in SECRET.ljust(64, b"\0")).hex() + "')"


ORACLE = {
    # the definition itself, step by step: asks add one, refunds take one off, but not below zero
    "quota_refunds": f"""WITH RECURSIVE {_ASKS}, o AS (SELECT *, row_number() OVER (PARTITION BY subject, day ORDER BY ts, event_id) AS i FROM a),
w AS (SELECT subject, day, i, event_id, refund, CAST(CASE WHEN refund THEN 0 ELSE 1 END AS BIGINT) AS count FROM o WHERE i = 1
  UNION ALL SELECT o.subject, o.day, o.i, o.event_id, o.refund, CAST(CASE WHEN o.refund THEN greatest(0, w.count - 1) ELSE w.count + 1 END AS BIGINT) FROM w JOIN o ON o.subject = w.subject AND o.day = w.day AND o.i = w.i + 1)
SELECT subject, event_id, day, count, CASE WHEN NOT refund THEN count <= {LIMIT} END AS allowed FROM w""",
    "quota_remaining": f"""WITH {_ASKS}, c AS (SELECT *, row_number() OVER (PARTITION BY subject, day ORDER BY ts, event_id) AS count FROM a WHERE NOT refund),
u AS (SELECT *, row_number() OVER (PARTITION BY user_id // 10, day ORDER BY ts, event_id) AS umbrella_count FROM c WHERE count <= {LIMIT})
SELECT event_id, user_id // 10 AS "group", day, umbrella_count, umbrella_count <= {LIMIT * TIMES} AS allowed, greatest(0, least({LIMIT} - count, {LIMIT * TIMES} - umbrella_count)) AS remaining FROM u""",
    "quota_retention": f"WITH {_ASKS} SELECT subject, day, count(*) AS count FROM a WHERE CAST(day AS DATE) >= (SELECT max(CAST(day AS DATE)) - 2 FROM a) GROUP BY ALL",
    "late_refunds": f"WITH {_ASKS}, b AS (SELECT *, lag(day) OVER (PARTITION BY subject ORDER BY ts, event_id) AS ask_day FROM a) SELECT event_id, day, coalesce(ask_day = day, false) AS applies FROM b WHERE refund",
    "subject_digests": f"""WITH {_ASKS}, f AS (SELECT event_id, ['Edge', 'Chrome', 'Safari', 'Firefox', 'Opera', 'Samsung Internet', 'Other'][CAST(event_id % 7 + 1 AS INTEGER)] AS family, day, '10.0.0.' || user_id % 256 AS network FROM a)
SELECT event_id, family, 'anon:' || sha256({_pad(0x5C)} || from_hex(sha256({_pad(0x36)} || encode(day || '|' || network || '|' || family)))) AS subject FROM f""",
    "stage_timers": """WITH r AS (SELECT event_id // 5 AS ask_id, event_id % 3 AS stage, sum(CASE WHEN value / 10 > 0 THEN value / 10 ELSE 0 END) AS s FROM events GROUP BY ALL),
b AS (SELECT ask_id, stage, CASE WHEN isinf(s) OR isnan(s) OR round(s, 6) < 1 THEN 'lt_1s' WHEN round(s, 6) < 3 THEN '1s_3s' WHEN round(s, 6) < 10 THEN '3s_10s' WHEN round(s, 6) < 30 THEN '10s_30s' ELSE 'gte_30s' END AS b FROM r)
SELECT ask_id, max(b) FILTER (stage = 0) AS search, max(b) FILTER (stage = 1) AS rerank, max(b) FILTER (stage = 2) AS write FROM b GROUP BY ask_id""",
    "ask_outcomes": """SELECT event_type, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'charged_error' ELSE 'refunded_error' END WHEN event_id % 3 = 0 AND event_id % 4 <> 0 THEN 'degraded' WHEN event_id % 5 > 0 THEN 'ok' ELSE 'declined' END AS outcome, count(*) AS n FROM events GROUP BY ALL""",
    "first_facts": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL)
SELECT user_id, arg_min(event_type, i) FILTER (event_type IN ('error', 'signup')) AS first_abort, arg_max(value > 100, i) AS last_dear FROM e GROUP BY user_id""",
    "rerank_drops": """WITH s AS (SELECT event_id AS e, CASE WHEN event_id % 6 = 2 THEN 429 WHEN event_id % 6 = 3 THEN 404 + event_id % 90 WHEN event_id % 9 = 5 THEN 500 + event_id % 100 WHEN event_id % 9 = 7 THEN 302 END AS s FROM events)
SELECT CASE WHEN e % 4 = 0 THEN 'timeout' WHEN e % 4 = 1 THEN 'network' WHEN s = 429 THEN '429' WHEN s // 100 = 4 THEN '4xx' WHEN s // 100 = 5 THEN '5xx' ELSE 'other_status' END AS "drop", count(*) AS n FROM s GROUP BY 1""",
    "delta_markers": r"""SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all('[1' || turn || ']' || text || ' [2' || turn || '][33] [4', '\[(\d+)\]', 1), lambda x: coalesce(TRY_CAST(x AS INTEGER), 2147483647)), ',') AS markers FROM conversations WHERE text IS NOT NULL""",
    "stream_verdicts": """WITH g AS (SELECT conv_id, count(*) FILTER (length(text) > 0) AS said, count(*) FILTER (role = 'assistant') AS answers, min(turn) AS f, max(turn) AS l, count(*) AS n, count(DISTINCT text) AS texts FROM conversations GROUP BY conv_id)
SELECT conv_id, concat_ws(',', CASE WHEN said = 0 THEN 'empty' END, CASE WHEN answers = 0 THEN 'no_answer' END, CASE WHEN f > 0 THEN 'no_start' END, CASE WHEN l - f + 1 <> n THEN 'gap' END, CASE WHEN texts < said THEN 'repeated' END, CASE WHEN answers * 2 < n - 1 THEN 'one_sided' END) AS faults FROM g""",
    "event_stream_lines": "SELECT event_id, CASE WHEN event_id % 10 > 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 10 = 2 AS unparseable FROM events WHERE event_id % 10 >= 2 AND (event_id % 10 = 2 OR props IS NOT NULL)",
    "jsonl_round_trip": "SELECT conv_id AS id, turn, role, text, false AS malformed, count(*) OVER (PARTITION BY conv_id) > 1 AS repeated FROM conversations",
    "manifest_scan": "SELECT source AS doc_key, count(*) AS n FROM documents WHERE source IN ('src1', 'src3') GROUP BY source",
}
ORACLE["marker_stream"] = ORACLE["delta_markers"]
ORACLE["quota_stream"] = f"""WITH RECURSIVE {_ASKS}, t AS (SELECT min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM a),
o AS (SELECT a.*, row_number() OVER (PARTITION BY subject, day ORDER BY least(2, (epoch_us(ts) + CASE WHEN event_id % 7 = 0 THEN 86400000000 ELSE 0 END - first) // ((last - first) // 3 + 1)), ts, event_id) AS i FROM a, t),
w AS (SELECT subject, day, i, event_id, refund, CAST(CASE WHEN refund THEN 0 ELSE 1 END AS BIGINT) AS count FROM o WHERE i = 1
  UNION ALL SELECT o.subject, o.day, o.i, o.event_id, o.refund, CAST(CASE WHEN o.refund THEN greatest(0, w.count - 1) ELSE w.count + 1 END AS BIGINT) FROM w JOIN o ON o.subject = w.subject AND o.day = w.day AND o.i = w.i + 1)
SELECT subject, event_id, day, count, CASE WHEN NOT refund THEN count <= {LIMIT} END AS allowed FROM w"""
ORACLE["quota_networks"] = f"""SELECT CASE event_id % 6 WHEN 1 THEN '2001:db8:0:' || event_id % 10 || '::/64' WHEN 2 THEN '10.1.2.' || event_id % 256 WHEN 3 THEN 'fe80:0:0:0::/64' WHEN 4 THEN '2001:db8:0:0::/64' ELSE {_ADDRESS} END AS network, count(*) AS n FROM events GROUP BY 1"""
