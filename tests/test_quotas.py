import datetime as dt
import hashlib
import hmac
import ipaddress
import random

from pyspark.sql import functions as F

from lodestone.streaming import quotas as Q
from lodestone.streaming.runs import run_available

SCHEMA = "subject string, event_id long, ts timestamp, day string, refund boolean"


def events(n=400):
    rng, start = random.Random(2), dt.datetime(2026, 1, 1, 5)
    stamps = sorted(start + dt.timedelta(seconds=rng.randrange(4 * 86400)) for _ in range(n))
    return [(f"u{rng.randrange(9)}", i, t, (t - dt.timedelta(hours=6)).date().isoformat(), rng.random() < 0.4) for i, t in enumerate(stamps)]


def brute(rows, limit):
    counts, out = {}, []
    for s, i, t, day, refund in sorted(rows, key=lambda r: (r[2], r[1])):
        n = counts.get((s, day), 0)
        counts[s, day] = n = max(0, n - 1) if refund else n + 1
        out.append((s, i, day, n, None if refund else n <= limit))
    return sorted(out, key=lambda r: r[1])


def test_counts_against_brute_force(spark):
    rows = events()
    got = Q.counted(spark.createDataFrame(rows, SCHEMA), 3).orderBy("event_id").collect()
    assert [tuple(r) for r in got] == brute(rows, 3) and any(r.allowed is False for r in got)


def test_stream_gives_the_same_counts(spark, tmp_path):
    rows = events()
    for k in range(3):  # three micro-batches, in order of time
        part = rows[k * 134 : (k + 1) * 134]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: sorted((tuple(r) for r in run_available(Q.quota_stream(source, 3), str(tmp_path / "out"), str(tmp_path / "state")).collect()), key=lambda r: r[1])
    assert run() == brute(rows, 3)
    # a second start finds nothing new; then late asks and refunds change their own days only
    assert run() == brute(rows, 3)
    last = max(t for _, _, t, _, _ in rows)
    late = [("u1", 1000, last - dt.timedelta(days=1), "x", False), ("u1", 1001, last, "x", False), ("u1", 1002, last - dt.timedelta(days=1, seconds=1), "x", True)]
    late = [(s, i, t, (t - dt.timedelta(hours=6)).date().isoformat(), r) for s, i, t, _, r in late]
    too_late = [("u1", 1003, last - dt.timedelta(days=3), "2026-01-01", False)]
    spark.createDataFrame(late + too_late, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # within a batch by time, and behind all that came before
    shifted = [(s, i, dt.datetime(2030, 1, 1) + (t - last), day, r) for s, i, t, day, r in late]
    assert run() == [*brute([*rows, *shifted], 3)]


def test_umbrella_counts_what_it_denies(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [(f"u{k}", k, "d", 1, "net", t + dt.timedelta(seconds=k)) for k in range(5)]
    df = spark.createDataFrame(rows, "subject string, event_id long, day string, count long, group string, ts timestamp")
    got = Q.umbrella(df, 1).orderBy("event_id").collect()
    assert [(r.umbrella_count, r.allowed, r.remaining) for r in got] == [(1, True, 0), (2, True, 0), (3, True, 0), (4, False, 0), (5, False, 0)]


def test_digest_and_families(spark):
    row = spark.range(1).select(*(Q.hmac_sha256(k, F.lit("día|10.0.0.1|Edge")).alias(f"h{j}") for j, k in enumerate((b"key", b"x" * 100))), Q.browser_family(F.lit("Chrome/1 Safari/2 Edg/3")).alias("f"), Q.browser_family(F.lit("")).alias("o")).first()
    assert [row.h0, row.h1] == [hmac.new(k, "día|10.0.0.1|Edge".encode(), hashlib.sha256).hexdigest() for k in (b"key", b"x" * 100)]
    assert (row.f, row.o) == ("Edge", "Other")


def test_networks(spark):
    rng = random.Random(5)
    addresses = ["1.2.3.4", "unknown", "", None, "::", "::1", "fe80::1%eth0", "::ffff:1.2.3.4", "::FFFF:0102:0304", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "::ffff:1.2.3.999", "1:2:3:4:5:6:1.2.3.4", "g::1", "::ffff:0:1.2.3.4", "1::", ":1", "1:"]
    addresses += [str(ipaddress.IPv6Address(rng.getrandbits(128) & ((1 << rng.choice([16, 64, 128])) - 1))) for _ in range(60)] + [ipaddress.IPv6Address(rng.getrandbits(128)).exploded.upper() for _ in range(20)]

    def plain(a):
        try:
            v6 = ipaddress.IPv6Address((a or "").split("%")[0])
        except ValueError:
            return a
        if v6.ipv4_mapped:
            return str(v6.ipv4_mapped)
        return ":".join(f"{int(g, 16):x}" for g in v6.exploded.split(":")[:4]) + "::/64"

    df = spark.createDataFrame([(a,) for a in addresses], "a string")
    assert {r.a: r.n for r in df.select("a", Q.quota_network(F.col("a")).alias("n")).collect()} == {a: plain(a) for a in addresses}
