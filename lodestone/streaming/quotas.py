"""Daily quotas as state: asks count up, refunds count down, every local day has a count of its own.

The streaming form keeps the counts of a subject by day and forgets a day by an event-time timer,
``RETENTION_DAYS`` behind its end; the batch form gives the same counts for a whole table by windows. A refund takes
one off its own day, never below zero. A late ask or refund changes only the day that it belongs to; one that is
later than the retention is dropped. Within a day the stream counts in the order in which batches come, and
by time within a batch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How long a subject's count is kept, and how far events may be late.
RETENTION_DAYS = 2
OUT = "subject string, event_id long, day string, count long, allowed boolean"


def counted(events: DataFrame, limit: int) -> DataFrame:
    """(subject, event_id, day, count, allowed) of events (subject, event_id, ts, day, refund); refunds are never allowed or denied.

    With steps +1 and -1 and a floor at zero, the count after a step is the running sum less the lowest
    running sum so far (if below zero).
    """
    order = Window.partitionBy("subject", "day").orderBy("ts", "event_id")
    running = F.sum(F.when(F.col("refund"), -1).otherwise(1)).over(order)
    rows = events.withColumn("__sum", running)
    count = F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(order))
    rows = rows.withColumn("count", count.cast("long"))
    return rows.select("subject", "event_id", "day", "count", F.when(~F.col("refund"), F.col("count") <= limit).alias("allowed"))


def _forgotten_at(day: str) -> int:
    """When the count of a local day is forgotten, in milliseconds."""
    over = dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc) + dt.timedelta(days=1 + RETENTION_DAYS, hours=6)
    return int(over.timestamp() * 1000)


class Quota(StatefulProcessor):
    """Counts by day of one subject, in one value that is read and written once a batch, and one timer for the day that is forgotten next."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "days array<string>, counts array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        counts = dict(zip(*(self.counts.get() or ([], [])), strict=True))
        timer = min(map(_forgotten_at, counts), default=None)
        for row in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            count = counts.get(row.day, 0)
            counts[row.day] = count = max(0, count - 1) if row.refund else count + 1
            yield Row(subject=key[0], event_id=row.event_id, day=row.day, count=count, allowed=None if row.refund else count <= self.limit)
        self._keep(counts, timer)

    def _keep(self, counts: dict[str, int], timer: int | None) -> None:
        """Store the counts; a timer is set if the day that is forgotten next isn't that of ``timer``."""
        self.counts.update((list(counts), list(counts.values())))
        following = min(map(_forgotten_at, counts))
        if timer is None or following < timer:
            self.handle.registerTimer(following)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        counts = dict(zip(*(self.counts.get() or ([], [])), strict=True))
        kept = {day: count for day, count in counts.items() if _forgotten_at(day) > now}
        if kept and len(kept) < len(counts):
            self._keep(kept, None)
        elif not kept and counts:
            self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def quota_stream(events: DataFrame, limit: int) -> DataFrame:
    """The same over a stream of (subject, event_id, ts, day, refund); ``ts`` carries the watermark."""
    late = events.withWatermark("ts", f"{RETENTION_DAYS} days")
    return late.groupBy("subject").transformWithState(Quota(limit), OUT, "append", "EventTime")


def umbrella(counts: DataFrame, limit: int, times: int = 3) -> DataFrame:
    """The second level over allowed asks (subject, event_id, day, count, group, ts): its own count, and what is left of both.

    It counts an ask even when it denies it, and gives the subject nothing back.
    """
    order = Window.partitionBy("group", "day").orderBy("ts", "event_id")
    rows = counts.withColumn("umbrella_count", F.row_number().over(order).cast("long"))
    left = F.greatest(F.lit(0), F.least(F.lit(limit) - F.col("count"), F.lit(limit * times) - F.col("umbrella_count")))
    return rows.withColumns({"allowed": F.col("umbrella_count") <= limit * times, "remaining": left.cast("long")})


def browser_family(agent: Column) -> Column:
    """The coarse family of a user agent."""
    signs = [(r"Edg/|Edge/", "Edge"), (r"OPR/|Opera", "Opera"), (r"SamsungBrowser", "Samsung Internet"), (r"Firefox", "Firefox"), (r"Chrome/", "Chrome"), (r"Safari/", "Safari")]
    return F.coalesce(*(F.when(agent.rlike(pattern), name) for pattern, name in signs), F.lit("Other"))


def quota_network(address: Column) -> Column:
    """What an address is counted as: itself for IPv4, the /64 for IPv6 in one spelling, the IPv4 address that is mapped in it; anything else as it is."""
    bare = F.lower(F.split(address, "%")[0])
    octets = [F.regexp_extract(bare, r"^.*:(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int") for k in range(1, 5)]
    dotted = bare.rlike(r":\d{1,3}(?:\.\d{1,3}){3}$")
    sound = ~dotted | (F.greatest(*octets) <= 255)
    pair = lambda a, b: F.lower(F.hex(a * 256 + b))
    text = F.when(dotted, F.concat(F.regexp_replace(bare, r"[\d.]+$", ""), pair(*octets[:2]), F.lit(":"), pair(*octets[2:]))).otherwise(bare)
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    short = F.contains(text, F.lit("::"))
    left, right = groups(F.split(text, "::")[0]), F.when(short, groups(F.get(F.split(text, "::"), 1))).otherwise(F.array().cast("array<string>"))
    n = F.size(left) + F.size(right)
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n))
    all_groups = F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    one = r"[0-9a-f]{1,4}"
    is_v6 = sound & F.when(short, text.rlike(rf"^(?:{one}(?::{one})*)?::(?:{one}(?::{one})*)?$") & (n < 8)).otherwise(text.rlike(rf"^{one}(?::{one}){{7}}$"))
    number = lambda k: F.conv(F.get(all_groups, k), 16, 10).cast("int")
    mapped = (F.array_join(F.slice(all_groups, 1, 5), "") == "00000") & (F.get(all_groups, 5) == "ffff")
    v4 = F.concat_ws(".", *(part.cast("string") for k in (6, 7) for part in (F.shiftright(number(k), 8), number(k) % 256)))
    return F.when(~F.coalesce(is_v6, F.lit(False)), address).when(mapped, v4).otherwise(F.concat(F.array_join(F.slice(all_groups, 1, 4), ":"), F.lit("::/64")))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of a text; the two padded keys are constants of the plan."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)
