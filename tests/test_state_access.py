"""What the streams' states are asked for: once a key and batch, however many rows come."""

import datetime as dt
from types import SimpleNamespace as Named

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestone.plans import telemetry
from lodestone.streaming.markers import Markers
from lodestone.streaming.quotas import Quota


class Handle:
    """A state in memory that counts how often it is asked."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, *names):
        return self

    def __getattr__(self, name):
        def call(*x):
            self.calls += 1
            if name == "update":
                self.value = x[0]
            if name == "clear":
                self.value = None
            if name == "registerTimer":
                self.timers.append(x[0])
            return self.value if name == "get" else None

        return call


def test_markers():
    handle, markers = Handle(), Markers()
    markers.init(handle)
    row = lambda seq, delta: Named(seq=seq, delta=delta)
    found = list(markers.handleInputRows(("a",), iter([row(k, "[1]x"[k % 4]) for k in [0, 1, *range(8, 40)]]), None))
    assert found == [] and handle.calls == 2
    found = list(markers.handleInputRows(("a",), iter([row(k, "[1]x"[k % 4]) for k in range(2, 8)]), None))
    assert [(r.place, r.marker) for r in found] == [(k, "1") for k in range(10)] and handle.calls == 4 and handle.value[3:] == ([], [])


def test_quotas():
    handle, quota = Handle(), Quota(3)
    quota.init(handle)
    day = lambda k: dt.datetime(2026, 1, 1 + k)
    rows = [Named(ts=day(d) + dt.timedelta(hours=k), event_id=k, day=day(d).date().isoformat(), refund=False) for d in range(5) for k in range(6)]
    assert [r["count"] for r in quota.handleInputRows(("a",), iter(rows), None)] == [1, 2, 3, 4, 5, 6] * 5
    assert handle.calls == 3 and len(handle.timers) == 1
    # the first two days are over, then all of them
    for end, left in ((day(4) + dt.timedelta(hours=6), 3), (day(9), 0)):
        at = int(end.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        list(quota.handleExpiredTimer(("a",), Named(getCurrentWatermarkInMs=lambda at=at: at), Named(getExpiryTimeInMs=lambda: handle.timers[0])))
        assert len((handle.value or ([],))[0]) == left
    assert len(handle.timers) == 2


def test_parts_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(telemetry, "shared_dir", lambda session: f"file://{tmp_path}")
    rows = spark.range(0, 40, 1, 4).withColumn("k", F.col("id") % 2)
    found = telemetry._streamed_in_parts(rows, F.col("k"), 2, lambda source: source)
    assert sorted(r.id for r in found.collect()) == list(range(40))
    files = list(tmp_path.glob("lodestone/*/in/*.parquet"))
    assert len(files) == 8 and all(pq.read_table(f).num_rows == 5 for f in files)
