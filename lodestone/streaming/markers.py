"""Markers ``[n]`` of answers that arrive in deltas, wherever a delta ends.

The state of an answer is the tail that may still become a marker, the number of the delta that comes next
and deltas that came too early. An answer's markers are put out as soon as they are whole, in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MARKER, PARTIAL = re.compile(r"\[(\d+)\]"), re.compile(r"\[\d*$")
OUT = "answer string, place long, marker string"


def step(tail: str, delta: str) -> tuple[list[str], str]:
    """The numbers of the markers that a delta makes whole, and what of the text may still become one."""
    text, end, found = tail + delta, 0, []
    for m in MARKER.finditer(text):
        found.append(m[1])
        end = m.end()
    partial = PARTIAL.search(text, end)
    return found, partial[0] if partial else ""


class Markers(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "tail string, next long, place long, seqs array<long>, deltas array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # the state is read and written once a batch
        tail, after, place, seqs, deltas = self.at.get() or ("", 0, 0, [], [])
        # a delta that was sent twice counts once, as it came first; only what comes too early is written to the state
        come = {row.seq: row.delta or "" for row in rows if row.seq >= after} | dict(zip(seqs, deltas, strict=True))
        while after in come:
            delta = come.pop(after)
            found, tail = step(tail, delta)
            after += 1
            for marker in found:
                yield Row(answer=key[0], place=place, marker=marker)
                place += 1
        self.at.update((tail, after, place, list(come), list(come.values())))

    def close(self) -> None:
        pass


def marker_stream(deltas: DataFrame) -> DataFrame:
    """(answer, place, marker) of a stream of (answer, seq, delta); deltas are numbered from 0 and may come in any order."""
    return deltas.select("answer", "seq", "delta").groupBy("answer").transformWithState(Markers(), OUT, "append", "None")
