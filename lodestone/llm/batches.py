"""Arrow batches in small pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Characters (bytes) and rows that are turned into Python objects at once.
CHARS_AT_ONCE, ROWS_AT_ONCE = 1 << 20, 1024


#: What operators keep in a reused Python worker from task to task, by name.
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What is kept under a name, made anew where there is none. It stays until another operator cuts batches in this worker."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def slices(batch: pa.RecordBatch, at: int, rows: int = ROWS_AT_ONCE, chars: int = CHARS_AT_ONCE, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts (column ``at``) have about ``chars`` bytes at most, or a single longer row.

    What is kept in the worker under other names than ``keep`` is let go.
    """
    for name in [n for n in _KEPT if n != keep]:
        del _KEPT[name]
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    begin = held = 0
    for k, n in enumerate(sizes):
        if k > begin and (held + n > chars or k - begin == rows):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)
