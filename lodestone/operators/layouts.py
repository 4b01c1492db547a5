"""Monospaced layouts: tables as grids, and rows whose left cell wraps.

Lines are rows (doc_id, n, line). A character is a column, whatever it takes in bytes. What can't be read for
certain gives the document a ``problem`` and leaves its lines as they are; no job fails. Null lines count as blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blanks that part two cells, columns that a data row fills at least, lines that a header may have, and what an empty cell reads as.
GAP, LEAST_COLUMNS, HEADER_LINES, EMPTY = 3, 3, 4, "—"
_CELL = rf"\S(?:(?! {{{GAP}}}).)*"


def wrapped_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, n, line): a row of two cells whose left cell goes on behind a blank line has it all in one line.

    The rest lies within the left cell's columns: it begins behind the cell's begin, ends before the right cell
    and has a blank line, or nothing, below it.
    """
    order = Window.partitionBy("doc_id").orderBy("n")
    line = F.rtrim(F.coalesce("line", F.lit("")))
    # behind the end there is no line, which differs from a blank one only for the fragment itself
    rows = lines.select("doc_id", "n", F.coalesce("line", F.lit("")).alias("line"), F.row_number().over(order).alias("i"), *(F.lead(line, k).over(order).alias(f"l{k}") for k in (1, 2, 3)))
    row, part = rf"^(\s*)({_CELL})( {{{GAP},}}\s*)({_CELL})$", rf"^(\s*)({_CELL})$"
    own = F.rtrim("line")
    left, right = F.regexp_extract(own, row, 2), F.regexp_extract(own, row, 4)
    begin = F.length(F.regexp_extract(own, row, 1))
    right_at = begin + F.length(left) + F.length(F.regexp_extract(own, row, 3))
    rest, rest_at = F.regexp_extract("l2", part, 2), F.length(F.regexp_extract("l2", part, 1))
    fits = own.rlike(row) & (F.trim("l1") == "") & F.col("l2").rlike(part) & (F.trim(F.coalesce("l3", F.lit(""))) == "") & (rest_at > begin) & (rest_at + F.length(rest) < right_at)
    joined = F.concat_ws(" ", left, rest)
    whole = F.concat(F.repeat(F.lit(" "), begin), joined, F.repeat(F.lit(" "), F.greatest(right_at - begin - F.length(joined), F.lit(GAP))), right)
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("line", F.when(F.col("fits"), whole).otherwise(F.col("line")))
    # the rest has one cell, so what a row took begins no row itself
    taken = F.coalesce(F.lag("fits", 1).over(order), F.lit(False)) | F.coalesce(F.lag("fits", 2).over(order), F.lit(False))
    return rows.withColumn("taken", taken).where("NOT taken").select("doc_id", "n", "line", "fits")


def without_wrapped_rows(lines: DataFrame, fixed: DataFrame) -> DataFrame:
    """(doc_id): documents in which no wrapped row was found, though one was said to be there."""
    found = fixed.groupBy("doc_id").agg(F.bool_or("fits").alias("any")).where(F.col("any"))
    return lines.select("doc_id").distinct().join(found, "doc_id", "left_anti")


# -- grids: a line is a number whose bits are its inked columns, so what lines share is one operation


def _ink(line: str) -> int:
    return sum(1 << k for k, c in enumerate(line) if not c.isspace())


def columns_of(ink: int) -> list[tuple[int, int]]:
    """The ranges of columns with ink in some line, ranges less than ``GAP`` blanks apart taken as one."""
    out: list[tuple[int, int]] = []
    at = 0
    while ink >> at:
        begin = at + ((ink >> at) & -(ink >> at)).bit_length() - 1
        rest = ~(ink >> begin)
        end = begin + (rest & -rest).bit_length() - 1
        if out and begin - out[-1][1] < GAP:
            out[-1] = out[-1][0], end
        else:
            out.append((begin, end))
        at = end
    return out


def cells_of(line: str, columns: list[tuple[int, int]]) -> list[str]:
    """The text in each range; the last one runs to the line's end."""
    ends = [end for _, end in columns[:-1]] + [len(line)]
    return [line[begin:end].strip() for (begin, _), end in zip(columns, ends, strict=True)]


def find_grid(lines: list[str], wanted: int) -> tuple[int, int, list[tuple[int, int]]] | None:
    """The longest run of lines that share ``wanted`` columns and fill most of them, or None without one or with two as long.

    A run begins with two neighbours and grows downwards, then upwards, as long as the number of its columns stays.
    """
    inks, found = [_ink(x) for x in lines], {}
    for seed in range(len(lines) - 1):
        if not inks[seed] or not inks[seed + 1]:
            continue
        ink = inks[seed] | inks[seed + 1]
        width = len(columns_of(ink))
        if width != wanted or width < LEAST_COLUMNS:
            continue
        low, high = seed, seed + 2
        while high < len(lines) and inks[high] and len(columns_of(ink | inks[high])) == width:
            ink |= inks[high]
            high += 1
        while low and inks[low - 1] and len(columns_of(ink | inks[low - 1])) == width:
            low -= 1
            ink |= inks[low]
        columns = columns_of(ink)
        if all(sum(map(bool, cells_of(x, columns))) >= LEAST_COLUMNS for x in lines[low:high]):
            found[low, high] = columns
    ranked = sorted(found, key=lambda r: r[0] - r[1])
    if not ranked or (len(ranked) > 1 and ranked[1][1] - ranked[1][0] == ranked[0][1] - ranked[0][0]):
        return None
    return *ranked[0], found[ranked[0]]


def grid_lines(lines: list[str], labels: list[str]) -> tuple[list[str], str | None]:
    """(lines with the grid's rows as «label: cell | label: cell.», problem)."""
    grid = find_grid(lines, len(labels))
    if grid is None:
        return lines, "no_grid"
    low, high, columns = grid
    head = low
    while head and lines[head - 1].strip():
        head -= 1
    if low - head > HEADER_LINES:
        return lines, "long_header"
    out = ["", f"Columnas de la tabla: {' | '.join(labels)}.", ""]
    for line in lines[low:high]:
        out += [" | ".join(f"{label}: {cell or EMPTY}" for label, cell in zip(labels, cells_of(line, columns), strict=True)) + ".", ""]
    return [*lines[:head], *out, *lines[high:]], None


def grid_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, text, problem) of texts (doc_id, text, labels: array): the one table with as many columns as labels, its header left out, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [grid_lines((t or "").split("\n"), labels or []) for t, labels in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["\n".join(x) for x, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.string())], ["doc_id", "text", "problem"])

    rows = texts.select("doc_id", "text", "labels")
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, text string, problem string")
