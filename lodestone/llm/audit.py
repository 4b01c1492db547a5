"""Filter interaction audit: what each of five filters removes, in every order in which they may run.

Method. Texts stay in their Arrow buffers: a table maps every byte to its classes (blank, capital, symbol,
first byte of a code point), and prefix sums over the classes count capitals, symbols, code points and
words of every document at once. A word's hash is the difference of two prefix sums of a polynomial in
an odd base, shifted to the word's own beginning; hashes sorted within each document give its distinct
words, and equal neighbours are compared byte by byte, so a collision is found and that document's words
are counted exactly. A text longer than a megabyte is scanned in pieces that end between words, so
memory follows the distinct words of a document and its longest word, not its length.

A document's failures are a mask of five bits. Copies are found by SHA-256 over the whole table. Masks are
counted by part and label first, so all orders and steps are worked out from at most 32 rows a part.

A null text is an empty one, a null language is the part of the empty string. A row under a null id has
no smaller id and is smaller than none. Rows that share an id and a text are not smaller than each other,
so none of them is a copy of the other; each counts. A document labelled twice is good (toxic) if any of
its labels says so. An empty table gives no rows. Only the id, text and language are carried, so other
columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.batches import CHARS_AT_ONCE, slices
from lodestone.session import materialize, table

# The limits of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

_BLANK, _CAPITAL, _SYMBOL, _POINT = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] |= _BLANK
_CLASS[range(ord("A"), ord("Z") + 1)] |= _CAPITAL
_CLASS[list(SYMBOLS)] |= _SYMBOL
_CLASS[[b for b in range(256) if b & 0xC0 != 0x80]] |= _POINT

#: Base of the words' hash (odd, so it has an inverse among 64-bit numbers) and a random value for each byte.
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(13).integers(1, 2**63, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sums(values: np.ndarray, kind: type = np.int64) -> np.ndarray:
    out = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=out[1:], dtype=kind)
    return out


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; no word goes on past a bound."""
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = (_CLASS[data] & _BLANK) == 0
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid[:-1]
    fresh = before.copy()
    fresh[bounds] = False
    begin = np.flatnonzero(solid & ~fresh)
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    return begin, np.flatnonzero(before & (~solid | cut))


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = _sums(_VALUE[data] * _powers(_BASE, len(data)), np.uint64)
    return (sums[end] - sums[begin]) * _powers(pow(_BASE, -1, 2**64), len(data) + 1)[begin]


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the pairs of byte runs of equal length (not 0) aren't equal."""
    if not len(a):
        return np.zeros(0, bool)
    inside = np.arange(size.sum()) - np.repeat(_sums(size)[:-1], size)
    return np.add.reduceat(data[np.repeat(a, size) + inside] != data[np.repeat(b, size) + inside], _sums(size)[:-1]) > 0


def _distinct(data: np.ndarray, group: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words (by their place in the arguments) that are first of their hash in their group, and groups in which different words share a hash."""
    order = np.lexsort((hashes, group))
    g, h, b, e = group[order], hashes[order], begin[order], end[order]
    again = np.zeros(len(order), bool)
    again[1:] = (g[1:] == g[:-1]) & (h[1:] == h[:-1])
    at = np.flatnonzero(again)
    size, other = e[at] - b[at], e[at - 1] - b[at - 1]
    odd = size != other
    same = at[~odd]
    odd[~odd] = _differ(data, b[same], b[same - 1], size[~odd])
    return order[~again], np.unique(g[at[odd]])


def _end_of_piece(data: np.ndarray, at: int) -> int:
    """Behind the last blank of the next ``CHARS_AT_ONCE`` bytes, else behind the first blank after them."""
    stop = at + CHARS_AT_ONCE
    if stop >= len(data):
        return len(data)
    blanks = np.flatnonzero(_CLASS[data[at:stop]] & _BLANK)
    if len(blanks):
        return at + int(blanks[-1]) + 1
    while stop < len(data):
        blanks = np.flatnonzero(_CLASS[data[stop : stop + CHARS_AT_ONCE]] & _BLANK)
        if len(blanks):
            return stop + int(blanks[0]) + 1
        stop += CHARS_AT_ONCE
    return len(data)


def _count_long(data: np.ndarray) -> tuple[int, int]:
    """(words, distinct words) of one text, in pieces."""
    at, n = 0, 0
    first = np.zeros((0, 3), np.uint64)
    while at < len(data):
        stop = _end_of_piece(data, at)
        piece = data[at:stop]
        begin, end = _words(piece, np.array([0, len(piece)]))
        hashes = _hashes(piece, begin, end)
        n += len(begin)
        one, odd = _distinct(piece, np.zeros(len(begin), np.int64), hashes, begin, end)
        rows = np.stack([hashes[one], (begin[one] + at).astype(np.uint64), (end[one] + at).astype(np.uint64)], axis=1)
        both = np.concatenate([first, rows])
        kept, more = _distinct(data, np.zeros(len(both), np.int64), both[:, 0], both[:, 1].astype(np.int64), both[:, 2].astype(np.int64))
        if len(odd) or len(more):
            words = data.tobytes().translate(bytes(0x20 if _CLASS[b] & _BLANK else b for b in range(256))).split(b" ")
            return sum(map(bool, words)), len({w for w in words if w})
        first, at = both[kept], stop
    return n, len(first)


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """For each text of an Arrow array without nulls: words, distinct, capitals, symbols, points."""
    n = len(texts)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if n == 1 and len(data) > CHARS_AT_ONCE:
        # counts of classes by pieces too, so that no array is as wide as eight times the text
        parts = [np.bincount(_CLASS[data[k : k + CHARS_AT_ONCE]], minlength=16) for k in range(0, len(data), CHARS_AT_ONCE)]
        by_class = np.sum(parts, axis=0)
        of = lambda bit: np.array([sum(int(c) for k, c in enumerate(by_class) if k & bit)])
        words, distinct = _count_long(data)
        return {"words": np.array([words]), "distinct": np.array([distinct]), "capitals": of(_CAPITAL), "symbols": of(_SYMBOL), "points": of(_POINT)}
    classes = _CLASS[data]

    def within(bit: int) -> np.ndarray:
        return np.diff(_sums((classes & bit) != 0)[bounds])

    begin, end = _words(data, bounds)
    words = np.diff(np.searchsorted(begin, bounds))
    group = np.repeat(np.arange(n), words)
    one, odd = _distinct(data, group, _hashes(data, begin, end), begin, end)
    distinct = np.bincount(group[one], minlength=n)
    for k in odd:
        inside = range(*np.searchsorted(begin, bounds[k : k + 2]))
        distinct[k] = len({data[begin[j] : end[j]].tobytes() for j in inside})
    return {"words": words, "distinct": distinct, "capitals": within(_CAPITAL), "symbols": within(_SYMBOL), "points": within(_POINT)}


COUNTS = ["words", "distinct", "capitals", "symbols", "points"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("__text")
        names = [x for x in batch.schema.names if x != "__text"]
        for part in slices(batch, at):
            counts = text_counts(part.column(at))
            columns = [part.column(x) for x in names] + [pa.array(counts[c].astype(np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(columns, [*names, *COUNTS])


def filter_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, digest, words, distinct, capitals, symbols, points, mask): bits 0 to 3 of the mask are failures of A to D; E needs the whole table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("__text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    counted = rows.mapInArrow(_counted, kinds + ", " + ", ".join(f"{c} long" for c in COUNTS))
    words, distinct, capitals, symbols, points = map(F.col, COUNTS)
    fails = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, symbols > 0]
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))
    return counted.withColumn("mask", mask)


def mask_counts(failures: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents by their failures of all five filters."""
    # repeated rows become one with a count, so neither a copied row nor a null id is a hot key of the join
    once = failures.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    said = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.max(F.col("quality") == 1).alias("q"), F.max(F.col("toxic") == 1).alias("t"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = once.join(said, "id", "left").select("digest", "part", "mask", flag("q").alias("q"), flag("t").alias("t"), "id", "n")
    # a group of copies is at most a row for each part and label; of each its smallest id and how many rows have it
    copies = materialize(rows.groupBy("digest", "part", "mask", "q", "t").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least")))
    first = copies.groupBy("digest").agg(F.min("least").alias("first"))
    kept = F.col("without") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = copies.join(first, "digest").select("part", "q", "t", F.explode(F.array(F.struct("mask", kept.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - kept).alias("n")))).alias("x"))
    of = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0))
    return split.where("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), of("q").alias("good"), of("t").alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """The audit of every part, order and step from ``mask_counts``."""
    step = F.explode(F.array(*(F.lit(k) for k in range(1, len(FILTERS) + 1))))
    rows = counts.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", step.alias("step"))
    bit_of: Column = F.create_map(*(x for k, c in enumerate(FILTERS) for x in (F.lit(c), F.lit(1 << k))))
    filters = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda k: F.element_at(bit_of, F.substr("filter_order", k, F.lit(1))))
    before = F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b)
    rows = rows.withColumn("bits", filters).withColumn("bit", F.element_at("bits", F.col("step"))).withColumn("before", before)
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda of, when: F.sum(F.when(when, F.col(of)).otherwise(0))
    steps = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~fails & ~gone).alias("kept"), total("n", fails & ~gone).alias("removed"), total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"), total("good", fails & ~gone).alias("good_lost"), total("toxic", fails & ~gone).alias("toxic_lost"),
    )
    # 600 rows a part
    shapley = steps.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return steps.join(shapley, ["part", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    failures = filter_failures(table(spark, sf_dir, "documents"))
    return interactions(materialize(mask_counts(failures, table(spark, sf_dir, "labels"))))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
f AS (SELECT doc_id, part,
    len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS t FROM labels GROUP BY doc_id),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (coalesce(q, false)) AS good, count(*) FILTER (coalesce(t, false)) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT part, n, good, toxic, list_filter([CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END], lambda x: x IS NOT NULL) AS fails FROM m),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
      WHERE q.x <> p.x AND r.x NOT IN (p.x, q.x) AND s.x NOT IN (p.x, q.x, r.x) AND t.x NOT IN (p.x, q.x, r.x, s.x)),
y AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS filter, n, good, toxic, fails,
        list_contains(fails, substr(filter_order, step, 1)) AS failing, list_has_any(fails, string_split(substr(filter_order, 1, step - 1), '')) AS gone
      FROM k, o, (SELECT unnest(range(1, 6)) AS step)),
z AS (SELECT part, filter_order, step, filter,
        CAST(coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (failing AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = [filter]), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS BIGINT) AS toxic_lost
      FROM y GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM z
"""
