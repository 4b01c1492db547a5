"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

Method. Items are normalised to words (A-Z lower-cased) and put into one suffix automaton, whose states
stand for the runs of words that occur in some item. A document's words are streamed through it: at each
word the state and the length of the longest run of item words that ends there follow from the word
before in constant time on average. A run of ``window`` words or more holds a window at its end, and a
state's links lead to the items that have it; an item shorter than a window is matched as a whole. What
windows cover are the spans; ``decontaminate`` cuts spans longer than a limit and drops documents of which
more than a share is covered.

The automaton is built in tasks, from at most ``BLOCK`` words of items at a time, so one is at most 2·BLOCK
states, and only such a bounded one is broadcast. Beyond one block the documents stream through one
automaton after the other in the same stage, ``CHAIN`` of them before what was found is written down; a
longer item is parted with an overlap of a window less one word, so no window is lost.

Documents are read in pieces of a megabyte that end between words, the state is carried on. Null texts
have no words and items without words no windows. Items that share an id are one item; items under a null
id are found and cut, but not named or counted. Repeated documents get equal rows, each its own. Empty tables give no
rows (documents) or no spans (items). Names that begin with two underscores are the operator's own.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.batches import CHARS_AT_ONCE, slices
from lodestone.session import materialize, table

#: Words of a window, words of items in one automaton, and automatons that a stage chains.
WINDOW, BLOCK, CHAIN = 10, 100_000, 4

#: Bytes: A-Z lower-cased, what isn't a letter, a digit or beyond ASCII as a blank.
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_BETWEEN = re.compile(rb"[^0-9a-zA-Z\x80-\xff]")
_WORD = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")


def pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a text; a piece ends between words and is longer than a megabyte only if its last word is."""
    at = 0
    while len(text) - at > CHARS_AT_ONCE:
        cut = _BETWEEN.search(text, at + CHARS_AT_ONCE)
        stop = cut.end() if cut else len(text)
        yield at, text[at:stop]
        at = stop
    yield at, text[at:]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


class Automaton:
    """Suffix automaton of several word sequences; ``ends[state]`` are the (length, group) of windows that end there, longest first."""

    def __init__(self, window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: dict[int, int] = {}
        self.link, self.length, self.out = array("q", [-1]), array("q", [0]), [[]]
        self.items: list[tuple[str | None, list[int]]] = []
        self.n_words = 0

    # -- building: the key of a step is the state and the word in one number

    def _step(self, state: int, word: int) -> int:
        return self.next.get(state << 32 | word, -1)

    def _state(self, length: int, link: int, like: int = -1) -> int:
        new = len(self.length)
        self.length.append(length)
        self.link.append(link)
        self.out.append(list(self.out[like]) if like >= 0 else [])
        for word in self.out[new]:
            self.next[new << 32 | word] = self.next[like << 32 | word]
        return new

    def _lead(self, state: int, word: int, to: int) -> None:
        if (key := state << 32 | word) not in self.next:
            self.out[state].append(word)
        self.next[key] = to

    def _split(self, state: int, word: int, to: int) -> int:
        """The state of ``state`` and ``word`` alone, parted from longer runs where it has to be."""
        if self.length[to] == self.length[state] + 1:
            return to
        own = self._state(self.length[state] + 1, self.link[to], to)
        self.link[to] = own
        while state >= 0 and self._step(state, word) == to:
            self._lead(state, word, own)
            state = self.link[state]
        return own

    def add(self, item: str | None, words: list[bytes]) -> None:
        ids = [self.ids.setdefault(w, len(self.ids)) for w in words]
        self.items.append((item, ids))
        self.n_words += len(ids)
        last = 0
        for word in ids:
            if (to := self._step(last, word)) >= 0:
                last = self._split(last, word, to)
                continue
            new = self._state(self.length[last] + 1, 0)
            state = last
            while state >= 0 and self._step(state, word) < 0:
                self._lead(state, word, new)
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, word, self._step(state, word))
            last = new

    def packed(self) -> bytes:
        """What streaming needs: vocabulary, steps, links, lengths, ends, and the items of each group."""
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        at_window = [-1] * len(order)
        for v in order:
            if self.length[v] >= self.window:
                at_window[v] = v if self.length[self.link[v]] < self.window else at_window[self.link[v]]
        own: list[dict[int, set[str]]] = [{} for _ in order]
        for item, ids in self.items:
            state = 0
            for n, word in enumerate(ids, 1):
                state = self._step(state, word)
                if n >= self.window:
                    own[at_window[state]].setdefault(self.window, set()).update([item] if item is not None else [])
            if 0 < len(ids) < self.window:
                own[state].setdefault(len(ids), set()).update([item] if item is not None else [])
        groups: list[list[str]] = []
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(order)
        for v in order[1:]:
            mine = []
            for size in sorted(own[v], reverse=True):
                mine.append((size, len(groups)))
                groups.append(sorted(own[v][size]))
            ends[v] = (*mine, *ends[self.link[v]])
        keys = array("q", self.next.keys())
        return pickle.dumps((self.window, self.ids, keys, array("q", self.next.values()), self.link, self.length, {v: e for v, e in enumerate(ends) if e}, groups))


class Stream:
    """Streams documents through a packed automaton."""

    def __init__(self, packed: bytes):
        self.window, self.ids, keys, values, self.link, self.length, self.ends, self.groups = pickle.loads(packed)
        self.next = dict(zip(keys, values, strict=True))
        self.link, self.length = list(self.link), list(self.length)

    def spans(self, text: bytes) -> tuple[int, list[list[int]], set[int], int]:
        """(words, merged spans of word numbers [begin, end), groups found, longest match)."""
        known, step, link, length, ends = self.ids.get, self.next.get, self.link, self.length, self.ends
        state = matched = longest = at = 0
        spans: list[list[int]] = []
        groups: set[int] = set()
        for _, piece in pieces(text):
            for word in map(known, words_of(piece)):
                at += 1
                if word is None:
                    state = matched = 0
                    continue
                to = step(state << 32 | word)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = step(state << 32 | word)
                if to is None:
                    matched = 0
                    continue
                state, matched = to, matched + 1
                if matched > longest:
                    longest = matched
                if state in ends:
                    widest = 0
                    for size, group in ends[state]:
                        if size <= matched:
                            widest = widest or size
                            groups.add(group)
                    if widest:
                        begin = at - widest
                        while spans and spans[-1][1] >= begin:
                            begin = min(begin, spans.pop()[0])
                        spans.append([begin, at])
        return at, spans, groups, longest


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def cut_spans(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    kept, begin, k, n = [], 0, 0, 0
    for offset, piece in pieces(text):
        for m in _WORD.finditer(piece):
            if k < len(spans) and n == spans[k][0]:
                kept.append(text[begin : offset + m.start()])
            n += 1
            if k < len(spans) and n == spans[k][1]:
                begin, k = offset + m.end(), k + 1
    return b"".join([*kept, text[begin:]])


def _build(batches: Iterator[pa.RecordBatch], window: int, block: int) -> Iterator[pa.RecordBatch]:
    """A row for each automaton; items in two columns, id and text."""
    held = Automaton(window)
    row = lambda: pa.RecordBatch.from_arrays([pa.array([held.packed()], pa.binary())], ["packed"])
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            parts = [words] if len(words) <= block else [words[k : k + block] for k in range(0, len(words) - window + 1, block - window + 1)]
            for part in parts:
                if held.n_words and held.n_words + len(part) > block:
                    yield row()
                    held = Automaton(window)
                held.add(item, part)
    if held.n_words:
        yield row()


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch], automaton) -> Iterator[pa.RecordBatch]:
    """Adds what one automaton finds to the columns of findings."""
    stream = Stream(automaton.value)
    for batch in batches:
        names = batch.schema.names
        at = names.index("__text")
        for part in slices(batch, at):
            found = {c: part.column(names.index(c)).to_pylist() for c in ("n_words", "longest", "spans", "items")}
            for k, text in enumerate(part.column(at)):
                n, spans, groups, longest = stream.spans(text.as_buffer().to_pybytes())
                found["n_words"][k], found["longest"][k] = n, max(longest, found["longest"][k])
                if spans:
                    found["spans"][k] = [{"begin": b, "end": e} for b, e in merged([*([s["begin"], s["end"]] for s in found["spans"][k]), *spans])]
                    found["items"][k] = sorted({*found["items"][k], *(i for g in groups for i in stream.groups[g])})
            kinds = {"n_words": pa.int64(), "longest": pa.int64(), "spans": _SPANS, "items": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array(found[c], kinds[c]) if c in found else part.column(k) for k, c in enumerate(names)], names)


def automatons(items: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(packed): automatons over all items, each of a bounded size."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    # a word has two bytes at least, with the blank behind it
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return rows.repartition(1 + size // (2 * block)).mapInArrow(lambda b: _build(b, window, block), "packed binary")


def _found(docs: DataFrame, items: DataFrame, window: int, block: int, text_col: str, keep: list[str]) -> DataFrame:
    """__keep0, __keep1 and so on for the columns of ``keep``, the text as __text, and the findings."""
    context = docs.sparkSession.sparkContext
    built = materialize(automatons(items, window, block))
    named = [F.col(c).alias(f"__keep{k}") for k, c in enumerate(keep)]
    rows = docs.select(
        *named, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("__text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("longest"),
        F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    schema, n = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), 0
    for row in built.toLocalIterator():
        if n and n % CHAIN == 0:
            rows = materialize(rows)
        packed = context.broadcast(bytes(row.packed))
        rows, n = rows.mapInArrow(lambda b, packed=packed: _scan(b, packed), schema), n + 1
    if not n:
        packed = context.broadcast(Automaton(window).packed())
        rows = rows.mapInArrow(lambda b: _scan(b, packed), schema)
    return rows


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, longest, spans, items): the longest run of an item's words, array<struct<begin, end>> of word numbers, and the items' ids as strings, in order."""
    return _found(docs, items, window, block, text_col, [id_col]).select(F.col("__keep0").alias(id_col), "n_words", "longest", "spans", "items")


def n_hit(spans="spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def _cut(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [x for x in batch.schema.names if x != "__cut"]
        at = names.index(name)
        for part in slices(batch, batch.schema.get_field_index(name)):
            cuts = part.column(part.schema.get_field_index("__cut")).to_pylist()
            texts = [t.as_py() if not c else cut_spans(t.as_py().encode(), [[s["begin"], s["end"]] for s in c]).decode() for t, c in zip(part.column(part.schema.get_field_index(name)), cuts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else part.column(part.schema.get_field_index(c)) for k, c in enumerate(names)], names)


def decontaminate(docs: DataFrame, items: DataFrame, most_words: int = 0, most_coverage: float = 0.5, window: int = WINDOW, block: int = BLOCK, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``: spans of more than ``most_words`` words are cut from the text, documents of which more than ``most_coverage`` of the words are covered go."""
    kept = _found(docs, items, window, block, text_col, docs.columns).where(n_hit() <= most_coverage * F.col("n_words"))
    rows = kept.select(*(F.col(f"__keep{k}").alias(c) for k, c in enumerate(docs.columns)), F.filter("spans", lambda s: s["end"] - s["begin"] > most_words).alias("__cut"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(lambda b: _cut(b, text_col), schema)


def op11_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') AS run
      FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM i),
p AS (SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS run FROM (SELECT d.r, d.w, m.m, unnest(range(1, len(d.w) - m.m + 2)) AS k FROM d, m WHERE len(d.w) >= m.m)),
f AS (SELECT p.r, p.k, p.m, i.item_id FROM p JOIN i ON i.m = p.m AND i.run = p.run),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + m)) AS at FROM f) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM f WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
