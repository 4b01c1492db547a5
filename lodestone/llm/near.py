"""Near-duplicate detection by DartMinHash over word shingles.

Method. A text is a weighted set: its shingles of five words, each weighing as often as it occurs. The
weight axis of an element is divided into regions by level, [0, 1), [1, 2), [2, 4), [4, 8) and so on.
Into every region up to the element's weight seeded darts are thrown, a Poisson process over rank as
dense as the region is wide, each dart at a hashed height; darts above the weight miss. So equal
elements get equal darts, a heavier one more of them, and an element of weight w costs about log w
regions. Each dart falls on one of ``BANDS·ROWS`` coordinates, and a coordinate keeps its earliest
dart. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity. Bands
of coordinates are hashed, and texts that share a band are compared exactly.

Only texts with different word sequences are compared; copies share a key. In a bucket every text is
compared with one head first. Where a bucket still holds several components, more heads are taken
among its texts, in rounds that grow until every pair of different components has been compared or is
ruled out by a bound on what the two can have in common, so no link that the bands propose is lost and no bucket is expanded into all its pairs at once. The
components of the links come from label propagation with pointer jumping, on the cluster throughout.

Words are runs of word characters, lower-cased. A text of fewer than five words has one shingle, all
its words. Texts without words are copies of each other only where they are equal; a null text is a
class of its own. A document's class is the smallest id of its component. Rows may repeat, and rows
that share an id but not the text are classed by their texts. An empty table gives no rows; only the id
and the text are carried, so other columns can't clash (``keep_one`` carries all; names that begin with
two underscores are its own).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.batches import slices
from lodestone.session import materialize, table

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at 0.8 shares a band with probability 1 - (1 - 0.8^6)^30 = 0.9999.
BANDS, ROWS = 30, 6
#: Heads of a bucket in the rounds after the first; the last round takes every text.
ROUNDS = (2, 16, None)
WORD = re.compile(r"\w+")
#: 64-bit words of a text's map of classes of cells.
MAP_WORDS = 16
#: Darts that are drawn at once, texts and words whose darts are thrown side by side, texts whose cells are kept for comparing.
DARTS_AT_ONCE, SIDE_BY_SIDE, WORDS_SIDE_BY_SIDE, KEPT_TEXTS = 1 << 18, 64, 1 << 17, 32
#: Words whose hashes a task keeps.
KEPT_WORDS = 150_000


# -- darts ---------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return found


def shingle_hashes(words: list[str], hashes: WordHashes) -> np.ndarray:
    """One 64-bit hash for each occurrence of a shingle, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = _mix(total ^ h[k : k + n])
    total.sort()
    return total


def cells_of(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit cell for each occurrence, sorted; the same shingle's occurrences are numbered."""
    first = np.searchsorted(shingles, shingles)
    return np.sort(_mix(shingles ^ _mix((np.arange(len(shingles)) - first).astype(np.uint64))))


def shingle_cells(words: list[str], hashes: WordHashes) -> np.ndarray:
    return cells_of(shingle_hashes(words, hashes))


def weighted_set(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, how often each occurs)."""
    elements, counts = np.unique(shingles, return_counts=True)
    return elements, counts.astype(np.float64)


def regions_of_weights(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, its width, the share of it below the element's weight) of elements with any positive weights.

    Level 0 is [0, 1), level k is [2^(k-1), 2^k).
    """
    levels = np.maximum(0, np.ceil(np.log2(np.maximum(weights, 1e-300)))).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(elements)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    return _mix(elements[owner] ^ _mix(level.astype(np.uint64))), width, np.minimum(1.0, (weights[owner] - low) / width)


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """For each weighted set (elements, weights) the id of the earliest dart on each of k coordinates; an empty set has all zero.

    The sets' darts are thrown side by side: up to the rank below which about enough of them fall for
    every coordinate, and for what is then still bare up to twice that rank.
    """
    out = np.zeros((len(sets), k), np.uint64)
    weight = np.array([float(w.sum()) for _, w in sets])
    regions = [regions_of_weights(e, w) for e, w in sets]
    left, times = np.nonzero(weight)[0], 1.3
    while len(left):
        sizes = np.array([len(regions[i][0]) for i in left])
        limits = np.repeat(times * (k * math.log(k) + 2 * k) / weight[left], sizes)
        ids, ranks, owner = _darts(*(np.concatenate([regions[i][j] for i in left]) for j in range(3)), limits)
        slots = np.repeat(np.arange(len(left)), sizes)[owner] * k + ((ids >> np.uint64(7)) % np.uint64(k)).astype(np.int64)
        best = np.full(len(left) * k, np.inf)
        np.minimum.at(best, slots, ranks)
        earliest = ranks == best[slots]
        found = np.full(len(left) * k, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(found, slots[earliest], ids[earliest])
        whole = np.isfinite(best).reshape(-1, k).all(axis=1)
        out[left[whole]] = found.reshape(-1, k)[whole]
        left, times = left[~whole], 2 * times
    return out


def _darts(regions: np.ndarray, widths: np.ndarray, shares: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, rank, number of the region) of all darts of lower rank than the region's limit that hit its share.

    A region's n-th dart lies a drawn step behind the one before, the shorter the wider the region, and
    its steps are added up in order however many are drawn at once, so a region has the same darts in any
    company.
    """
    reach = limits * widths  # ranks in units of the region's own steps
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    classes = np.ceil(np.log2(np.maximum(reach, 1))).astype(np.int64)
    for kind in np.unique(classes):
        alive = np.nonzero(classes == kind)[0]
        last, n, most = np.zeros(len(alive)), 0, float(reach[alive].max())
        step = max(1, int(most + 2 * math.sqrt(most)) if most > 2 else 1)
        while len(alive):
            rest = []
            for begin in range(0, len(alive), max(1, DARTS_AT_ONCE // step)):
                part = slice(begin, begin + max(1, DARTS_AT_ONCE // step))
                own = alive[part]
                ids = _mix(regions[own][:, None] ^ _mix(np.arange(n, n + step, dtype=np.uint64))[None, :])
                ranks = np.cumsum(np.concatenate([last[part][:, None], -np.log(_uniform(ids))], axis=1), axis=1)[:, 1:]
                inside = ranks < reach[own][:, None]
                found.append((ids[inside], ranks[inside], np.repeat(own, inside.sum(axis=1))))
                rest.append((own[inside[:, -1]], ranks[inside[:, -1], -1]))
            alive, last = (np.concatenate([x[j] for x in rest]) for j in range(2))
            n, step = n + step, max(1, int(math.sqrt(most)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    ids, ranks, owner = (np.concatenate([x[j] for x in found]) for j in range(3))
    hit = (shares[owner] >= 1.0) | (_uniform(_mix(ids)) <= shares[owner])
    ids, ranks, owner = ids[hit], ranks[hit], owner[hit]
    return ids, ranks / widths[owner], owner


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    out = _mix(np.arange(bands, dtype=np.uint64))
    for k in range(rows.shape[1]):
        out = _mix(out ^ rows[:, k])
    return out.view(np.int64)


def class_map(cells: np.ndarray) -> np.ndarray:
    """Which of 64·MAP_WORDS classes of cells a text has: a class that only one of two texts has holds a cell that only it has."""
    has = np.zeros(64 * MAP_WORDS, bool)
    has[(cells >> np.uint64(20)) % np.uint64(len(has))] = True
    return np.packbits(has).view(np.int64)


def text_key(words: list[str], text: str) -> bytes:
    """The same for texts of the same words; texts without words by themselves."""
    return hashlib.md5(("w\0" + " ".join(words) if words else "t\0" + text).encode("utf-8", "replace"), usedforsecurity=False).digest()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of cells."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


# -- Spark ---------------------------------------------------------------------------------------


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def done(ids: list, keys: list[bytes | None], shingles: list[np.ndarray]) -> pa.RecordBatch:
        bands = [band_hashes(s) if len(c) else [] for s, c in zip(dart_signatures([weighted_set(x) for x in shingles], BANDS * ROWS), shingles, strict=True)]
        maps = pa.array([class_map(cells_of(x)) for x in shingles], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), maps], ["id", "key", "bands", "map"])

    for batch in batches:
        ids, keys, cells, held = [], [], [], 0
        for k, value in enumerate(batch.column(1)):
            text = value.as_py()
            words = WORD.findall(text.lower()) if text is not None else []
            ids.append(batch.column(0).slice(k, 1))
            keys.append(None if text is None else text_key(words, text))
            cells.append(shingle_hashes(words, hashes))
            held += len(words)
            if len(keys) == SIDE_BY_SIDE or held >= WORDS_SIDE_BY_SIDE:
                yield done(ids, keys, cells)
                ids, keys, cells, held = [], [], [], 0
        if keys:
            yield done(ids, keys, cells)


def _matching_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) whose text has that key (an id may stand for several texts), and the number of its cells."""
    for batch in batches:
        ok, n = [], []
        for k, t in zip(batch.column(0), batch.column(1), strict=True):
            words = WORD.findall(t.as_py().lower())
            ok.append(text_key(words, t.as_py()) == k.as_py())
            n.append(max(1, len(words) - SHINGLE + 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], ["key", "text", "n"]).filter(pa.array(ok, pa.bool_()))


def _keyed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, number of cells) of texts."""
    for part in (x for batch in batches for x in slices(batch, 0)):
        texts = part.column(0).to_pylist()
        words = [WORD.findall(t.lower()) for t in texts]
        keys, n = [text_key(w, t) for w, t in zip(words, texts, strict=True)], [max(1, len(w) - SHINGLE + 1) for w in words]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column(0), pa.array(n, pa.int64())], ["key", "text", "n"])


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for k, t in zip(batch.column(0), batch.column(1), strict=True):
            cells = shingle_cells(WORD.findall(t.as_py().lower()), hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(cells), pa.binary()), pa.array(cells)], ["key", "cell"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    kept: dict[bytes, np.ndarray] = {}

    def own_cells(key: bytes, text: str) -> np.ndarray:
        found = kept.pop(key, None)
        if found is None:
            found = shingle_cells(WORD.findall(text.as_py().lower()), hashes)
            if len(kept) >= KEPT_TEXTS:
                del kept[next(iter(kept))]
        kept[key] = found  # what was used last goes last
        return found

    for batch in batches:
        keep = [similarity(own_cells(a.as_py(), x), own_cells(b.as_py(), y)) >= SIMILARITY for a, b, x, y in zip(*batch.columns, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of the edges (a, b)."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = materialize(labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")))
        # jump to the label of the label; labels only ever fall, so this stays within the component
        ahead = lower.select(F.col("node").alias("label"), F.col("label").alias("ahead"))
        labels = materialize(lower.join(ahead, "label").select("node", F.col("ahead").alias("label")))
        if not lower.where("moved").limit(1).count():
            return labels


def own_classes(x: str, y: str) -> Column:
    """In how many classes of cells x has some and y none: at least so many cells of x are not in y."""
    words = (F.bit_count(F.get(f"{x}.map", F.lit(k)).bitwiseAND(F.bitwise_not(F.get(f"{y}.map", F.lit(k))))) for k in range(MAP_WORDS))
    return reduce(lambda a, b: a + b, words)


def _open_buckets(placed: DataFrame, found: DataFrame) -> DataFrame:
    """Members (band, key, size, label, n, alone) of the buckets that may hold links between their components.

    ``alone`` counts the cells that no other text of an open bucket has. They can't be common to a pair,
    so n - alone bounds what a text shares with any other; a text that for this reason can't be similar
    even to the smallest text of its bucket has no link there and leaves it.
    """

    def mixed(rows: DataFrame) -> DataFrame:
        low_high = rows.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
        return materialize(rows.join(materialize(low_high), "band"))

    active = mixed(placed)
    texts = found.join(active.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    single = texts.select("key", "text").mapInArrow(_cell_rows, "key binary, cell long").groupBy("cell").agg(F.count("*").alias("c"), F.min("key").alias("key")).where("c = 1")
    alone = materialize(single.groupBy("key").agg(F.count("*").alias("alone")))
    sized = active.join(found.select("key", "n").distinct(), "key").join(alone, "key", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    sized = materialize(sized)
    smallest = materialize(sized.groupBy("band").agg(F.min("n").alias("smallest")))
    can_link = (F.col("n") - F.col("alone")) / SIMILARITY - F.col("alone") >= F.greatest(F.col("smallest"), SIMILARITY * F.col("n")) - 1e-9
    return mixed(sized.join(smallest, "band").where(can_link).drop("smallest"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, class_id, n_class, label): for every row its text's key and class, and how many different texts the class has.

    Unrelated texts that share an id may have the same ``class_id``; ``label`` tells their classes apart (null without a text).
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    rows = materialize(texts.mapInArrow(_signatures, f"id {kind}, key binary, bands array<bigint>, map array<bigint>"))
    nodes = materialize(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("map").alias("map")))
    members = nodes.select("key", F.explode("bands").alias("band"))
    # the head of a bucket differs from band to band, so that near copies meet several and few components stay apart
    heads = members.groupBy("band").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("key", "band"), "key"))["key"].alias("head")).where("size > 1")
    shared = materialize(members.join(materialize(heads), "band"))
    wanted = materialize(shared.select("key").distinct().join(nodes, "key").select("key", "rep", "bands", "map"))
    found = wanted.select("key", "rep").join(texts.where(F.col("text").isNotNull()), F.col("rep") == F.col("id")).select("key", "text")
    found = found.mapInArrow(_matching_texts, "key binary, text string, n long")
    # texts that stand under null ids only are found by their keys, as an id that many rows share would pair them all
    nameless = texts.where("id IS NULL AND text IS NOT NULL").select("text").mapInArrow(_keyed_texts, "key binary, text string, n long")
    found = materialize(found.union(nameless.join(wanted.where("rep IS NULL").select("key"), "key", "left_semi").dropDuplicates(["key"])))

    def similar(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) of keys those that are similar."""
        left, right = found.select(F.col("key").alias("a"), F.col("text").alias("text_a")), found.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
        return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_compare, "a binary, b binary").distinct())

    pairs = shared.where("key <> head").select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct()
    tested = materialize(pairs)
    labels = components(similar(tested))
    labels = materialize(wanted.select("key").join(labels, F.col("key") == F.col("node"), "left").select("key", F.coalesce("label", "key").alias("label")))
    for heads_wanted in ROUNDS:
        active = _open_buckets(shared.select("band", "key", "size").join(labels, "key"), found)
        share = F.lit(1.0) if heads_wanted is None else F.lit(float(heads_wanted)) / F.col("size")
        chosen = materialize(active.where(F.pmod(F.xxhash64("band", "key"), F.lit(1 << 20)) < share * F.lit(1 << 20)).join(wanted.select("key", "bands", "map"), "key"))
        x, y = active.join(wanted.select("key", "bands", "map"), "key").alias("x"), chosen.alias("y")
        common = F.least(F.col("x.n") - F.col("x.alone"), F.col("y.n") - F.col("y.alone"), F.col("x.n") - own_classes("x", "y"), F.col("y.n") - own_classes("y", "x"))
        can_be = common >= SIMILARITY * (F.col("x.n") + F.col("y.n") - common) - 1e-9
        # a pair counts in the first band that it shares
        first = F.get(F.filter(F.zip_with("x.bands", "y.bands", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull()), 0) == F.col("x.band")
        met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.label") != F.col("y.label")) & first & can_be)
        pairs = met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"))
        links = similar(pairs)
        tested = tested.union(pairs)
        if links.limit(1).count():
            ends = links.join(labels.select(F.col("key").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("key").alias("b"), F.col("label").alias("lb")), "b")
            joined = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("now"))
            labels = materialize(labels.join(joined, "label", "left").select("key", F.coalesce("now", "label").alias("label")))
    named = materialize(nodes.select("key", "rep").join(labels, "key", "left").select("key", "rep", F.coalesce("label", "key").alias("label")))
    classes = materialize(named.groupBy("label").agg(F.min("rep").alias("class_id"), F.count("*").alias("n_class")))
    of_key = materialize(named.join(classes, "label").select(F.col("key").alias("__key"), "class_id", "n_class", "label"))
    out = rows.select("id", "key").join(of_key, F.col("key") == F.col("__key"), "left")
    return out.select(F.col("id").alias(id_col), "key", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_class", F.lit(1)).alias("n_class"), "label")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest id.

    Repeated rows count as copies, so one of them stays; a row without a text always stays.
    """
    found = near_duplicates(docs, id_col, text_col).where("key IS NOT NULL")
    # of each class the row of the smallest id and, among texts that share it, of the smallest key; null ids come last
    smallest = F.min(F.struct(F.col(id_col).isNull(), F.struct(F.col(id_col).alias("id"), "key").alias("at")))["at"]
    first = materialize(found.groupBy("label").agg(smallest.alias("__at")).select("__at"))
    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "__key binary"])
    at = docs.columns.index(text_col)

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, at)):
            keys = pa.array([text_key(WORD.findall(t.as_py().lower()), t.as_py()) for t in part.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, keys], [*part.schema.names, "__key"])

    keyed = docs.where(F.col(text_col).isNotNull()).mapInArrow(with_key, spec)
    # nulls within structs are equal; the join deals rows by (id, key), and so no further shuffle is needed to keep one of repeated rows
    placed = keyed.withColumn("__at", F.struct(F.col(id_col).alias("id"), F.col("__key").alias("key")))
    kept = placed.join(first, "__at", "left_semi").dropDuplicates(["__at"])
    return kept.select(*docs.columns).union(docs.where(F.col(text_col).isNull()))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document: doc_id, class_id, n_class (different texts of the class), kept."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_class", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
