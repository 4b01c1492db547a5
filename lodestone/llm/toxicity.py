"""Toxicity by compression distance.

Method. Two zstandard dictionaries are trained, one on windows of ordinary text and one on windows of
toxic text. A text is read in overlapping windows of several words; a window's gap is how many bytes
shorter it gets when the toxic dictionary stands before the ordinary one than with the ordinary one
alone. As most of a toxic document is ordinary, the toxic dictionary is trained in rounds: first on
the windows of each toxic document that the ordinary dictionary compresses worst, then on those with
the largest gaps under the dictionary of the round before, fewer from round to round. What recurs in
them across documents ends up in the dictionary, chance neighbours don't.

A document is summed up by how many of its windows reach each of a few gaps and by its largest gap.
A logistic fit on labelled rows that no dictionary has seen turns that into a score, with the
threshold of the best F1 on them moved to 0.5. A few widths of windows and
settings of the trainer are tried (``CANDIDATES``), and the one with the best F1 there is taken.

Labels are learnt from a bounded sample: ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` labelled rows, those with
the smallest hashes, and of them as many, in this order, as have ``SAMPLE_CHARS`` characters together, texts of
more than ``1/SHARES`` of these characters behind all others and longer ones than all of them never, so a
labelled text of any length changes only its own row; texts are learnt from whole. Rows of the sample that share a fifth of their shingles with rows
before them are left out, because a copied document would make its chance words look characteristic.

Every text is scored whole. Null and empty texts get the score of a document without windows, which is
below the threshold. Without
labels of both kinds, or with too few to train a dictionary, the score is 0. Equal texts give equal
scores; repeated rows are scored each, an empty table gives no rows, other columns are never looked at
and, unless named in ``keep``, not carried, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import slices
from lodestone.session import table

#: The bounded sample; every third row of it calibrates.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_CHARS, SHARES = 1500, 3500, 48_000_000, 64
#: Words of a window (they overlap by half), and the lengths of the segments and of their parts that the trainer counts; the best is taken.
CANDIDATES = ((8, 24, 8), (10, 24, 8), (8, 16, 6), (10, 16, 8))
#: For each round the windows picked of each toxic document, and the bytes of the dictionary trained on them.
ROUNDS = ((6, 3000), (6, 3000), (4, 3000), (4, 3000), (2, 2000), (2, 2000))
#: Ordinary windows that the ordinary dictionary is trained on, and its bytes.
ORDINARY_WINDOWS, ORDINARY_BYTES = 60_000, 110_000
LEVEL = 9
GAPS = (2, 3, 4, 5, 6)
#: Texts with fewer windows count as so many; the highest score of a text none of whose windows reaches the least gap.
SHORT, UNTOUCHED = 8, 0.49


def windows_of(words: list[str], width: int) -> Iterator[bytes]:
    """Overlapping windows; the last one reaches the end."""
    step = width // 2
    for k in range(0, max(1, len(words) - width + step) if words else 0, step):
        yield " ".join(words[k : k + width]).encode("utf-8", "replace")


def without_copies(rows: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """Leave out what shares a fifth of its four-word shingles with rows before it."""
    seen: set[int] = set()
    out = []
    for words, label in rows:
        shingles = {hash(tuple(words[i : i + 4])) for i in range(max(1, len(words) - 3))}
        if len(shingles & seen) <= 0.2 * len(shingles):
            seen |= shingles
            out.append((words, label))
    return out


def _compressor(content: bytes):
    import zstandard as z

    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _trained(windows: list[bytes], size: int, segment: int, part: int) -> bytes:
    """A dictionary by zstandard's trainer; none if there is too little to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, windows, k=segment, d=part, f=20, accel=1, level=LEVEL).as_bytes()
    except z.ZstdError:
        return b""


@dataclass
class ToxicityModel:
    """Contents of the two dictionaries, width of the windows, and the logistic fit."""

    ordinary: bytes = b""
    toxic: bytes = b""
    width: int = CANDIDATES[0][0]
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    shift: float = 0.0
    _kept: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_kept": []}

    def gaps(self, words: list[str]) -> np.ndarray:
        """The gap of each window. What stands last in a dictionary is the cheapest to refer to, so the
        ordinary text lies at the same distance in both."""
        if not self._kept:
            self._kept = [_compressor(self.ordinary), _compressor(self.toxic + self.ordinary)]
        plain, toxic = (c.compress for c in self._kept)
        return np.fromiter((len(plain(w)) - len(toxic(w)) for w in windows_of(words, self.width)), np.int64)

    def features(self, text: str | None) -> np.ndarray:
        found = self.gaps((text or "").lower().split())
        if not len(found):
            return np.zeros(len(GAPS) + 3)
        return np.array([*(math.log1p((found >= g).sum()) for g in GAPS), found.max(), (found >= 4).mean(), math.log1p(max(SHORT, len(found)))])

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        z = ((features - self.mean) / self.spread) @ self.weights[:-1] + self.weights[-1] - self.shift
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # without a window that reaches the least gap nothing speaks for toxicity
        return np.where(features[:, 0] > 0, p, np.minimum(p, UNTOUCHED))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps, both classes weighing the same; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([*[1.0] * (x.shape[1] - 1), 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionaries(toxic: list[list[str]], ordinary: list[list[str]], width: int, segment: int, part: int) -> tuple[bytes, bytes]:
    """(ordinary, toxic) contents, trained on texts as lists of words; empty if they can't be trained."""
    windows = [w for words in ordinary for w in windows_of(words, width)]
    order = np.random.default_rng(1).permutation(len(windows))[:ORDINARY_WINDOWS]
    sample = [windows[k] for k in order]
    plain = _trained(sample, ORDINARY_BYTES, 32, 8) or _trained(sample, max(256, sum(map(len, sample)) // 10), 32, 8)
    if not plain:
        return b"", b""
    texts = [list(windows_of(words, width)) for words in toxic]
    compress = _compressor(plain).compress
    alone = [np.array([len(compress(w)) for w in ws]) for ws in texts]
    worth = [n / np.array([len(w) + 8 for w in ws]) for n, ws in zip(alone, texts, strict=True)]
    found = b""
    for picked, size in ROUNDS:
        sample = [ws[k] for ws, x in zip(texts, worth, strict=True) for k in np.argsort(-x, kind="stable")[:picked]]
        now = _trained(sample, size, segment, part) or _trained(sample, max(256, sum(map(len, sample)) // 10), segment, part)
        if not now:
            break
        found, compress = now, _compressor(now + plain).compress
        worth = [n - np.array([len(compress(w)) for w in ws]) for n, ws in zip(alone, texts, strict=True)]
    return plain, found


def best_threshold(p: np.ndarray, y: np.ndarray, odds: float) -> tuple[float, float]:
    """(threshold, F1), false alarms weighing ``odds``."""
    best = 0.5, -1.0
    for t in np.unique(np.round(p, 4)):
        hit, false, lost = (p[y == 1] >= t).sum(), (p[y == 0] >= t).sum() * odds, (p[y == 1] < t).sum()
        f1 = 2 * hit / max(1e-9, 2 * hit + false + lost)
        if f1 > best[1]:
            best = (t + p[p < t].max(initial=t - 0.01)) / 2, f1
    return best


def train(rows: list[tuple[str, int]], share: float | None = None, candidates: tuple[tuple[int, int, int], ...] = CANDIDATES) -> ToxicityModel:
    """``share``: how many of all labelled rows are toxic (the sample holds more), for the threshold."""
    rows = [(text, text.lower().split(), label) for text, label in rows]
    kept = without_copies([(words, label) for _, words, label in rows if words])
    learn, calibrate = [r for k, r in enumerate(kept) if k % 3], kept[::3]
    toxic, ordinary = ([w for w, label in learn if label == k] for k in (1, 0))
    y = np.array([label for _, label in calibrate])
    chosen, best = ToxicityModel(), -1.0
    if not toxic or not ordinary or len(set(y.tolist())) < 2:
        return chosen
    # F1 as it would be with the true share of toxic rows
    odds = 1.0 if share is None else ((1 - share) / max(share, 1e-6)) / ((1 - y.mean()) / y.mean())
    for width, segment, part in candidates:
        plain, found = dictionaries(toxic, ordinary, width, segment, part)
        if not found:
            continue
        model = ToxicityModel(plain, found, width)
        x = np.array([model.features(" ".join(w)) for w, _ in calibrate])
        model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        model.weights = _logistic((x - model.mean) / model.spread, y)
        t, f1 = best_threshold(model.score(x), y, odds)
        t = min(max(t, 1e-4), 1 - 1e-4)
        model.shift = math.log(t / (1 - t))
        if f1 > best:
            chosen, best = model, f1
    return chosen


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from a bounded sample of ``labels`` (id, toxic) and the texts of ``docs``."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit("toxicity"), F.col(id_col))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    # a threshold first: the tasks together hand on a few times what is wanted, however many they are
    low = lambda rows, of: F.pmod(F.col("o"), F.lit(1 << 30)) < int(min(1.0, 4 * rows / max(of, 1)) * (1 << 30))
    pick = [known.where(F.col("toxic") == k).withColumn("o", order).where(low(rows, of)).orderBy("o", id_col).limit(rows) for k, rows, of in ((1, TOXIC_ROWS, n_toxic), (0, ORDINARY_ROWS, n - n_toxic))]
    # at most TOXIC_ROWS + ORDINARY_ROWS rows of three numbers
    sample = F.broadcast(pick[0].union(pick[1]).select(F.col(id_col).alias("__id"), "o", F.col("toxic").alias("y")))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where("__text IS NOT NULL")
    # a bounded sample: the window orders at most as many rows as were picked
    so_far = F.sum(F.length("w")).over(Window.orderBy("wide", "o").rowsBetween(Window.unboundedPreceding, 0))
    found = texts.join(sample, "__id").groupBy("o").agg(F.min("__text").alias("w"), F.max("y").alias("y")).where(F.length("w") <= SAMPLE_CHARS).withColumn("wide", F.length("w") > SAMPLE_CHARS // SHARES).withColumn("chars", so_far).where(F.col("chars") <= SAMPLE_CHARS).orderBy("o").select("w", "y").collect()
    return train([(r.w, r.y) for r in found], n_toxic / n if n else None)


def score_documents(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, then the score of the whole text. Row by row, no shuffle."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, rows=256):
                texts = part.column(part.num_columns - 1)
                scores = model.score(np.array([model.features(t.as_py()) for t in texts])) if model.weights is not None else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.round(scores, 9), pa.float64())], [*part.schema.names[:-1], "score"])

    return rows.mapInArrow(run, ", ".join([*fields, "score double"]))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document: doc_id, held_out, score, predicted."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    rows = score_documents(docs, model, ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
