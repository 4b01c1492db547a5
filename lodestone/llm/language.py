"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text from both sides, labels every position with language
probabilities, and a document's probabilities are the means over its positions. It is trained here,
in numpy, by backpropagation through time on a bounded sample of labelled rows: the ``TRAIN_ROWS``
rows with the smallest hashes, and of them as many, in this order, as have ``TRAIN_CHARS`` characters
together. Texts of more than ``1/SHARES`` of these characters come behind all others, and longer ones than
``TRAIN_CHARS`` are never learnt from, so a labelled text of any length changes only its own row. The
texts are learnt from whole, cut into windows of ``TRAIN_WINDOW`` bytes.

Texts are read whole, cut into segments of at most ``SEGMENT`` bytes that the network reads side by
side; every byte lies in exactly one segment. A text without a letter (or a null text) is ``und``
with score 0. Equal texts give equal results wherever they stand, other columns are never looked
at, and repeated rows are labelled each on their own. Without labelled rows everything is ``und``;
an empty table gives no rows. Only the columns named in ``keep`` are carried, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import slices
from lodestone.session import table

#: Bounded sample of labelled rows and of their characters, bytes of a training window, hidden units of each direction.
TRAIN_ROWS, TRAIN_CHARS, SHARES, TRAIN_WINDOW, HIDDEN, TRAIN_BATCH, RATE = 3000, 4_500_000, 64, 96, 8, 100, 0.02
#: Windows that are read in training, each as often as it takes, but at least so often.
TRAIN_READS, LEAST_EPOCHS = 42_000, 1
#: Bytes of a segment, and segments that are read side by side.
SEGMENT, SIDE_BY_SIDE = 192, 2048
UNKNOWN = "und"


@dataclass
class Gru:
    """One direction: gates z, r and the candidate, stacked; ``byte`` holds each byte's input."""

    byte: np.ndarray  # 257 x 3H, the last row for padding
    gates: np.ndarray  # H x 2H
    candidate: np.ndarray  # H x H

    @staticmethod
    def new(rng: np.random.Generator, hidden: int) -> Gru:
        f = lambda *shape, s=1.0: (rng.standard_normal(shape) * s / np.sqrt(hidden)).astype(np.float32)
        return Gru(f(257, 3 * hidden), f(hidden, 2 * hidden), f(hidden, hidden))

    def parts(self) -> list[np.ndarray]:
        return [self.byte, self.gates, self.candidate]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _step(net: Gru, h: np.ndarray, inputs: np.ndarray) -> tuple[np.ndarray, ...]:
    """h' = (1-z)·h + z·tanh(x + (r·h)·U)."""
    hidden = h.shape[1]
    gates = _sigmoid(h @ net.gates + inputs[:, : 2 * hidden])
    z, r = gates[:, :hidden], gates[:, hidden:]
    reset = r * h
    c = np.tanh(reset @ net.candidate + inputs[:, 2 * hidden :])
    return h + z * (c - h), z, r, c, reset


def _read(net: Gru, segments: np.ndarray, order: range, keep: bool = False) -> tuple[np.ndarray, list]:
    """States at every position (positions x rows x H); padding keeps the state as it is."""
    rows, width = segments.shape
    h = np.zeros((rows, net.candidate.shape[0]), np.float32)
    states, trail = np.empty((width, *h.shape), np.float32), []
    for t in order:
        codes = segments[:, t]
        new, *kept = _step(net, h, net.byte[codes])
        pad = codes == 256
        if pad.any():
            new[pad] = h[pad]
        if keep:
            trail.append((t, h, *kept, pad))
        states[t] = h = new
    return states, trail


@dataclass
class LanguageModel:
    languages: list[str]
    forward: Gru
    backward: Gru
    out: np.ndarray  # 2H+1 x languages, the last row is the bias

    def position_probabilities(self, segments: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(position, probabilities: rows x languages) of every position, the last one first.

        The forward states are stored; each backward state is used as soon as it is there.
        """
        rows, width = segments.shape
        hidden = self.backward.candidate.shape[0]
        f, _ = _read(self.forward, segments, range(width))
        h = np.zeros((rows, hidden), np.float32)
        for t in range(width - 1, -1, -1):
            codes = segments[:, t]
            new = _step(self.backward, h, self.backward.byte[codes])[0]
            pad = codes == 256
            if pad.any():
                new[pad] = h[pad]
            h = new
            p = f[t] @ self.out[:hidden]
            p += h @ self.out[hidden : 2 * hidden]
            p += self.out[-1]
            np.exp(p, out=p)
            p /= p.sum(axis=1, keepdims=True)
            yield t, p

    def label_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(summed position probabilities, number of positions) of each text."""
        totals, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for ids, segments in _segments(texts):
            pooled = np.zeros((len(ids), len(self.languages)))
            for t, p in self.position_probabilities(segments):
                pooled += p * (segments[:, t] != 256)[:, None]
            np.add.at(totals, ids, pooled)
            np.add.at(counts, ids, (segments != 256).sum(axis=1))
        return totals, counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        totals, counts = self.label_texts(texts)
        shares = totals / np.maximum(counts, 1)[:, None]
        best = shares.argmax(axis=1)
        lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)], np.where(lettered, np.round(np.minimum(shares.max(axis=1), 1.0), 6), 0.0)


def _segments(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the texts, their segments of bytes) for up to ``SIDE_BY_SIDE`` segments at a time.

    A text's segments are of (nearly) equal length, and segments of like length are read together, so
    little is padding.
    """
    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

    def flush(width: int) -> tuple[np.ndarray, np.ndarray]:
        ids, rows = held.pop(width)
        out = np.full((len(rows), width), 256, np.int16)
        for k, row in enumerate(rows):
            out[k, : len(row)] = row
        return np.array(ids), out

    for i, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        if not len(raw):
            continue
        n = -(-len(raw) // SEGMENT)
        size = -(-len(raw) // n)
        width = min(SEGMENT, -(-size // 32) * 32)
        for begin in range(0, len(raw), size):
            ids, rows = held.setdefault(width, ([], []))
            ids.append(i)
            rows.append(raw[begin : begin + size])
            if len(rows) >= SIDE_BY_SIDE:
                yield flush(width)
    for width in list(held):
        yield flush(width)


def _back(net: Gru, trail: list, d_states: np.ndarray, segments: np.ndarray) -> list[np.ndarray]:
    """Gradients of one direction from those of its states, back through time."""
    d_byte, d_gates, d_candidate = (np.zeros_like(x) for x in net.parts())
    d_h = np.zeros_like(d_states[0])
    for t, h, z, r, c, reset, pad in reversed(trail):
        d = d_h + d_states[t]
        live = np.where(pad, 0, 1).astype(np.float32)[:, None]
        d_z = d * (c - h) * z * (1 - z) * live
        d_c = d * z * (1 - c * c) * live
        d_reset = d_c @ net.candidate.T
        d_r = d_reset * h * r * (1 - r)
        d_zr = np.concatenate([d_z, d_r], axis=1)
        d_gates += h.T @ d_zr
        d_candidate += reset.T @ d_c
        np.add.at(d_byte, segments[:, t], np.concatenate([d_zr, d_c], axis=1))
        d_h = d * (1 - z * live) + d_reset * r + d_zr @ net.gates.T
    return [d_byte, d_gates, d_candidate]


def train(windows: list[bytes], targets: list[str], epochs: int | None = None, seed: int = 7) -> LanguageModel | None:
    """Train by Adam on the mean cross-entropy of all positions, each language weighing the same."""
    languages = sorted(set(targets))
    rows = [(w, languages.index(y)) for w, y in zip(windows, targets, strict=True) if w]
    if not rows:
        return None
    epochs = epochs or max(LEAST_EPOCHS, TRAIN_READS // len(rows))
    rng = np.random.default_rng(seed)
    width = max(len(w) for w, _ in rows)
    data = np.full((len(rows), width), 256, np.int16)
    for k, (w, _) in enumerate(rows):
        data[k, : len(w)] = np.frombuffer(w, np.uint8)
    y = np.array([c for _, c in rows])
    weight = (len(y) / len(languages) / np.maximum(np.bincount(y, minlength=len(languages)), 1))[y].astype(np.float32)
    model = LanguageModel(languages, Gru.new(rng, HIDDEN), Gru.new(rng, HIDDEN), (rng.standard_normal((2 * HIDDEN + 1, len(languages))) * 0.1).astype(np.float32))
    params = [*model.forward.parts(), *model.backward.parts(), model.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steps, total = 0, epochs * -(-len(rows) // TRAIN_BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), TRAIN_BATCH):
            pick = order[begin : begin + TRAIN_BATCH]
            seg, goal = data[pick], y[pick]
            f, f_trail = _read(model.forward, seg, range(width), keep=True)
            b, b_trail = _read(model.backward, seg, range(width - 1, -1, -1), keep=True)
            p = f @ model.out[:HIDDEN] + b @ model.out[HIDDEN:-1] + model.out[-1]
            p = np.exp(p - p.max(axis=2, keepdims=True))
            p /= p.sum(axis=2, keepdims=True)
            p[:, np.arange(len(pick)), goal] -= 1
            live = (seg.T != 256).astype(np.float32)
            p *= (live * weight[pick] / live.sum())[:, :, None]
            flat = p.reshape(-1, len(languages))
            d_out = np.concatenate([f.reshape(-1, HIDDEN).T @ flat, b.reshape(-1, HIDDEN).T @ flat, flat.sum(axis=0)[None]])
            grads = [*_back(model.forward, f_trail, p @ model.out[:HIDDEN].T, seg), *_back(model.backward, b_trail, p @ model.out[HIDDEN:-1].T, seg), d_out]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            steps += 1
            rate = RATE * (1 - steps / (total + 1)) * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            for k, g in enumerate(grads):
                g = g / max(1.0, norm)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return model


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """Train on a bounded sample: the rows with the smallest hashes of (id, length), their whole texts cut into windows."""
    text = F.col(text_col)
    lettered = labelled.where(text.isNotNull() & F.col(lang_col).isNotNull() & (F.length(text) <= TRAIN_CHARS) & text.rlike(r"\p{L}"))
    order = F.xxhash64(F.col(id_col).cast("string"), F.length(text), F.lit("language"))
    # a threshold first: the tasks together hand on a few times what is wanted, however many they are
    known = labelled.where(F.col(lang_col).isNotNull()).count()
    lettered = lettered.where(F.pmod(order, F.lit(1 << 30)) < int(min(1.0, 4 * rows / max(known, 1)) * (1 << 30)))
    picked = lettered.select((F.length(text) > TRAIN_CHARS // SHARES).alias("wide"), order.alias("o"), F.length(text).alias("n"), text.alias("w"), F.col(lang_col).alias("l"))
    # a bounded sample: at most ``rows`` rows are ordered by the window
    sample = picked.orderBy("wide", "o", "l", "w").limit(rows).withColumn("chars", F.sum("n").over(Window.orderBy("wide", "o", "l", "w").rowsBetween(Window.unboundedPreceding, 0)))
    found = sample.where(F.col("chars") <= TRAIN_CHARS).select("w", "l").collect()
    cut = [(raw[k : k + TRAIN_WINDOW], r.l) for r in found for raw in [r.w.encode("utf-8", "replace")] for k in range(0, len(raw), TRAIN_WINDOW)]
    return train([w for w, _ in cut], [y for _, y in cut])


def label_documents(docs: DataFrame, model: LanguageModel | None, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, then the predicted language and its probability. Row by row, no shuffle."""
    rows = docs.select(*keep, *([] if text_col in keep else [text_col]))
    at = rows.columns.index(text_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                found, scores = model.predict(texts) if model else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])

    return rows.mapInArrow(run, ", ".join([*fields, f"{names[0]} string", f"{names[1]} double"]))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return label_documents(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
