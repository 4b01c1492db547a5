"""Mixing sources to target weights by soft domain membership.

Method. A classifier learnt from a labelled table gives every document posterior probabilities of the
domains (here the quality mark of ``labels``). Each document gets a nonnegative rate, the number of
times that it is expected to be drawn; a domain's expected tokens are the sum of rate · tokens · posterior. The rates minimise the squared distance of these totals from
the targets, plus a small pull towards rate 1, by projected gradient steps. The targets are weights of
a budget: enough tokens that the heaviest domain keeps ``EPOCHS`` times what it holds, so that a
mixture thins out the other domains instead of giving up documents of that one. Documents are first
summed up by their (rounded) posteriors, as equal posteriors get equal rates; each step sums the
domains' expected tokens over these cells on the cluster, and only the few totals reach the driver. A
document's rate follows from its posteriors and the totals' course alone, so it is recomputed from
the steps, and no state of documents is kept. A descent that hasn't come to rest warns with the
targets and what was reached.

The rates become whole copies: the integer part, and one more where a hash of the document's id falls
below the rest. Tokens are runs of characters between white space. Null or empty texts have no tokens
and take part with rate 1. Without labels all documents have one domain. Repeated rows count each; an
empty table gives no rows. Columns whose names begin with two underscores are the operator's own.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import slices
from lodestone.session import materialize, table

#: Bounded sample of labelled rows and of their characters together, hashed features, words kept with theirs.
TRAIN_ROWS, SAMPLE_CHARS, SHARES, FEATURES, KEPT_WORDS = 4000, 48_000_000, 64, 1 << 15, 100_000
#: Pull towards rate 1, the change of a total (share of all tokens) that ends the descent, and the steps
#: after which rates that still move are an error.
PULL, STILL, STEPS = 1e-3, 1e-5, 300
#: Decimals of a posterior; documents of equal posteriors have equal rates, so they are one cell of the descent.
DECIMALS = 4
#: Weights of the domains ``q<quality>`` that the mixture aims at.
TARGET = {"q1": 0.95, "q0": 0.05}
#: How often the mixture goes through the heaviest domain.
EPOCHS = 1.05


class FeatureIds(dict):
    """word → feature; bounded."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "replace")) % FEATURES
        return found


def features_of(text: str) -> list[str]:
    """Words as they are, and the signs at their ends."""
    words = text.split()
    return words + ["\0" + w[-3:] for w in words if not w[-1:].isalnum()]


@dataclass
class DomainModel:
    """Naive Bayes on hashed words, with a logistic layer on its mean log-likelihoods for calibrated posteriors."""

    domains: list[str]
    table: np.ndarray  # features x domains
    layer: np.ndarray  # domains+2 x domains

    def evidence(self, ids: FeatureIds, text: str | None) -> np.ndarray:
        at = np.array([ids[w] for w in features_of(text or "")], np.int64)
        total = self.table[at].sum(axis=0) if len(at) else np.zeros(len(self.domains))
        scaled = np.sign(total) * np.log1p(np.abs(total))
        return np.array([*scaled, np.log1p(len(at)) / 10, 1.0])

    def posteriors(self, evidence: np.ndarray) -> np.ndarray:
        z = evidence @ self.layer
        p = np.exp(z - z.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], rounds: int = 400) -> DomainModel:
    domains = sorted({d for _, d in rows}) or ["all"]
    if len(domains) == 1:
        return DomainModel(domains, np.zeros((FEATURES, 1)), np.zeros((3, 1)))
    ids = FeatureIds()
    learn, calibrate = [r for k, r in enumerate(rows) if k % 2], rows[::2]
    counts = np.full((FEATURES, len(domains)), 0.05)
    for text, d in learn:
        for w, n in Counter(map(ids.__getitem__, features_of(text))).items():
            counts[w, domains.index(d)] += min(n, 3)
    logs = np.log(counts / counts.sum(axis=0))
    model = DomainModel(domains, logs - logs.mean(axis=1, keepdims=True), np.zeros((len(domains) + 2, len(domains))))
    x, y = np.array([model.evidence(ids, t) for t, _ in calibrate]), np.array([domains.index(d) for _, d in calibrate])
    goal = np.eye(len(domains))[y]
    for k in range(rounds):
        model.layer -= (2.0 / (1 + k / 100)) * (x.T @ (model.posteriors(x) - goal) / len(x) + 1e-4 * model.layer) / max(1.0, float((x * x).sum(axis=1).mean()) / 4)
    return model


def fit(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text") -> DomainModel:
    """Learn the domains from a bounded sample: whole texts of the labelled rows with the smallest hashes.

    Texts of more than ``1/SHARES`` of ``SAMPLE_CHARS`` come behind all others, longer ones than
    ``SAMPLE_CHARS`` are left out, so a labelled text of any length changes nothing for other rows.
    """
    known = labels.where(domain.isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(domain).alias("__domain"))
    # a threshold first: the tasks together hand on a few times what is wanted, however many they are
    low = F.pmod(F.col("__o"), F.lit(1 << 30)) < int(min(1.0, 4 * TRAIN_ROWS / max(labels.count(), 1)) * (1 << 30))
    # at most TRAIN_ROWS rows of three short values
    sample = F.broadcast(known.withColumn("__o", F.xxhash64(F.lit("mixing"), F.col("__id"))).where(low).orderBy("__o", "__id").limit(TRAIN_ROWS))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where("__text IS NOT NULL")
    # a bounded sample: the window orders at most TRAIN_ROWS rows
    so_far = F.sum(F.length("w")).over(Window.orderBy("wide", "__o").rowsBetween(Window.unboundedPreceding, 0))
    rows = texts.join(sample, "__id").groupBy("__o").agg(F.min("__text").alias("w"), F.min("__domain").alias("d")).where(F.length("w") <= SAMPLE_CHARS).withColumn("wide", F.length("w") > SAMPLE_CHARS // SHARES).withColumn("chars", so_far)
    return train([(r.w, r.d) for r in rows.where(F.col("chars") <= SAMPLE_CHARS).orderBy("__o").select("w", "d").collect()])


def document_domains(docs: DataFrame, model: DomainModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``__tokens`` and the posteriors ``__p`` in the order of the model's domains. Row by row."""
    rows = docs.select(*keep, *([] if text_col in keep else [text_col]))
    at = rows.columns.index(text_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = FeatureIds()
        for batch in batches:
            for part in slices(batch, at, rows=256):
                texts = part.column(at)
                tokens = pa.array([len((t.as_py() or "").split()) for t in texts], pa.int64())
                p = np.round(model.posteriors(np.array([model.evidence(ids, t.as_py()) for t in texts])), DECIMALS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), tokens, pa.array(list(p), pa.list_(pa.float64()))], [*keep, "__tokens", "__p"])

    return rows.mapInArrow(run, ", ".join([*fields, "__tokens long", "__p array<double>"]))


def rate_after(steps: list[list[float]]) -> Column:
    """A document's rate after the steps, from 1: r ← max(0, 1 + left · (r - 1) + p · step), ``left`` a step's last entry."""
    if not steps:
        return F.lit(1.0)
    course = F.array(*(F.array(*map(F.lit, s)) for s in steps))
    dot = lambda s: F.aggregate(F.zip_with(F.col("__p"), s, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(course, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), F.lit(1.0) + F.element_at(s, -1) * (r - 1.0) + dot(F.slice(s, 1, F.size(s) - 1))))


def solve_rates(domains: DataFrame, weights: np.ndarray, steps: int = STEPS) -> tuple[list[list[float]], np.ndarray, np.ndarray]:
    """Projected gradient descent on the table of (__tokens, __p): (steps, totals reached, targets).

    With T all tokens and S_k the tokens that domain k holds at rate 1 the objective is
    ½ Σ_k (reached_k - target_k)² / S_k + ½ PULL Σ_d tokens_d (rate_d - 1)². A document's gradient is
    divided by its tokens, after which the curvature is at most 1 + PULL, so steps of 1/(1 + PULL) descend.
    """
    n = len(weights)
    domains = materialize(domains.where("__tokens > 0").groupBy("__p").agg(F.sum("__tokens").alias("__tokens")))

    def totals(course: list[list[float]]) -> np.ndarray:
        rows = domains.withColumn("__rate", rate_after(course))
        return np.array([float(x or 0) for x in rows.agg(*(F.sum(F.col("__tokens") * F.col("__rate") * F.get("__p", F.lit(k))) for k in range(n))).first()])

    held = reached = totals([])
    total = held.sum()
    if not total:
        return [], held, held
    main, speed = int(weights.argmax()), 1.0 / (1.0 + PULL)
    goal = weights / weights[main] * (EPOCHS * held[main] if held[main] > 0 else total)
    course: list[list[float]] = []
    for _ in range(steps):
        course.append([*(float(x) for x in speed * (goal - reached) / np.maximum(held, 1e-6 * total)), 1 - speed * PULL])
        before, reached = reached, totals(course)
        if np.abs(reached - before).max() < STILL * total:
            break
    else:
        warnings.warn(f"mixing: after {steps} steps {reached.tolist()} tokens of {goal.tolist()} were reached", stacklevel=2)
    return course, reached, goal


def with_copies(rows: DataFrame, course: list[list[float]], id_col: str = "doc_id") -> DataFrame:
    """``__rate`` and ``__copies`` beside ``__tokens`` and ``__p``; rows of the same id draw the same lot."""
    rate = F.round(F.when(F.col("__tokens") > 0, rate_after(course)).otherwise(1.0), 6)
    lot = F.pmod(F.xxhash64(F.lit("copies"), F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("__rate", rate)
    return rows.withColumn("__copies", (F.floor("__rate") + (lot < F.col("__rate") - F.floor("__rate")).cast("long")).cast("int"))


def fit_mixture(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> tuple[DomainModel, DataFrame, list[list[float]]]:
    """(classifier, stored table of ``keep`` (the ids), tokens and posteriors, steps). Domains without a weight have weight 0;
    if no domain that the labels name has a weight, all have the same."""
    model = fit(docs, labels, domain, id_col, text_col)
    wanted = np.array([weights.get(d, 0.0) for d in model.domains])
    known = materialize(document_domains(docs, model, keep or [id_col], text_col))
    course, _, _ = solve_rates(known, wanted if wanted.sum() else np.ones(len(wanted)))
    return model, known, course


def mixed_documents(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as its copies say."""
    _, known, course = fit_mixture(docs, labels, domain, weights, id_col, text_col, docs.columns)
    rows = with_copies(known, course, id_col)
    return rows.where("__copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def quality_domain() -> Column:
    return F.concat(F.lit("q"), F.col("quality").cast("string"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is drawn: doc_id, n_tokens, domain, posterior, rate, copies."""
    model, known, course = fit_mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality_domain(), TARGET)
    best = F.array_position("__p", F.array_max("__p"))
    names = F.array(*map(F.lit, model.domains))
    return with_copies(known, course).select("doc_id", F.col("__tokens").alias("n_tokens"), F.element_at(names, best.cast("int")).alias("domain"), F.array_max("__p").alias("posterior"), F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))
