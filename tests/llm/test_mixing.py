import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing as M


def brute(tokens, p, weights, steps):
    """The same descent with all documents in one array."""
    r, held = np.ones(len(tokens)), (tokens[:, None] * p).sum(axis=0)
    main = weights.argmax()
    goal, speed = weights / weights[main] * held[main] * M.EPOCHS, 1 / (1 + M.PULL)
    reached = held
    for _ in range(steps):
        r = np.maximum(0, r + speed * (p @ ((goal - reached) / held) - M.PULL * (r - 1)))
        reached = (tokens[:, None] * r[:, None] * p).sum(axis=0)
    return r, reached, goal


@pytest.fixture(scope="module")
def posteriors():
    rng = np.random.default_rng(2)
    return rng.integers(0, 900, 500), np.round(rng.dirichlet([0.5, 0.2, 0.1], 500), 6)


def test_descent_against_brute_force(spark, posteriors):
    tokens, p = posteriors
    df = spark.createDataFrame([(i, int(n), [float(x) for x in q]) for i, (n, q) in enumerate(zip(tokens, p))], "doc_id long, __tokens long, __p array<double>")
    weights = np.array([0.3, 0.6, 0.1])
    course, reached, goal = M.solve_rates(df, weights)
    r, want, _ = brute(tokens, p, weights, len(course))
    assert np.allclose(reached, want) and np.abs(reached - goal).max() < 0.02 * goal.sum()
    got = {x.doc_id: (x["__rate"], x["__copies"]) for x in M.with_copies(df, course).collect()}
    assert all(abs(got[i][0] - (r[i] if tokens[i] else 1.0)) < 1e-5 for i in got) and min(r) >= 0
    assert all(abs(c - rate) < 1 for rate, c in got.values())
    assert abs(sum(c for _, c in got.values()) - sum(rate for rate, _ in got.values())) < 60


def rows(n, seed):
    rng = random.Random(seed)
    words = {"q1": ["alpha", "beta", "gamma"], "q0": ["buy###", "now***", "win"]}
    out = []
    for i in range(n):
        d = rng.choices(list(words), [6, 3])[0]
        out.append((i, " ".join(rng.choice(words[d]) for _ in range(rng.randint(5, 40))), d))
    return out


def test_query_reaches_the_targets(spark, tmp_path):
    data = rows(800, 1)
    docs = [(i, t, "x") for i, t, _ in data] + [(9000, None, None), (9001, "", None), (9002, "alpha " * 30_000, None), (None, "beta", None), (3, data[3][1], "y")]
    labels = [(i, int(d[1]), 0) for i, _, d in data if i % 2] + [(None, 1, 1), (1, None, None), (9000, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, copies string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = M.op7_source_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = {i: d for i, _, d in data}
    unlabelled = [r for r in got if r.doc_id in truth and r.doc_id % 2 == 0]
    assert np.mean([r.domain == truth[r.doc_id] for r in unlabelled]) > 0.95
    total = sum(r.n_tokens * r.rate for r in got)
    clean = sum(r.n_tokens * r.rate for r in got if r.domain == "q1")
    assert abs(clean / total - M.TARGET["q1"]) < 0.03 and all(r.rate >= 1 and r.copies for r in got if r.domain == "q1" and r.posterior > 0.99)
    assert all(r.rate == 1 and r.n_tokens == 0 for r in got if r.doc_id in (9000, 9001))
    mixed = M.mixed_documents(*(spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels")), M.quality_domain(), M.TARGET)
    assert mixed.columns == ["doc_id", "text", "copies"] and mixed.count() == sum(r.copies for r in got)


def test_without_labels_and_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in M.mixed_documents(docs, labels, M.quality_domain(), M.TARGET).collect()) == [1, 2]
    assert M.mixed_documents(docs.limit(0), labels, F.lit("a"), M.TARGET).count() == 0


def test_long_labelled_text_changes_nothing_else(spark, monkeypatch):
    monkeypatch.setattr(M, "SAMPLE_CHARS", 100_000)
    data = rows(200, 2)
    labels = spark.createDataFrame([*((i, d) for i, _, d in data), (900, "q1")], "doc_id long, d string")
    fit = lambda extra: M.fit(spark.createDataFrame([*((i, t) for i, t, _ in data), *extra], "doc_id long, text string"), labels, F.col("d"))
    before, after = fit([]), fit([(900, "alpha " * 50_000)])
    assert before.domains == after.domains == ["q0", "q1"] and np.array_equal(before.layer, after.layer)
