import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import near as N


def brute(rows):
    """Classes by comparing all pairs of shingle multisets."""
    def bag(t):
        w = N.WORD.findall(t.lower())
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [t])

    bags = [None if t is None else bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if a and b and sum((a & b).values()) / sum((a | b).values()) >= 0.8:
                parent[root(i)] = root(j)
    low = {}
    for i, (d, t) in enumerate(rows):
        r = root(i)
        low[r] = d if low.get(r) is None else min(low[r], d) if d is not None else low[r]
    return sorted((d, low[root(i)]) for i, (d, _) in enumerate(rows) if d is not None)


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.uniform(0.1, 4, 60), rng.uniform(0.1, 4, 60)
    a[:15] = 0.0
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sign = lambda w: N.dart_signatures([(elements[w > 0], w[w > 0])], 4000)[0]
    assert abs((sign(a) == sign(b)).mean() - true) < 0.04
    assert (sign(a) == sign(a[:] * 1.0)).all()


def test_a_set_has_the_same_darts_in_any_company():
    rng = np.random.default_rng(3)
    sets = [(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), None) for n in (3, 40, 900)]
    sets = [(e, rng.integers(1, 50, len(e)).astype(np.float64)) for e, _ in sets]
    together = N.dart_signatures(sets, 180)
    assert all((N.dart_signatures([s], 180)[0] == t).all() for s, t in zip(sets, together))
    one = np.ones(150)
    ids, ranks, owner = N._darts(N._mix(np.arange(150, dtype=np.uint64)), one, one, 9.0 * one)
    assert abs(len(ids) - 150 * 9) < 150 and ranks.max() < 9 and len(set(owner.tolist())) == 150


def test_regions_by_level():
    regions, width, share = N.regions_of_weights(np.array([7, 8], np.uint64), np.array([0.5, 6.0]))
    assert len(set(regions.tolist())) == 5 and width.tolist() == [1, 1, 1, 2, 4] and share.tolist() == [0.5, 1, 1, 1, 0.5]
    # heavy elements take few regions
    assert len(N.regions_of_weights(np.array([1], np.uint64), np.array([1e6]))[0]) == 21


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.choice([3, 7, 40, 150, 600]))) for _ in range(60)]
    out = list(texts)
    for t in texts[:40]:
        for edits in (0, 1, 2, 5):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w).upper() if edits == 0 else " ".join(w))
    base = [word() for _ in range(300)]
    for _ in range(40):  # a chain: each differs a little from the one before
        base[rng.randrange(300)] = word()
        out.append(" ".join(base))
    out += ["", "", " ", None, None, "one two", "One  two!", "x " * 40_000, "x " * 39_000]
    rng.shuffle(out)
    return [(i * 3 % 1009, t) for i, t in enumerate(out)] + [(0, out[0]), (0, out[0])]


def test_classes_against_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    got = sorted((r.doc_id, r.class_id) for r in N.near_duplicates(df).collect())
    assert got == brute(rows)


def test_open_buckets_are_searched_in_full(spark, rows, monkeypatch):
    """With bands of one row the buckets hold many dissimilar texts."""
    monkeypatch.setattr(N, "BANDS", 8)
    monkeypatch.setattr(N, "ROWS", 1)
    some = [r for r in rows if r[1] is None or len(r[1]) < 4000][:150]
    df = spark.createDataFrame(some, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in N.near_duplicates(df).collect()) == brute(some)


def test_keep_one(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    kept = N.keep_one(df).collect()
    nulls = [i for i, t in rows if t is None]
    want = sorted({c for (d, c) in brute(rows) if d not in nulls}) + nulls
    assert sorted(r.doc_id for r in kept) == sorted(want)


def test_rows_that_share_an_id_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a), (None, a), (None, "zz")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), (r.class_id or 0)) for r in N.near_duplicates(df).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (3, 1)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_with_null_and_shared_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    kept = lambda rows: sorted((tuple(r) for r in N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept([(1, a), (1, b), (2, b), (3, a)]) == [(1, a), (1, b)]
    # a null id gives way to another id of its class, and keeps a text of its own once
    assert kept([(None, a), (3, a), (None, b), (None, b), (None, c), (None, c + " end"), (None, None)]) == sorted([(3, a), (None, b), (None, min((c, c + " end"), key=lambda t: N.text_key(N.WORD.findall(t), t))), (None, None)], key=str)
