import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import audit as A
from tests.oracle import compare

DOCS, LABELS = "doc_id long, text string, lang string, mask int, n string", "doc_id long, quality int, toxic int"


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall("[#$%&*|]", text)), len(text)


def counts(texts):
    got = A.text_counts(pa.array(texts, pa.string()))
    return [tuple(int(got[c][k]) for c in A.COUNTS) for k in range(len(texts))]


def some_texts(rng, n):
    alphabet = ["a", "B", "ab", "é", "\U0001f600", " ", "  ", "\n", "\t\x0b", "#", "|", "Z", " ", "\x00"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(n)]


def test_counts_against_plain():
    texts = ["", " ", "a", "a a", *some_texts(random.Random(1), 200), "", "x"]
    assert counts(texts) == [plain(t) for t in texts]
    sliced = A.text_counts(pa.array(["zz", *texts, "y"], pa.large_string()).slice(1, len(texts)))
    assert sliced["words"].tolist() == [plain(t)[0] for t in texts]
    assert counts([]) == []


@pytest.mark.parametrize("shared", [False, True])
def test_long_text_and_shared_hashes(monkeypatch, shared):
    """With one hash for all words every document is counted word by word."""
    monkeypatch.setattr(A, "CHARS_AT_ONCE", 64)
    if shared:
        monkeypatch.setattr(A, "_hashes", lambda data, begin, end: np.zeros(len(begin), np.uint64))
    rng = random.Random(2)
    texts = [t * 3 for t in some_texts(rng, 30)] + ["x" * 1000, "ab " * 500 + "y" * 300, "y" * 300 + " ab" * 500, " " * 500]
    for t in texts:
        assert counts([t]) == [plain(t)]
    assert counts(texts) == [plain(t) for t in texts]


def brute(docs, labels):
    docs = [(i, t or "", g or "") for i, t, g, *_ in docs]
    fails = []
    for i, t, _ in docs:
        words, distinct, capitals, symbols, points = plain(t)
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)
        fails.append({c for c, x in zip("ABCDE", [words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * points, symbols > 0, copy]) if x})
    said = lambda i, k: any(r[0] == i is not None and r[k] == 1 for r in labels)
    out, shapley = {}, {}
    for part in {g for *_, g in docs}:
        for order in map("".join, permutations("ABCDE")):
            here = [(i, f) for (i, _, g), f in zip(docs, fails) if g == part]
            left = here
            for step, c in enumerate(order, 1):
                lost = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                out[part, order, step] = (len(left), len(lost), sum(c in f for _, f in here) - len(lost), sum(f == {c} for _, f in here), sum(said(i, 1) for i, _ in lost), sum(said(i, 2) for i, _ in lost))
                shapley[part, c] = shapley.get((part, c), 0) + len(lost)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    rows = A.op13_filter_audit(spark, str(tmp_path)).collect()
    found = {(r[0], r[1], r[2]): tuple(r[3:]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for i in range(120):
        n = rng.choice([0, 3, 199, 200, 260])
        body = " ".join(rng.choice(words[: rng.choice([20, 400])]) for _ in range(n)) + rng.choice(["", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3])
        docs.append((i, body, rng.choice(["en", "de", None, ""]), 1, "x"))
    docs += [(200 + k, docs[k % 7][1], "en", 1, "x") for k in range(40)] + [docs[3], docs[3], (None, docs[3][1], "de", 1, "y"), (None, None, None, None, None), (500, None, "fr", 1, "z"), (501, "", "fr", 1, "z"), (1, "another text", "en", 1, "z")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 250, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (7, None, None)]
    assert run(spark, tmp_path, docs, labels) == brute(docs, labels)


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path, [], []) == {}


def test_against_sql(spark):
    got, want = compare(spark, A.op13_filter_audit, A.OP13_SQL, "/root/testdata/sf0.001")
    assert got == want and len(got[1]) % 600 == 0
