import math
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import language as L

WORDS = {"xx": ["the", "thing", "with", "whan"], "yy": ["für", "schön", "und", "keit"], "zz": ["ñoca", "que", "ción", "para"]}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    langs = [rng.choice(list(WORDS)) for _ in range(300)]
    return L.train([text(rng, y, 12).encode()[: L.TRAIN_WINDOW] for y in langs], langs, epochs=6)


def test_gradients(monkeypatch):
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    net = L.Gru(*(rng.standard_normal(s) * 0.5 for s in ((257, 9), (3, 6), (3, 3))))
    segments = rng.integers(0, 5, (4, 6)).astype(np.int16)
    segments[0, 4:] = 256
    goal = rng.standard_normal((6, 4, 3))

    def loss():
        h, out = np.zeros((4, 3)), 0.0
        for t in range(6):
            new = L._step(net, h, net.byte[segments[:, t]])[0]
            h = np.where((segments[:, t] == 256)[:, None], h, new)
            out += (h * goal[t]).sum()
        return out

    h, trail = np.zeros((4, 3)), []
    for t in range(6):
        new, *kept = L._step(net, h, net.byte[segments[:, t]])
        pad = segments[:, t] == 256
        new[pad] = h[pad]
        trail.append((t, h, *kept, pad))
        h = new
    for p, g in zip(net.parts(), L._back(net, trail, goal, segments), strict=True):
        for _ in range(25):
            i = tuple(rng.integers(0, n) for n in p.shape)
            if p.shape[0] == 257:
                i = (int(rng.integers(0, 5)), i[1])
            was = p[i]
            p[i] = was + 1e-5
            up = loss()
            p[i] = was - 1e-5
            down = loss()
            p[i] = was
            assert abs((up - down) / 2e-5 - g[i]) < 1e-5


def test_learns_and_does_not_depend_on_the_batch(model):
    rng = random.Random(2)
    langs = [rng.choice(list(WORDS)) for _ in range(200)]
    texts = [text(rng, y, rng.choice([3, 20, 400])) for y in langs]
    found, scores = model.predict(texts)
    assert np.mean([a == b for a, b in zip(found, langs)]) > 0.97 and ((scores > 0.3) & (scores <= 1)).all()
    again, alone = zip(*(model.predict([t]) for t in texts[:20]))
    assert [a[0] for a in again] == found[:20] and np.allclose(np.concatenate(alone), scores[:20], atol=1e-5)


def test_whole_texts(model):
    """Every byte is labelled once."""
    texts = ["und " * 5000, "", None, "a", "é" * 193]
    _, counts = model.label_texts(texts)
    assert counts.tolist() == [20000, 0, 0, 1, 386]


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, text(rng, y := rng.choice(list(WORDS)), 30), y, y) for i in range(300)]
    rows += [(900, None, "xx", ""), (901, "", None, ""), (902, "123 !?", "yy", ""), (903, "und " * 60_000, None, ""), (None, "que para", None, ""), (5, rows[5][1], rows[5][2], "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op3_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "yy"] and by_id[900].score == 0
    lang = {r[0]: r[2] for r in rows}
    tested = [r for r in got if r.held_out and (r.doc_id or 999) < 300]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in tested]) > 0.95


def test_no_labels(spark, tmp_path):
    spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in L.op3_language_id(spark, str(tmp_path)).collect()] == [(1, False, "und", 0.0)]


def plain_probabilities(model, raw):
    """Position by position, number by number."""
    n, hidden = len(raw), model.forward.candidate.shape[0]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(net, order):
        h, out = [0.0] * hidden, {}
        for t in order:
            x = net.byte[raw[t]]
            z, r = ([sigmoid(sum(h[i] * net.gates[i][j + k] for i in range(hidden)) + x[j + k]) for j in range(hidden)] for k in (0, hidden))
            c = [math.tanh(sum(r[i] * h[i] * net.candidate[i][j] for i in range(hidden)) + x[2 * hidden + j]) for j in range(hidden)]
            h = [(1 - z[j]) * h[j] + z[j] * c[j] for j in range(hidden)]
            out[t] = h
        return out

    forward, backward = states(model.forward, range(n)), states(model.backward, range(n - 1, -1, -1))
    total = [0.0] * len(model.languages)
    for t in range(n):
        e = [math.exp(sum(v * model.out[i][k] for i, v in enumerate(forward[t] + backward[t])) + model.out[-1][k]) for k in range(len(total))]
        total = [a + b / sum(e) for a, b in zip(total, e)]
    return total


def test_against_plain_network(model):
    """A text of several segments is the sum of its segments; each is read by the plain network."""
    for one in ["für", "the thing ñoca", "x", "schön und keit " * 30]:
        raw = one.encode()
        n = -(-len(raw) // L.SEGMENT)
        size = -(-len(raw) // n)
        want = np.sum([plain_probabilities(model, raw[k : k + size]) for k in range(0, len(raw), size)], axis=0)
        totals, counts = model.label_texts([one, "other"])
        assert counts[0] == len(raw) and np.allclose(totals[0], want, atol=1e-3)


def test_long_labelled_text_changes_nothing_else(spark, monkeypatch):
    monkeypatch.setattr(L, "TRAIN_CHARS", 30_000)
    rng = random.Random(4)
    rows = [(i, text(rng, y := rng.choice(list(WORDS)), 12), y) for i in range(200)]
    schema = "doc_id long, text string, lang string"
    before, after = L.fit(spark.createDataFrame(rows, schema)), L.fit(spark.createDataFrame([*rows, *((300 + k, "the " * 10_000, "xx") for k in range(20))], schema))
    texts = [t for _, t, _ in rows[:50]]
    assert before.predict(texts)[0] == after.predict(texts)[0] and np.array_equal(before.out, after.out)
    only = L.fit(spark.createDataFrame([(1, "the " * 700, "xx"), (2, "und " * 700, "yy")], schema))
    assert only.languages == ["xx", "yy"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert L.op3_language_id(spark, str(tmp_path)).collect() == []
