import math
import random
import zlib

import numpy as np

from lodestone.llm import toxicity as T

BAD = ["grumblefoot", "snortwagon", "blatherskite", "nincompoop"]


def make(rng, toxic):
    syllables = ["the", "ing", "er", "on", "an", "re", "st", "ou", "ha", "ti"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 120))]
    for _ in range(rng.randint(1, 3) if toxic else 0):
        words[rng.randrange(len(words))] = rng.choice(BAD)
    return " ".join(words)


def rows(n, seed):
    rng = random.Random(seed)
    return [(make(rng, y := int(rng.random() < 0.2)), y) for _ in range(n)]


def plain_score(model, text):
    """Score of one text with new compressors for every window."""
    import zstandard as z

    words, step, gaps = (text or "").lower().split(), model.width // 2, []
    for k in range(0, max(1, len(words) - model.width + step) if words else 0, step):
        window = " ".join(words[k : k + model.width]).encode()
        size = lambda content: len(z.ZstdCompressor(level=T.LEVEL, dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(window))
        gaps.append(size(model.ordinary) - size(model.toxic + model.ordinary))
    x = [math.log1p(sum(g >= t for g in gaps)) for t in T.GAPS] + [max(gaps), sum(g >= 4 for g in gaps) / len(gaps), math.log1p(max(8, len(gaps)))] if gaps else [0.0] * (len(T.GAPS) + 3)
    logit = sum((v - m) / d * w for v, m, d, w in zip(x, model.mean, model.spread, model.weights)) + model.weights[-1] - model.shift
    p = 1 / (1 + math.exp(-logit))
    return p if any(g >= 2 for g in gaps) else min(p, 0.49)


def test_held_out_accuracy_and_plain_scores():
    model = T.train(rows(1200, 1))
    test = rows(400, 2)
    scores = model.score(np.array([model.features(t) for t, _ in test]))
    truth = np.array([y for _, y in test])
    assert ((scores >= 0.5) == truth).mean() > 0.97 and 0 <= scores.min() and scores.max() <= 1
    for text in [t for t, _ in test[:25]] + ["", None, "one", "a b c d e f g h i j k " * 40]:
        assert abs(plain_score(model, text) - model.score(model.features(text)[None])[0]) < 1e-6


def test_windows_and_copies():
    words = [str(k) for k in range(23)]
    assert [w.split()[0] for w in T.windows_of(words, 8)] == [b"0", b"4", b"8", b"12", b"16"] and list(T.windows_of([], 8)) == []
    assert {x for w in T.windows_of(words, 8) for x in w.decode().split()} == set(words)
    a, b = ["w%d" % i for i in range(50)], ["v%d" % i for i in range(50)]
    assert len(T.without_copies([(a, 1), (a[:-1], 1), (b, 0)])) == 2


def test_toxic_words_late_in_long_texts(spark):
    """Whole texts are learnt from: what marks them stands behind 3000 ordinary words."""
    rng = random.Random(5)
    long = lambda y: " ".join(make(rng, 0) for _ in range(40)) + (" " + make(rng, 1) if y else "")
    data = [(i, long(i % 4 == 0), int(i % 4 == 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"))
    fresh = [(long(k % 2), k % 2) for k in range(60)]
    assert np.mean([(model.score(model.features(t)[None])[0] >= 0.5) == y for t, y in fresh]) > 0.8


def test_query(spark, tmp_path):
    data = rows(700, 3)
    docs = [(i, t, "x") for i, (t, _) in enumerate(data)] + [(8000, None, None), (8001, "", None), (8002, "nincompoop " * 40_000, None), (None, "the", None), (3, data[3][0], "y")]
    labels = [(i, 1, y) for i, (_, y) in enumerate(data)] + [(1, 0, data[1][1]), (8000, None, None), (None, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, toxic string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = T.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[8000].score == by_id[8001].score < 0.5 <= by_id[8002].score
    tested = [r for r in got if r.held_out and r.doc_id < 700]
    assert tested and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in tested)
    assert np.mean([r.predicted == data[r.doc_id][1] for r in tested]) > 0.93


def test_without_labels(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [tuple(r) for r in T.op4_toxicity(spark, str(tmp_path)).collect()] == [(1, False, 0.0, 0)]


def test_empty_table_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert T.op4_toxicity(spark, str(tmp_path)).collect() == []
    data = rows(300, 6)
    docs = spark.createDataFrame([(i, t, 9.0, 5) for i, (t, _) in enumerate(data)], "doc_id long, text string, score double, o int")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    assert T.score_documents(docs, model, ["doc_id"]).where("score > 1").count() == 0


def test_long_labelled_text_changes_nothing_else(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE_CHARS", 400_000)
    data = rows(300, 7)
    docs, labels = [(i, t) for i, (t, _) in enumerate(data)], [(i, y) for i, (_, y) in enumerate(data)]
    long = [(1000 + k, "grumblefoot the ing " * 30_000) for k in range(5)]
    fit = lambda d, l: T.fit(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(l, "doc_id long, toxic int"))
    before, after = fit(docs, [*labels, *((i, 1) for i, _ in long)]), fit([*docs, *long], [*labels, *((i, 1) for i, _ in long)])
    assert before.toxic and before.toxic == after.toxic and np.array_equal(before.weights, after.weights)
