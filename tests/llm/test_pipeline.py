import hashlib
import random

import pytest

import corpus_pipeline as P
from lodestone.llm.pieces import model_path

sp = pytest.importorskip("sentencepiece")


def make(rng, words, n):
    return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(1)
    words = {"en": ["the", "ing", "er", "on", "wh"], "de": ["sch", "ung", "ü", "der", "keit"]}
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "de"])
        body = "\n".join(make(rng, words[lang], rng.randint(15, 40)) for _ in range(3))
        rows.append((i, body + ("\nthis site uses cookies for all visitors" if i % 4 == 0 else ""), lang, "s", len(body)))
    rows += [(500, rows[5][1].replace("\n", " ", 1), "en", "s", 1), (501, rows[7][1], "en", "s", 1), (502, "12 34 !!", "en", "s", 8), (503, None, None, None, None), (504, "", None, "s", 0), (5, rows[5][1], rows[5][2], "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
    assert {502, 503, 504}.isdisjoint(kept[0]) and set(range(240)) <= set(kept[0])
    cookies = [i for i, r in kept[1].items() if "cookies" in r.text]
    assert cookies == [0] and all(r.n_chars == len(r.text) for i, r in kept[1].items() if i % 4 == 0 and 0 < i < 240)
    assert set(kept[2]) == set(range(240)) and spark.read.parquet(f"{folder}/2").count() == 240
    assert set(kept[3]) == set(range(240))
    library = sp.SentencePieceProcessor(model_file=model_path())
    final = P.run(spark, folder).collect()
    assert {r.doc_id for r in final} == set(range(240))
    for r in final:
        ids = library.encode(kept[3][r.doc_id].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_long_text_and_clashing_columns(spark, folder):
    """A text of a megabyte and columns named like the operators' own go through all stages."""
    rng = random.Random(3)
    long = "\n".join(make(rng, ["the", "ing", "er", "on", "wh"], 12) for _ in range(14_000))
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60").selectExpr("*", "'x' AS score", "1 AS o", "2 AS n", "'y' AS key", "3 AS copies", "'z' AS w")
    docs = docs.union(spark.createDataFrame([(900, long, "en", "s", len(long), "x", 1, 2, "y", 3, "z")], docs.schema))
    docs.write.parquet(f"{folder}/clash/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{folder}/clash/labels.parquet")
    found = {r.doc_id: r for r in P.run(spark, f"{folder}/clash").collect()}
    assert set(found) == {*range(60), 900} and found[900].n_tokens > 100_000
