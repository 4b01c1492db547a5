import pytest

from lodestone.plans import registry


@pytest.mark.parametrize(("name", "column", "want"), [("fold_text_all", "folded", "uber que cosa"), ("question_word_strip_all", "text", "Über Cosa")])
def test_every_language_has_a_row(spark, tmp_path, name, column, want):
    rows = [(i, "Über  Qué Cosa", lang) for i, lang in enumerate(["es", "de", None])] + [(3, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: r[column] for r in got} == {0: want, 1: want, 2: want, 3: None}
