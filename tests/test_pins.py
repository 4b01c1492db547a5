import pytest

from lodestone.operators import pins


def test_formulas_compile_to_columns_and_refuse_the_rest(spark):
    row = spark.sql("SELECT map('a', 6.0D, 'b', 2.0D) AS values").select(pins.formula("-(a + b) * 3 / b", {"a", "b"}).alias("x")).first()
    assert row.x == -12.0
    for said in ("a ** 2", "c + 1", "f(a)", "a if b else 1", "'a'"):
        with pytest.raises(ValueError):
            pins.formula(said, {"a", "b"})


CHUNKS = "id long, doc_key string, article string, part int, label string, text string, laws string"
LAWS = [("regla", "ley", "Ley del Impuesto (texto consolidado)", "Ley 6826"), ("otra", "decreto", "Código Fiscal", "Decreto 1")]


def references(spark, text, doc="k", article="99", part=1, label=None):
    rows = spark.createDataFrame([(1, doc, article, part, label, text, "x")], CHUNKS)
    laws = spark.createDataFrame(LAWS, "doc_key string, regulates string, title string, norma string")
    return [(r.doc_key, r.article, r.figure) for r in pins.article_references(rows, laws).orderBy("pos").collect()]


def test_references(spark):
    own = lambda *xs: [("k", x, False) for x in xs]
    cases = {
        "la tarifa del artículo 4 y del artículo 5": [("k", "4", True), ("k", "5", True)],
        "artículos 3, 4, y 5": own("3", "4", "5"),
        "Según el artículo 10 bis de esta ley": own("10 BIS"),
        "artículo 7 inciso b) de la Ley 9635": [],
        "artículo 5 (*) de la Ley 7": [],
        "lo dice el artículo primero de esta ley": own("1"),
        "los artículos 8 y 9 de esta ley; artículos 18, 19 y 23": own("8", "9", "18", "19", "23"),
        "artículo 2º, artículo 1.º y artículo 004° de este Reglamento": own("2", "1", "4"),
        "los artículos 5 al 9; el antiguo artículo 72 al actual 87": own("5")[:0],
        "Otra cosa. ARTÍCULO 32.- Más. artículo 5—Este": [],
        "el artículo 46 (*) de esta Ley y el artículo 9 inciso 1.2) del presente Código": own("46", "9"),
        "el artículo 3 de la Constitución, del Código, artículo 8 del Reglamento": [],
        "el artículo 10 de la Ley.": [],
        "la tasa. El artículo 6": own("6"),
        "[Ley — Artículo 12] artículo 13": own("13"),
        "artículo 99 y artículo 7, artículo 7": own("7"),
        "el monto " + "x" * 90 + " artículo 7": own("7"),
        "el monto y " + "artículo 1 " * 9: [("k", "1", True)],
        "": [],
    }
    for text, want in cases.items():
        assert references(spark, text) == want, text


def test_references_of_regulated_laws_openings_and_preambles(spark):
    law = lambda *xs: [("ley", x, False) for x in xs]
    assert references(spark, "artículo 4 de la Ley, artículo 5 de la Ley citada y artículo 6 de la Ley Reguladora", "regla") == law("4", "5")
    assert references(spark, "artículo 4 de la Ley N° 6826; artículo 5 de la Ley 1; artículo 7 de la Ley del Impuesto vigente", "regla") == law("4", "7")
    assert references(spark, "artículo 4 de esta ley y artículo 5 de este Reglamento; artículo 99 de la presente ley; artículo 99", "regla") == [("ley", "4", False), ("regla", "5", False), ("ley", "99", False)]
    assert references(spark, "artículo 4 de la Ley 1", "otra") == [] and references(spark, None) == []
    assert references(spark, "Artículo 3. Ver artículo 4", part=0) == [("k", "4", False)] and references(spark, "artículo 3 y más", part=2) == [("k", "3", False)]
    assert references(spark, "Ver artículo 4", label="Preámbulo") == []
    rows = spark.createDataFrame([(1, "k", None, 0, None, "Ver artículo 4", "x")], CHUNKS)
    assert [r.article for r in pins.article_references(rows).collect()] == ["4"]


def test_an_id_goes_in_once_under_its_first_kind(spark):
    cut = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, pos int")
    more = spark.createDataFrame([(1, 12, "namedSource", 1), (1, 12, "derivedInput", 3), (1, 13, "derivedInput", 1), (1, 10, "salarioBase", 1), (2, 12, "namedSource", 1)], "query_id int, id int, kind string, pos int")
    rows = {(r.query_id, r.id, r.pos, r.pin) for r in pins.append_kinds(cut, more).collect()}
    assert rows == {(1, 10, 1, None), (1, 11, 2, None), (1, 13, 3, "derivedInput"), (1, 12, 4, "derivedInput"), (2, 12, 1, "namedSource")}
