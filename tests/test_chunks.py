from pyspark.sql import functions as F

from lodestone.operators import chunks


def _rows(spark, paragraphs):
    return spark.createDataFrame([(1, n, p) for n, p in enumerate(paragraphs)], "doc_id long, n int, p string")


def test_headings_and_articles_are_told_from_prose(spark):
    level = {"TÍTULO I": 0, "CAPÍTULO Vl": 1, "Sección Única. De la base": 2, "Sección única. De la base": None, "TÍTULO II. REFORMAS, ETC.": 0, "Título I, a un nuevo marco": None, "Capítulo II de la Ley sobre el": None, "título gratuito": None, "": None}
    label = {"ARTÍCULO 2-": "ARTÍCULO 2", "Artículo 11 bis.- Objeto": "Artículo 11 bis", "Artículo 64": "Artículo 64", "Artículo 25 del Reglamento": None, "Transitorio IX de la Ley": None, "TRANSITORIO IV.- Rige": "TRANSITORIO IV", "según el artículo 3.-": None}
    rows = _rows(spark, [*level, *label]).select("p", chunks.heading_level(F.col("p")).alias("level"), chunks.article_label(F.col("p")).alias("label")).collect()
    found = {r.p: (r.level, r.label) for r in rows}
    assert {p: found[p][0] for p in level} == level
    assert {p: found[p][1] for p in label} == label


def test_paths_fall_with_higher_headings_and_front_matter_goes(spark):
    rows = chunks.structural_chunks(_rows(spark, ["front", "TÍTULO I", "CAPÍTULO I", "SECCIÓN II", "Artículo 1.- a", "b", "CAPÍTULO II", "Artículo 2.- c", "TÍTULO II", "d"]))
    found = sorted((r.chunk, r.label, tuple(r.path), r.body) for r in rows.collect())
    assert [x[1:] for x in found] == [
        ("Artículo 1", ("TÍTULO I", "CAPÍTULO I", "SECCIÓN II"), "Artículo 1.- a b"),
        ("Artículo 2", ("TÍTULO I", "CAPÍTULO II"), "Artículo 2.- c"),
        (None, ("TÍTULO II",), "d"),
    ]


def test_without_structure_all_text_stays_and_long_bodies_are_cut(spark):
    rows = chunks.structural_chunks(_rows(spark, ["x " * 1200 + "x", "end"]))
    parts = chunks.labelled_parts(rows, F.lit("Ley")).orderBy("part").collect()
    assert [len(p.content.split()) - 1 for p in parts] == [1000, 302]
    assert parts[0].content.startswith("[Ley] x")


def test_inline_articles_are_cut_and_keep_their_digits(spark):
    row = _rows(spark, ["Objeto 10 Artículo 8- 1234 según el Artículo 9 de la ley"]).select(chunks.split_inline(F.col("p")).alias("x")).first()
    assert row.x == ["Objeto 10", "Artículo 8- 1234 según el Artículo 9 de la ley"]


def test_preambles(spark):
    long = "una frase de recitales que tiene más de doce palabras y acaba con punto."
    docs = [
        (["LEY", "Considerando:", "Que sí.", "DECRETA:", "Artículo 1.- x"], "Considerando: Que sí."),
        (["LEY", "Con", "fundamento en la ley", "el artículo 5 dispone:", "algo", "Por tanto, ACUERDAN :", "Artículo 1.- x"], "Con fundamento en la ley el artículo 5 dispone: algo Por tanto,"),
        (["LEY", "N° 5", "Artículo 1.- x"], None),
        (["LEY", long, "CAPÍTULO I", "Artículo 1.- x"], "LEY " + long),
        (["Considerando:", "sin artículos"], None),
        (["DECRETA:", "Artículo 1.- x"], None),
        (["Artículo 1.- x", "Considerando: no"], None),
    ]
    df = spark.createDataFrame([(k, n, p) for k, (d, _) in enumerate(docs) for n, p in enumerate(d)], "doc_id int, n int, p string")
    assert {r.doc_id: r.body for r in chunks.preambles(df).collect()} == {k: b for k, (_, b) in enumerate(docs) if b}
