from pyspark.sql import functions as F

from lodestone.operators import routing as R


def test_routes_and_families(spark):
    cases = {
        "¿Cómo declaro el IVA?": ("hacienda", "T1-D"),
        "cuota de la Caja": ("ccss", None),
        "Hacienda y la patente municipal": ("municipal", None),
        "factura y cuota": ("general", None),
        "¿Un banco o una sociedad?": ("registro-nacional", None),
        "Fui a inscribirme dos años tarde": ("general", "T1-I"),
        "tribu-cr y renta": ("hacienda", "T1-E"),
        "código CABYS de la factura electrónica, d-104": ("hacienda", "T1-C"),
        "vacaciones": ("mtss", None),
        "inscripciones": ("general", None),
        "": ("general", None),
        None: (None, None),
    }
    df = spark.createDataFrame([(k, q) for k, q in enumerate(cases)], "query_id int, text string")
    got = {r.text: (r.r, r.f) for r in df.select("text", R.route(F.col("text")).alias("r"), R.family(F.col("text")).alias("f")).collect()}
    assert got == cases
    assert [(r.query_id, r.doc_key) for r in R.named_sources(df).collect()] == [(7, "cabys-dev")]
    catalogue = spark.createDataFrame([("T1-D", 2, "b"), ("T1-D", 1, "a"), ("T1-A", 1, "c")], "family string, place int, sentence string")
    assert sorted((r.query_id, r.place, r.sentence) for r in R.step_probes(df, catalogue).collect()) == [(0, 1, "a"), (0, 2, "b")]


def test_declines(spark):
    said = {r.c: r.d for r in spark.createDataFrame([(c,) for c in (*R.INSTITUTIONS, R.GENERAL, "?")], "c string").select("c", R.decline(F.col("c")).alias("d")).collect()}
    assert said["?"] is None and all(said[c].startswith(R.OPENING) for c in (*R.INSTITUTIONS, R.GENERAL))
    assert all(R.SCOPE in said[c] for c in R.INSTITUTIONS if c not in R.IN_SCOPE) and R.SCOPE not in said["ccss"]
    assert said["general"].count("- ") == 2 and said["general"].endswith("- CCSS: https://www.ccss.sa.cr")
    assert [c for c in said if said[c] and R.FACTS["mtss"] in said[c]] == ["mtss"]
    assert said["contadores"].index(R.FACTS["contadores"]) < said["contadores"].index("fuera de lo que cubro") < said["contadores"].index("ccpa.or.cr")
