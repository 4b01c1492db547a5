import hashlib

from pyspark.sql import functions as F

from lodestone.operators import gates as G
from lodestone.sources import history as H


def test_evidence(spark):
    chunks = spark.createDataFrame([("d", "1", "has 2026 here"), ("d", "1", "2026 too"), ("d", "2", "2026"), ("d", "2", None), ("e", "1", "other")], "doc_key string, article string, content string")
    facts = spark.createDataFrame([("d", "1", "year", "2026"), ("d", "2", "dated", "2026"), ("d", "2", "overridden", "2026"), ("d", "3", "year", "x"), ("e", "1", "overridden", "2026"), ("d", "1", "year", "here")], "doc_key string, article string, kind string, evidence string")
    found = {tuple(r)[:4]: r.problem for r in G.evidence_gate(chunks, facts).collect()}
    assert found == {("d", "1", "year", "2026"): None, ("d", "2", "dated", "2026"): "lacking", ("d", "2", "overridden", "2026"): None, ("d", "3", "year", "x"): "missing", ("e", "1", "overridden", "2026"): "lacking", ("d", "1", "year", "here"): "lacking"}


def test_pins(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    files = spark.createDataFrame([(k, bytearray(k.encode())) for k in "abcde"], "doc_key string, content binary")
    pins = spark.createDataFrame([("a", sha(b"a")), ("b", sha(b"x")), ("c", sha(b"x")), ("d", "ABC")], "doc_key string, sha256 string")
    assert {r.doc_key: r.state for r in G.pinned_binaries(files, pins, ["c", "a"]).collect()} == {"a": "matches", "b": "changed", "c": "accepted", "d": "bad_pin", "e": "unpinned"}


def test_kept_articles(spark):
    chunks = spark.createDataFrame([("d", 0, "Artículo 2", ["T"]), ("d", 1, "ARTÍCULO  1 ", ["T"]), ("d", 2, "Artículo 3", ["T"]), ("d", 3, "Artículo 3", ["U"]), ("d", 4, None, []), ("e", 0, "x", ["T"]), ("e", 1, None, None)], "doc_key string, n int, article string, path array<string>")
    keep = spark.createDataFrame([("d", "artículo 1"), ("d", "Artículo 2"), ("d", "Artículo  2"), ("d", "Artículo 3"), ("d", "Artículo 9")], "doc_key string, label string")
    kept, problems = G.kept_articles(chunks, keep)
    assert sorted((r.doc_key, r.n) for r in kept.collect()) == [("d", 0), ("d", 1), ("d", 2), ("d", 3), ("e", 0), ("e", 1)] and kept.columns == chunks.columns
    assert {(r.label.split()[-1], r.problem) for r in problems.collect()} == {("2", "twice"), ("3", "several_paths"), ("9", "nowhere")}


def test_excerpts(spark):
    text = "Title\nsee  the Annex here\nbody\nAnnex\nrows\n  Annex B \nend"
    cases = [
        ([("Annex", None)], "Annex\nrows\n  Annex B \nend", None),
        ([("Annex", "Annex B")], "Annex\nrows", None),
        ([("Title", "the Annex"), ("rows", None)], "Title\n\nrows\n  Annex B \nend", None),
        ([("e", None)], None, "from_ambiguous"), ([("nope", None)], None, "from_nowhere"), ([("rows", "zz")], None, "to_nowhere"),
        ([("rows", "Title")], None, "empty"), ([("rows", "rows")], None, "empty"), ([("Title", "end"), ("rows", None)], None, "crossing"), ([("end", None), ("Title", None)], None, "crossing"),
    ]
    texts = spark.createDataFrame([(k, text) for k in range(len(cases))] + [(99, text), (98, None)], "doc_id int, text string")
    slices = spark.createDataFrame([(k, p, a, b) for k, (s, _, _) in enumerate(cases) for p, (a, b) in enumerate(s)] + [(98, 0, "x", None)], "doc_id int, place int, `from` string, `to` string")
    got = {r.doc_id: (r.text, r.problem) for r in G.excerpts(texts, slices).collect()}
    assert got == {**{k: (t, p) for k, (_, t, p) in enumerate(cases)}, 98: (None, "from_nowhere")}


def test_history(spark):
    rows = spark.createDataFrame([(1, "u", 10, "q", None, "a [1][3] b [2]", ["x", "y"]), (2, "u", 20, "q", "c", "no", []), (3, "v", 15, "q", None, "z [1]", None), (4, None, 1, "q", None, None, None), (5, "u", 20, "q", None, "", [])], "id long, user_id string, created_at long, question string, condensed string, answer string, citations array<string>")
    stored = H.question_rows(rows)
    assert {r.id: r.answer for r in stored.collect()} == {1: "a[1] b[2]", 2: "no", 3: "z", 4: None, 5: ""}
    users = spark.createDataFrame([("u",), ("u",), ("w",)], "user_id string")
    assert [(r.id, r.pos) for r in H.history(stored, users).orderBy("pos").collect()] == [(5, 1), (2, 2), (1, 3)]
    gone = spark.createDataFrame([(1, "u"), (3, "u"), (5, None)], "id long, user_id string")
    assert sorted(r.id for r in H.without(stored, gone).collect()) == [2, 3, 4, 5]
    line = spark.range(1).select(H.event_lines("ask:", F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"), F.struct(F.lit("x").alias("c")).alias("d"))).first()[0]
    assert line == 'ask: {"a":1,"d":{"c":"x"}}'
