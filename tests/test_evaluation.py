from pyspark.sql import functions as F

from lodestone.operators import evaluation as E


def test_requirements(spark):
    rows = [("a", 1, 3, 1), ("a", 2, 2, 5), ("b", 1, 3, 0), ("b", 2, 2, None)]
    found = {r.run: (r.stated, r.total, r.coverage, r.delta) for r in E.requirement_coverage(spark.createDataFrame(rows, "run string, case_id int, declared int, misses int"), "a").collect()}
    assert found == {"a": (2, 5, 0.4, 0.0), "b": (3, 3, 1.0, 0.6)}


def test_central_claims(spark):
    rows = [(1, "x", ["x"], []), (2, "x", [], ["x (figure: absent)"]), (3, "x", ["old"], ["y (b: present but uncited)"]), (4, None, ["x"], []), (5, "x y", ["x"], ["x y z (c: absent)"])]
    declared = spark.createDataFrame([("x",), ("y",), ("x y",)], "claim string")
    found = {r.case_id: (r.missed, r.stale) for r in E.central_misses(spark.createDataFrame(rows, "case_id int, central string, missing array<string>, literals array<string>"), declared).collect()}
    assert found == {1: (True, 0), 2: (True, 0), 3: (False, 1), 5: (False, 1)}


def test_gates_and_causes(spark):
    figures = spark.createDataFrame([("a", 69.0), ("b", 0.5)], "gate string, value double")
    base = spark.createDataFrame([("a", 73.0, 4.0), ("b", 0.6, 0.0), ("c", 1.0, 0.0)], "gate string, baseline double, margin double")
    assert {r.gate: r.passed for r in E.gates(figures, base).collect()} == {"a": True, "b": False, "c": False}
    parts = spark.createDataFrame([(1, True, True), (1, False, False), (2, True, False)], "requirement int, in_corpus boolean, found boolean")
    assert {r.requirement: (r.cause, r.split) for r in E.requirement_causes(parts).collect()} == {1: (1, True), 2: (2, False)}


def test_outcomes_and_drops(spark):
    b = lambda v: F.lit(v)
    row = spark.range(1).select(
        E.ask_outcome(b(True), b(True), b(True), b("client"), b(True)).alias("a"), E.ask_outcome(b(True), b(False), b(False), b(None), b(True)).alias("b"), E.ask_outcome(b(False), b(False), b(True), b(None), b(True)).alias("c"),
        E.ask_outcome(b(False), b(False), b(True), b("client"), b(False)).alias("d"), E.drop_class(b("timeout"), b(429)).alias("e"), E.drop_class(b("http"), b(429)).alias("f"), E.drop_class(b("http"), b(503)).alias("g"), E.drop_class(b("http"), b(None).cast("int")).alias("h"),
    ).first()
    assert tuple(row) == ("charged_error", "refunded_error", "degraded", "declined", "timeout", "429", "5xx", "other_status")


def test_stage_sums(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (1, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0)], "ask_id int, stage string, seconds double")
    assert {r.ask_id: tuple(r)[1:] for r in E.stage_sums(rows, ["a", "b"]).collect()} == {1: (1.5, 2.0), 2: (None, None)}
