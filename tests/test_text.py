import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans.analytics import bucket

STRIPPED = [("¿Cuánto pago a la CCSS?", "¿ pago a la CCSS?"), ("¿Cómo?", "¿?"), ("qué-es «esto», y adónde va", "-es «esto», y"), ("Quemar cualquier va2", "Quemar cualquier va2"), ("por  para puedo", "por para puedo"), (None, None), ("", "")]


def test_question_words(spark):
    df = spark.createDataFrame([(a,) for a, _ in STRIPPED], "t string")
    assert [r[0] for r in df.select(T.strip_question_words(F.col("t"))).collect()] == [b for _, b in STRIPPED]


def test_fold_by_decomposition(spark):
    df = spark.createDataFrame([("Åš Őý  ÑANDÚ é",)], "t string")
    assert df.select(T.fold(F.col("t"))).first()[0] == "as oy nandu e"


@pytest.mark.parametrize(("seconds", "want"), [(None, "lt_1s"), (float("nan"), "lt_1s"), (float("inf"), "lt_1s"), (float("-inf"), "lt_1s"), (0.99, "lt_1s"), (1.0, "1s_3s"), (29.9, "10s_30s"), (30.0, "gte_30s")])
def test_latency_classes(spark, seconds, want):
    assert spark.createDataFrame([(seconds,)], "s double").select(bucket(F.col("s"))).first()[0] == want


def test_sentences_keep_their_digits_at_any_place(spark):
    row = spark.sql("SELECT '0 días. 1 mes y 1.  2 años o 2' AS t").select(T.sentences(F.col("t")).alias("s")).first()
    assert row.s == ["0 días.", "1 mes y 1.", "2 años o 2"]


def test_renumber_markers(spark):
    cases = {"a [1][2]": "a[2][1]", "a  [1] [3] b": "a[2][2] b", "[4] x": " x", "x [9]": "x", "x [0].": "x.", "[1][1][3][2]": "[2][1]", "no": "no", "": "", "a\n[1]": "a\n[2]", "[12x] [1": "[12x] [1"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.renumber_markers(F.col("t"), F.array(*map(F.lit, (2, 1, 2, 0)))).alias("out"))
    assert {r.t: r.out for r in df.collect()} == cases
    row = spark.range(1).select(T.renumber_markers(F.lit("a [1] b [1"), F.array(F.lit(1)), streaming=True).alias("s"), T.drop_unbacked_markers(F.lit("a [1][2] [3]"), F.lit(2)).alias("d"), T.drop_unbacked_markers(F.lit("a [1]"), F.lit(0)).alias("z"), T.renumber_markers(F.lit(None).cast("string"), F.array(F.lit(1))).alias("n")).first()
    assert tuple(row) == ("a[1] b", "a[1][2]", "a", None)


def test_first_json_object(spark):
    def plain(t):
        at, depth, quoted, skip = t.find("{"), 0, False, False
        for k in range(max(at, 0), len(t) if at >= 0 else 0):
            c = t[k]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return t[at : k + 1]
        return None

    rng = random.Random(1)
    texts = ["".join(rng.choice('{}"\\ax') for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["", "}{", '{"a": "}"}', '{"a": "\\\\"} }']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.first_json_object(F.col("t")).alias("o"))
    for r in df.collect():
        assert r.o == plain(r.t), r.t


def test_judge_verdict(spark):
    cases = {'{"verdict": "pass", "reason": "ok"}': ("pass", "ok", None), '{"verdict": "fail", "reason": 3}': ("fail", "", None), '{"verdict": "fail"}': ("fail", "", None), '{"verdict": true}': (None, None, "bad_verdict"), "{verdict}": (None, None, "malformed"), "pass": (None, None, "no_object"), '{"verdict": ["pass"]}': (None, None, "bad_verdict")}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.judge_verdict(F.col("t")).alias("v"))
    assert {r.t: tuple(r.v) for r in df.collect()} == cases


def test_typo_runs(spark):
    cases = {"deeeclarar ppagado llama dedeclarar vivienda sesenta pagagado iii XXX CCSS": ["deeeclarar", "ppagado", "dedeclarar"], "a@ppago.cr www.ppago.cr http://x.y/ppago ppago.com": [], "Ppagado ppagado Ppagado": ["Ppagado", "ppagado"], "dado dada papa": [], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.typo_runs(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases
