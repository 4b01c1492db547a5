import random
import re

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.streaming import markers as M
from lodestone.streaming.runs import run_available

SCHEMA = "answer string, seq long, delta string"


def test_steps():
    """Cut anywhere, the same markers come out."""
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["[", "1", "23", "]", "[4]", " ", "x", "[5", "[[6]]"]) for _ in range(rng.randint(0, 30)))
        found, tail, at = [], "", 0
        while at < len(text):
            n = rng.randint(1, 4)
            more, tail = M.step(tail, text[at : at + n])
            found, at = found + more, at + n
        assert found == re.findall(r"\[(\d+)\]", text)


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rng = random.Random(2)
    texts = {f"a{k}": "".join(rng.choice(["[12]", "[3", "]", " word ", "[", "7]"]) for _ in range(30)) for k in range(8)}
    deltas = [(a, s, t[3 * s : 3 * s + 3]) for a, t in texts.items() for s in range((len(t) + 2) // 3)]
    rng.shuffle(deltas)  # deltas come in any order, over three batches
    folder = lambda name: str(tmp_path / name)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder("in"))
    got = []
    for k in range(3):
        part = deltas[k::3] + (deltas[:5] if k == 2 else [])  # some are sent twice
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder("in"))
        got.append(run_available(M.marker_stream(source), folder("out"), folder("state")).collect())
    assert len(got[0]) <= len(got[1]) <= len(got[2]) == len({(r.answer, r.place) for r in got[2]})
    for a, t in texts.items():
        assert [r.marker for r in sorted(got[2], key=lambda r: r.place) if r.answer == a] == re.findall(r"\[(\d+)\]", t)


def test_numbers_beyond_an_int(spark):
    row = spark.range(1).select(T.markers(F.lit("[1][12345678901] [007]")).alias("m"), T.unclosed_markers(F.lit("[99999999999 ")).alias("u")).first()
    assert row.m == [1, 2**31 - 1, 7] and row.u == [2**31 - 1]
