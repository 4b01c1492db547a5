import random
import re
from collections import defaultdict

from lodestone.llm import lines as L


def brute(rows, min_docs=L.MIN_DOCS):
    def keys(line):
        t = ["<*>" if re.search("[0-9]", x) else x for x in re.sub(r"[\t\r\f\x0b ]+", " ", line).strip(" ").split(" ")]
        n, a, b = len(t), len(t) // 3, len(t) * 2 // 3
        parts = [t[:a], t[a:b], t[b:]]
        if n >= L.FIELDS_FROM:
            return {(n, str(t[: L.DEPTH]), k, str([p for j, p in enumerate(parts) if j != k])) for k in range(3)}
        return {(n, str(t))} if t[0] else set()

    docs = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            for k in keys(line):
                docs[k].add(i)
    first = {k: min(v) for k, v in docs.items() if len(v) >= (2 if k[0] > 50 else min_docs)}
    out = []
    for i, text in rows:
        lines = [] if text is None else text.split("\n")
        keep = [x for x in lines if not any(first.get(k, i) != i for k in keys(x))]
        out.append((i, len(lines), len(lines) - len(keep), text if len(keep) == len(lines) else "\n".join(keep)))
    return sorted(out)


def run(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string").write.parquet(str(tmp_path / "documents.parquet"))
    return sorted(tuple(r) for r in L.op5_line_dedup(spark, str(tmp_path)).collect())


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    frames = ["user %s logged in from host %s at noon", "all rights reserved by %s", "short %s", "one two three four five six seven eight %s", "a  b\tc d %s "]
    words = ["alpha", "beta", "gamma 7", "x9", "é"]
    rows = [(i, "\n".join(rng.choice(frames).replace("%s", rng.choice(words)) if rng.random() < 0.5 else " ".join(str(rng.random()) + "w" if rng.random() < 0.1 else rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "same line here twice\nsame line here twice"), (204, "long " * 50_000)]
    got = run(spark, tmp_path, rows)
    assert got == brute(rows) and sum(r[2] for r in got) > 50


def test_variable_field_and_copies(spark, tmp_path):
    rows = [(i, f"job {i} of the nightly batch finished without any errors today\nunique words number w{'abcdefghij'[i]} q{'abcdefghij'[i]} {'xyzuvwrstm'[i]} tail {'klmnopqrst'[i]} end") for i in range(10)]
    got = run(spark, tmp_path, rows)
    assert [r[2] for r in got] == [0] + [1] * 9
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark, tmp_path):
    rows = [(1, "the same text in one document"), (1, "the same text in one document"), (1, "the same text in one document")]
    assert all(r[2] == 0 for r in run(spark, tmp_path, rows))
    (tmp_path / "b").mkdir()
    assert run(spark, tmp_path / "b", []) == []


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = L.op5_line_dedup(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
