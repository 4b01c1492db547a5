import random

import pytest

from lodestone.operators import search as S

QUERIES = "query_id int, text string"


@pytest.mark.parametrize("handed", [200_000, 0])
def test_against_plain_search(spark, monkeypatch, handed):
    monkeypatch.setattr(S, "HANDED", handed)
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    docs = [(k, say(rng.randint(0, 40))) for k in range(60)] + [(97, None), (98, ""), (99, "A, b; a! b")]
    queries = [(n, say(n)) for n in range(12)] + [(20, None), (21, "?!"), (22, "zz"), (23, "B A. B"), (24, docs[3][1])]
    got = S.phrase_matches(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(docs, "id long, text string"))
    plain = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) + " "
    want = {(q, i) for q, t in queries for i, u in docs if plain(t).strip() and plain(t) in plain(u)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_no_query_and_no_row(spark):
    one, none = spark.createDataFrame([(1, "a b c d e")], QUERIES), spark.createDataFrame([], QUERIES)
    chunks = spark.createDataFrame([(1, "a b c d e")], "id long, text string")
    assert S.phrase_matches(none, chunks).count() == 0 and S.phrase_matches(one, chunks.where("false")).count() == 0 and S.phrase_matches(one, chunks).count() == 1


def test_words_that_no_query_has_in_a_row_stay_where_they_are(spark):
    chunks = spark.createDataFrame([(1, "a b c d " * 50), (2, "d c b a " * 50)], "id long, text string")
    found = S.phrase_matches(spark.createDataFrame([(1, "a b c d e")], QUERIES), chunks)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
