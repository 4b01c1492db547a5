import random
import re

import pytest

from lodestone.functions.analysis import lexemes
from lodestone.operators import lexical as X


def stretches(places, branches):
    """All shortest stretches by trying every pair of ends."""
    holds = lambda l, r, u: any(l <= b and e <= r for b, e in places.get(u, []))
    ok = lambda l, r: any(all(holds(l, r, u) for u in b) for b in branches)
    last = max((e for x in places.values() for _, e in x), default=-1)
    return [(l, r) for l in range(last + 1) for r in range(l, last + 1) if ok(l, r) and not ok(l + 1, r) and not ok(l, r - 1)]


def brute_density(places, branches):
    words = {k for x in places.values() for b, e in x for k in range(b, e + 1)}
    return sum(0.1 / (1 + (r - l) - (len([k for k in words if l <= k <= r]) - 1)) for l, r in stretches(places, branches))


def test_cover_density_by_hand():
    assert X.cover_density({0: [(0, 0)], 1: [(1, 1)]}, [[0, 1]]) == pytest.approx(0.1)
    assert X.cover_density({0: [(0, 0)], 1: [(4, 4)]}, [[0, 1]]) == pytest.approx(0.1 / 4)
    assert X.cover_density({0: [(0, 0), (5, 5)], 1: [(1, 1), (9, 9)]}, [[0, 1]]) == pytest.approx(0.1 + 0.1 / 4 + 0.1 / 4)
    assert X.cover_density({0: [(3, 3), (7, 7)]}, [[0]]) == pytest.approx(0.2)
    # the same word wanted twice is one place
    assert X.cover_density({0: [(1, 1), (6, 6)], 1: [(1, 1), (6, 6)]}, [[0, 1]]) == pytest.approx(0.2)


def test_cover_density_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        units = rng.randint(1, 4)
        width = [rng.choice([1, 1, 2]) for _ in range(units)]
        places = {u: sorted({(b, b + width[u] - 1) for b in (rng.randint(0, 14) for _ in range(rng.randint(1, 4)))}) for u in range(units)}
        branches = [sorted(rng.sample(range(units), rng.randint(1, units))) for _ in range(rng.randint(1, 2))]
        assert X.cover_density(places, branches) == pytest.approx(brute_density(places, branches)), (places, branches)


def brute_query(text, docs, analyzer):
    """{id: (coverage, rank, fallback)} of one query."""
    branches, words = [[]], []
    for term in re.findall(r'-?"[^"]*"|[^\s"]+', text or ""):
        if term.lower() == "or":
            branches.append([])
            words.append("or")
            continue
        found = [(k, w) for k, w in enumerate(lexemes(term, analyzer)) if w is not None]
        if found:
            branches[-1].append((term.startswith("-"), [(k - found[0][0], w) for k, w in found]))
            words += [w for _, w in found]
    strict, loose = {}, {}
    for i, t in docs:
        have = lexemes(t, analyzer)
        at = lambda unit, have=have: [(k, k + unit[-1][0]) for k in range(len(have)) if all(k + o < len(have) and have[k + o] == w for o, w in unit)]
        whole = [[u for no, u in b if not no] for b in branches if any(not no for no, _ in b) and all(bool(at(u)) != no for no, u in b)]
        if whole:
            units = [u for b in whole for u in b]
            strict[i] = (1.0, brute_density({k: at(u) for k, u in enumerate(units)}, [[units.index(u) for u in b] for b in whole]), False)
        n = len(set(words) & set(have))
        if n:
            loose[i] = (n / len(set(words)), 0.1 * sum(w in set(words) for w in have), True)
    return strict or loose


@pytest.mark.parametrize("analyzer", ["simple", "spanish"])
def test_queries_against_brute_force(spark, analyzer):
    rng = random.Random(5)
    vocabulary = "casa casas Tarifa tarifas de la ley impuesto impuestos sol".split()
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for k in range(60)] + [(90, None), (91, ""), (92, "Ley, ley; LEY!")]
    queries = ["casa tarifa", '"casa tarifa"', "ley or sol -casa", "-casa", "sol -sol", '-"la ley" impuesto', "casa-tarifa", "or casa or", "nunca jamás", "", None, "de la", 'ley "tarifas de la" or impuestos casa', "ley ley", "nada or sol", '"', "--ley"]
    parsed = X.parse_queries(spark.createDataFrame(list(enumerate(queries)), "query_id int, text string"), analyzer)
    posted = X.postings(spark.createDataFrame([(i, t, "x") for i, t in docs], "id long, text string, lexeme string"), analyzer, parsed.selectExpr("explode(lexemes) AS lexeme"))
    got = {}
    for r in X.lexical_matches(parsed, posted).collect():
        got.setdefault(r.query_id, {})[r.id] = (r.coverage, r.rank_cd, r.is_fallback)
    for k, q in enumerate(queries):
        want = brute_query(q, docs, analyzer)
        assert set(got.get(k, {})) == set(want), q
        for i, (coverage, rank, fallback) in want.items():
            assert got[k][i][0] == pytest.approx(coverage) and got[k][i][1] == pytest.approx(rank) and got[k][i][2] == fallback, (q, i)


def test_vocabulary_beyond_what_is_handed_out(spark, monkeypatch):
    """With many words asked for the postings are joined with them; the result is the same."""
    monkeypatch.setattr(X, "VOCABULARY", 2)
    monkeypatch.setattr(X, "AT_ONCE", 3)
    chunks = spark.createDataFrame([(1, "a b c a"), (2, "d"), (3, "c x")], "id long, text string")
    asked = spark.createDataFrame([("a",), ("c",), ("d",), ("a",)], "lexeme string")
    assert sorted((r.id, r.lexeme, r.places) for r in X.postings(chunks, asked=asked).collect()) == [(1, "a", [0, 3]), (1, "c", [2]), (2, "d", [0]), (3, "c", [0])]
    assert X.postings(chunks).count() == 6 and X.postings(chunks.where("false"), asked=asked).count() == 0


def test_steps_and_sentences(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "a x b"), (3, "c"), (4, "a"), (5, "c c")], "id long, text string")
    parsed = X.parse_queries(spark.createDataFrame([(0, "a b"), (1, "c"), (2, "zz")], "query_id long, text string"))
    posted = X.postings(chunks)
    each = X.lexical_leg(parsed, posted)
    sentences = spark.createDataFrame([(0, 7), (1, 7)], "query_id long, of long")
    assert [(r.id, r.sentence_rank) for r in X.step_lexical_leg(each, sentences).orderBy("rank").collect()] == [(5, 1), (1, 1), (3, 2), (2, 2)]
    found = sorted(((r.query_id, r.strict, r.rank or 0, r.id or 0) for r in X.strict_sentences(parsed, posted, 1).collect()))
    assert found == [(0, True, 1, 1), (1, True, 1, 5), (2, False, 0, 0)]
