import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import batches
from lodestone.llm import leaks as L
from tests.oracle import compare

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    """[(id, words, hit word numbers, items)]"""
    runs = {}
    for item, text in items:
        w = words(text)
        m = min(len(w), window)
        for k in range(len(w) - m + 1 if m else 0):
            runs.setdefault(tuple(w[k : k + m]), set()).add(item)
    sizes = {len(r) for r in runs}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in runs:
                    hit.update(range(k, k + m))
                    found |= runs[tuple(w[k : k + m])]
        out.append((doc, len(w), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.begin, s.end)], r.items) for r in df.collect()), key=str)


def text(rng, n, vocabulary="a b c Dé d e-f".split()):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n"]) for _ in range(n))


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, spans int")


@pytest.mark.parametrize("window,block", [(3, 10_000), (4, 12), (3, 5)])
def test_against_brute_force(spark, monkeypatch, window, block):
    """Small blocks: many automatons in chains, items parted; small pieces: the state is carried."""
    monkeypatch.setattr(L, "CHARS_AT_ONCE", 16)
    monkeypatch.setattr(batches, "CHARS_AT_ONCE", 64)
    rng = random.Random(window * block)
    items = [(k, text(rng, rng.choice([1, 2, 3, 5, 9]))) for k in range(14)] + [(3, "b a c"), (None, "c c c c"), (50, None), (51, " .,"), (52, "A B"), (53, "a b")]
    docs = [(k, text(rng, rng.randint(0, 60))) for k in range(40)] + [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x a b y")]
    d, i = tables(spark, docs, items)
    assert got(L.find_contamination(d, i, window, block)) == brute(docs, items, window)


def test_automaton_is_whole(monkeypatch):
    """The longest match at the end of a text is the longest suffix that stands in an item."""
    rng = random.Random(4)
    items = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(1, 30))] for _ in range(12)]
    automaton = L.Automaton(3)
    for k, w in enumerate(items):
        automaton.add(str(k), w)
    stream = L.Stream(automaton.packed())
    runs = {tuple(w[a:b]) for w in items for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
    for _ in range(200):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 40))]
        longest = max((b - a for a in range(len(w)) for b in range(a + 1, len(w) + 1) if tuple(w[a:b]) in runs), default=0)
        assert stream.spans(b" ".join(w))[3] == longest
    assert len(automaton.length) <= 2 * sum(map(len, items)) + 1


def test_long_text(spark):
    item = " ".join(f"w{k}" for k in range(25))
    docs = [(0, "the " * 400_000 + item + " end" * 400_000), (1, item.replace("w12", "x")), (2, ("w0 " * 9) * 20_000), (3, " ".join(f"w{k}" for k in range(9)))]
    d, i = tables(spark, docs, [(7, item), (8, item)])
    rows = {r.doc_id: r for r in L.find_contamination(d, i).collect()}
    assert [(s.begin, s.end) for s in rows[0].spans] == [(400_000, 400_025)] and rows[0].items == ["7", "8"] and rows[0].n_words == 800_025
    assert [(s.begin, s.end) for s in rows[1].spans] == [(0, 25)] or [(s.begin, s.end) for s in rows[1].spans] == [(0, 12), (13, 25)]
    assert not rows[2].spans and not rows[3].spans and rows[3].longest == 9


def test_decontaminate(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(0, f"Before, {item.title()}! After. " + "more words " * 20), (1, item), (2, "clean text"), (3, None), (4, f"a {item.rsplit(' ', 1)[0]} b " + "x " * 30)]
    d, i = tables(spark, docs, [(1, item)])
    out = {r.doc_id: r for r in L.decontaminate(d, i).collect()}
    assert out[0].text == "Before, ! After. " + "more words " * 20 and 1 not in out and out[2].text == "clean text" and out[3].text is None and out[4].text == "a  b " + "x " * 30
    assert out[0]["items"] == "x"
    longer = {r.doc_id: r.text for r in L.decontaminate(d, i, most_words=10, most_coverage=1.0).collect()}
    assert longer[4] == docs[4][1] and longer[1] == ""


def test_empty_tables(spark):
    d, i = tables(spark, [(1, "a b c")], [(1, "a b")])
    assert L.find_contamination(d.where("false"), i).collect() == []
    assert got(L.find_contamination(d, i.where("false"))) == [(1, 3, [], [])]
    assert L.find_contamination(d, i).where(F.size("spans") > 0).count() == 1


def test_against_sql(spark):
    found, want = compare(spark, L.op11_benchmark_leaks, L.OP11_SQL, "/root/testdata/sf0.01")
    assert found == want and any(r[found[0].index("contaminated")] for r in found[1])
