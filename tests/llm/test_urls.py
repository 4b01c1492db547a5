import math
import random
import time
from itertools import combinations

from pyspark.sql import functions as F

from lodestone.llm import urls as U


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in U.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule = max(fits, key=len, default=None)
    return host, path, rule


URLS = [None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://A.Example.NET/en/1?x=/a#b", "http://example.net/enx", "x://example.com/de/", "x://notexample.com/de/1", "x://a.org/fr/?q", "x://org/fr/", "x://a.org#/fr/", "a\nb://É.net/\n?", "q://w://z.net/", "http://a.com/" + "long/" * 20_000]


def test_stated_rules(spark):
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = U.filter_urls(rows, U.RULES, None).collect()
    assert len(got) == len(URLS) * 2
    for r in got:
        host, path, rule = brute_rule(URLS[r.page_id % len(URLS)])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, U.RULES.get(rule, "allow"))


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(3)
    urls, bad = [], []
    for i in range(400):
        host, page, key = rng.choice(["spam", "news", "shop"]), rng.choice(["win", "read"]), rng.choice(["ref", "page"])
        urls.append(f"http://{host}.x.com/{page}/{i}?{key}=1")
        bad.append(rng.random() < (0.9 if host == "spam" and page == "win" else 0.75 if key == "ref" and host == "shop" else 0.1))
    df = spark.createDataFrame(list(zip(urls, bad)), "url string, bad boolean").select("url", U.url_parts(F.col("url")).alias("parts"), "bad")
    rows = [(tuple(sorted(r.parts)), r.bad) for r in df.collect()]
    share = sum(b for _, b in rows) / len(rows)
    rules = {}
    for parts in {s for p, _ in rows for k in range(1, len(p) + 1) for s in combinations(p, k)}:
        hit = [b for p, b in rows if set(parts) <= set(p)]
        for bad, base in ((True, share), (False, 1 - share)):
            c, n, z = hit.count(bad) / len(hit), len(hit), U.SURE
            low = (c + z * z / (2 * n) - z * math.sqrt(c * (1 - c) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if hit.count(bad) >= 20 and c >= 0.5 and low >= U.LIFT * base:
                rules[parts, bad] = c, c / base
    rules = {(p, y): c for (p, y), c in rules.items() if not any(x == y and set(s) < set(p) and d[0] >= c[0] for (s, x), d in rules.items())}
    mined = U.mine_rules(df)
    assert {(tuple(r.parts), r.label == U.BAD): round(r.confidence, 9) for r in mined.collect()} == {p: round(c, 9) for p, (c, _) in rules.items()}
    assert {y for _, y in rules} == {True, False}
    got = {r.url: r for r in U.match_rules(df.drop("parts"), mined).collect()}
    for url, (parts, _) in zip([r.url for r in df.collect()], rows):
        want = max((lift for (p, _), (_, lift) in rules.items() if set(p) <= set(parts)), default=None)
        assert (url in got) == (want is not None)
        assert want is None or any(abs(lift - want) < 1e-9 and abs(c - got[url].confidence) < 1e-9 and y == got[url].bad for (p, y), (c, lift) in rules.items() if set(p) <= set(parts))
    # the same urls in a table of ten times as many rows give the same bad rules
    more = df.union(spark.createDataFrame([(f"http://other.x.com/read/{i}?page=1", i % 10 < 3) for i in range(3600)], "url string, bad boolean").select("url", U.url_parts(F.col("url")).alias("parts"), "bad"))
    small = {r.rule_id for r in mined.where("label = '=bad'").collect()}
    assert "h:spam p:win =bad" in small and "h:spam p:win =bad" in {r.rule_id for r in U.mine_rules(more).collect()}


def test_query(spark, tmp_path):
    pages = [(i, f"http://h{i % 3}.com/en/{i}", "h") for i in range(60)] + [(99, None, None), (None, "http://a.org/fr/5.html", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, 0) for i in range(60)] + [(1, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.page_id: r for r in U.op9_url_filters(spark, str(tmp_path)).collect()}
    assert len(got) == 62 and got[3].verdict == "block" and got[3].confidence == 1.0 and got[4].verdict == "allow" and got[None].rule == "org/fr/"


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert U.op9_url_filters(spark, str(tmp_path)).count() == 0


def test_long_labelled_urls_end(spark):
    """40 parts that all urls share: neither all their combinations are mined nor all pairs of rules compared."""
    path = "/".join(f"part{k}" for k in range(40))
    df = spark.createDataFrame([(f"http://bad.com/{path}/{i}", True) for i in range(25)] + [(f"http://good.org/x{i}", False) for i in range(60)], "url string, bad boolean")
    began = time.time()
    rules = U.mine_rules(df.select(U.url_parts(F.col("url")).alias("parts"), "bad")).collect()
    assert time.time() - began < 60 and rules and all(len(r.parts) == 1 for r in rules)
    assert {r.label for r in rules} == {U.BAD, U.GOOD}


def plain_rules(rows):
    """{(parts, bad): confidence} from (parts, bad): every combination of parts with 20 urls of a label is looked at."""
    of, bads = {}, sum(1 << i for i, (_, bad) in enumerate(rows) if bad)
    for i, (parts, _) in enumerate(rows):
        for p in parts:
            of[p] = of.get(p, 0) | 1 << i
    order, todo, shown = sorted(of), [((), (1 << len(rows)) - 1)], {}
    while todo:
        parts, cover = todo.pop()
        for p in order:
            both = cover & of[p]
            if (not parts or p > parts[-1]) and max((both & bads).bit_count(), (both & ~bads).bit_count()) >= 20:
                shown[parts + (p,)] = both
                todo.append((parts + (p,), both))
    rules, share = {}, bads.bit_count() / len(rows)
    for parts, cover in shown.items():
        for bad, base in ((True, share), (False, 1 - share)):
            n, hit = cover.bit_count(), (cover & bads if bad else cover & ~bads).bit_count()
            c, z = hit / n, U.SURE
            low = (c + z * z / (2 * n) - z * math.sqrt(c * (1 - c) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if hit >= 20 and c >= 0.5 and low >= U.LIFT * base:
                rules[parts, bad] = c
    less = lambda p: (s for k in range(1, len(p)) for s in combinations(p, k))
    return {(p, y): round(c, 9) for (p, y), c in rules.items() if not any(rules.get((s, y), -1) >= c for s in less(p))}


def mined_rules(spark, rows):
    mined = U.mine_rules(spark.createDataFrame(rows, "parts array<string>, bad boolean")).collect()
    assert len({r.rule_id for r in mined}) == len(mined) and all(r.key in r.parts for r in mined)
    return {(tuple(r.parts), r.label == U.BAD): round(r.confidence, 9) for r in mined}


def test_parts_that_tell_only_together_are_found_beyond_the_telling_ones(spark):
    """Thirteen words of each url tell a little; x and y tell nothing alone, and together most."""
    rng = random.Random(5)
    rows = []
    for _ in range(360):
        x, y = rng.random() < 0.5, rng.random() < 0.5
        bad = rng.random() < (0.9 if x == y else 0.1)
        words = [f"w{k}{int(rng.random() < (0.7 if bad else 0.3))}" for k in range(13)]
        rows.append(([f"x{int(x)}", f"y{int(y)}", *words], bad))
    want = plain_rules(rows)
    assert {(("x1", "y1"), True), (("x0", "y1"), False)} <= set(want)
    assert mined_rules(spark, rows) == want


def test_rules_of_any_length_and_items_of_the_same_urls(spark, monkeypatch):
    """Five words are bad all together only; a and b stand in the same urls; the rules don't depend on what FP-growth combines."""
    rows = []
    for i in range(32 * 40):
        words = [f"w{k}" for k in range(5) if i >> k & 1]
        rows.append((words + ["every"] + ["a", "b"] * (i % 3 > 0), len(words) == 5 and i % 5 > 0 or i % 31 == 0))
    want = plain_rules(rows)
    assert any(p == ("w0", "w1", "w2", "w3", "w4") for p, _ in want)
    assert mined_rules(spark, rows) == want
    for most in (1, 3):
        monkeypatch.setattr(U, "MOST_PARTS", most)
        assert mined_rules(spark, rows) == want
