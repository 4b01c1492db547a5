import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestone.operators import words as W
from lodestone.plans import repair

SCHEMA = "doc long, node int, part string, text string, proofing string, grammar boolean"
LETTERS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def plain_split(token, words, pairs, tokens, proofing):
    """One token by the rules as they are said, seam by seam."""
    low = token.lower()
    if "-" in low:
        return None
    read = "unchecked" if proofing != "flagged" and len(token) > 1 and token.isupper() else proofing
    least, times, rare = W.BARS[read]
    function = lambda w: w in W.FUNCTION_WORDS

    def by_words():
        best = None
        for at in range(1, len(low)):
            a, b = low[:at], low[at:]
            if not all(x in W.ONE_LETTER if len(x) == 1 else x in words for x in (a, b)) or b in W.INTERROGATIVES:
                continue
            if function(a) or (function(b) and b not in W.ENCLITICS) or (len(a) >= 4 and len(b) >= 4 and a not in W.PREFIXES):
                score = min(words.get(a, 1e9), words.get(b, 1e9))
                if best is None or score > best[0]:
                    best = score, at
        return best and best[1]

    def by_phrase():
        best = None
        for w in W.FUNCTION_WORDS if low not in W.NOT_JOINS else []:
            rest, head = low[len(w) :], len(low) - len(w)
            ends = [len(w)] if len(w) > 1 and low.startswith(w) and (len(rest) >= 4 or (len(rest) > 1 and function(rest))) and rest not in W.INTERROGATIVES else []
            ends += [head] if len(w) > 1 and low.endswith(w) and head >= 4 and w not in W.ENCLITICS else []
            for at in ends:
                if read == "checked" and not (function(low[:at]) and function(low[at:])):
                    continue
                score = pairs[low[:at], low[at:]]
                if score >= least and (tokens[low] <= rare or score >= times * tokens[low]) and (best is None or score > best[0]):
                    best = score, at
        return best and best[1]

    at = None
    if read == "flagged" and low not in words:
        at = by_words()
    if at is None:
        at = by_phrase()
        if at is not None and read == "unchecked" and low in words and not (function(low[:at]) and function(low[at:])):
            at = None
    inner = next((k for k in range(1, len(token)) if token[k].isupper()), None)
    if inner is not None and not token.isupper():
        at = at if at == inner and token[:inner].islower() and function(token[:inner]) else None
    return None if at is None else f"{token[:at]} {token[at:]}"


def brute(rows):
    out = set()
    for doc in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == doc and r[3] is not None), key=lambda r: r[1])
        run = [w.lower() for r in mine for w in LETTERS.findall(r[3])]
        tokens, pairs = Counter(run), Counter(zip(run, run[1:]))
        words = Counter(w.lower() for r in mine if r[4] == "checked" and not r[5] for w in LETTERS.findall(r[3]) if not (len(w) > 1 and w.isupper()))
        for r in mine:
            for t in LETTERS.findall(r[3]):
                split = plain_split(t, words, pairs, tokens, r[4])
                if split:
                    out.add((doc, t, r[4], split))
    return out


def test_joins_against_plain_rules(spark):
    rng = random.Random(3)
    vocabulary = "de la los en se lo que el título bienes plazo derechos dominio pleno porqué qué y o a para bienes-raíces Título LEY cobrar".split()
    rows = []
    for doc in range(25):
        for node in range(rng.randint(8, 20)):
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
            words += ["".join(rng.choice(vocabulary) for _ in range(2)) for _ in range(rng.randint(0, 3))]
            rng.shuffle(words)
            words += rng.choice(["de bienes", "de los", "plazo de", "el título", "que de"]).split() * rng.randint(0, 3) + rng.choice(["debienes", "delos", "plazode", "elTítulo", "DELOS", "quede"]).split()
            rows.append((doc, node, "", " ".join(words), rng.choice(["flagged", "unchecked", "checked", "checked"]), rng.random() < 0.2))
    rows += [(90, 0, "", None, None, False), (91, 0, "", "", "flagged", False)]
    got = {tuple(r) for r in W.joined_words(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert got == want and len(want) > 40 and {p for _, _, p, _ in want} == {"flagged", "unchecked", "checked"}


def repaired(spark, *pages):
    df = spark.createDataFrame([(k, p, "x") for k, p in enumerate(pages)], "page_id long, html string, node string")
    return [r.html for r in W.repaired_pages(df).orderBy("page_id").collect()]


def test_pages(spark):
    times = lambda phrase, n: " ".join(f"el texto {phrase} sigue." for _ in range(n))
    flagged, english = "<span class=SpellE>{}</span>".format, "<span lang=EN-US>{}</span>".format
    body = f"<p>{times('de bienes', 3)} {times('plazo de', 3)} {times('de los', 3)}</p>"
    pages = [
        body + flagged("debienes") + english("delos debajo plazode"),
        body + "debienes delos cobrarse",
        "<p>" + times("de bienes", 2) + "</p>" + english("debienes"),
        "<p>años siguientes y la Autoridad</p>" + flagged("añossiguientes") + flagged("laAutoridad") + flagged("ZonaFranca"),
        "<p>del t&iacute;tulo del t&iacute;tulo del t&iacute;tulo</p>" + english("delt&iacute;tulo &amp; otros"),
        flagged("gratuito,incluida 10:30,5 g.La a.b"),
        body + english("x@debienes.cr www.debienes.cr/debienes"),
        '<SPAN lang="EN-US"><b><span class="SpellE">debienes</span></b></SPAN>' + body,
        "<p>a &lt; b &amp; c</p><br/>",
        "",
    ]
    out = repaired(spark, *pages)
    assert out[0].endswith(flagged("de bienes") + english("de los debajo plazo de"))
    assert out[1].endswith("debienes de los cobrarse") and out[2] == pages[2]
    assert out[3].endswith(flagged("años siguientes") + flagged("la Autoridad") + flagged("ZonaFranca"))
    assert out[4].endswith(english("del título &amp; otros")) and out[5] == flagged("gratuito, incluida 10:30,5 g. La a.b")
    assert out[6] == pages[6] and out[7].startswith('<SPAN lang="EN-US"><b><span class="SpellE">de bienes</span>') and out[8] == pages[8]


def test_null_pages_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "<p>x</p>")], "page_id long, html string")
    assert [tuple(r) for r in W.repaired_pages(df).collect()] == [(2, "<p>x</p>")]
    assert W.repaired_pages(df.where(F.lit(False))).count() == 0


def test_words_are_never_rows_of_a_shuffle(spark):
    """Texts are dealt by document once; neither tokens nor seams are exploded, stored or joined."""
    nodes = spark.createDataFrame([(1, 0, "", "de la dela de la", "flagged", False), (1, 1, "", None, None, False), (None, 0, "", "dela", "flagged", False)], SCHEMA)
    df = W.joined_words(nodes)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange") == 2
    assert [tuple(r) for r in df.collect()] == [(1, "dela", "flagged", "de la")]


def test_repaired_lines_store_nothing(spark, monkeypatch):
    def stored(df):
        raise AssertionError("stored")

    for module in (W, repair):
        monkeypatch.setattr(module, "materialize", stored, raising=False)
    assert repair.repaired_lines(spark, "/root/testdata/sf0.001").count() > 0
