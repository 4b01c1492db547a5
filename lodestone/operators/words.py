"""Repair of words that run together in exported pages, by what the document itself writes.

A page is a list of nodes (doc, node, text, proofing, grammar): what stood between two tags, what the
proofing tool said about it (``flagged``, ``checked`` or ``unchecked``), and whether its grammar was
complained about. Evidence is counted for each document: its words that were checked and not flagged, all
its tokens, and the pairs of neighbours that it writes with a blank. Every place at which a suspicious
token might be split is a row, joined with the counts of its halves and of the pair; the best one that
clears the bar of the token's proofing splits it. Everything is keyed by document and word, so no document
is gathered but to write it again.

Null texts have no tokens; rows that share an id are one document; an empty table gives no rows.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from unicodedata import category

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize

# Closed-class words that run into their neighbours, in order.
FUNCTION_WORDS = "a al como con cuya cuyas cuyo cuyos de del e el en esta estas este estos la las lo los no o otra otras otro otros por que se según sin su sus u un una y".split()
# Pronouns that are attached to verbs; interrogatives that belong to their word; words of one letter; beginnings that build words; words that only look joined.
ENCLITICS = ["se", "lo", "la", "las", "los", "le", "les"]
INTERROGATIVES = ["qué", "cuál", "cuáles", "quién", "cómo", "dónde", "cuándo", "cuánto"]
ONE_LETTER = ["a", "e", "o", "u", "y"]
PREFIXES = "agro ante anti audio auto ciber contra electro entre extra foto geo hidro infra info inter macro maxi micro mini multi para pluri poli radio semi sobre socio super tecno tele termo ultra video".split()
NOT_JOINS = ["conque", "porque", "quede", "sede"]
# By proofing the pairs that vouch for a split, how often they must outnumber the token, and up to how many uses they need not.
BARS = {"flagged": (2, 5, 2), "unchecked": (3, 3, 0), "checked": (3, 3, 0)}
#: Letters of a half that is no function word.
LONG_HALF = 4
#: Pairs without which no token is split by them, and seams that a task puts out at once.
FEWEST, AT_ONCE = min(b[0] for b in BARS.values()), 8192

WORD = r"\p{L}+(?:-\p{L}+)*"
TOKEN = rf"[^\s<>]*[@/][^\s<>]*|www\.[^\s<>]*|{WORD}"
CAPITALS = r"^\p{Lu}{2,}$"
NODE = "doc {kind}, node int, part string, text string, proofing string, grammar boolean"

_PARTS = re.compile(r"<[^>]*>|[^<]+")
_SPAN = re.compile(r"<(/?)span\b([^>]*)>", re.I)
_FLAG = re.compile(r"""\bclass\s*=\s*["']?(spelle|grame)\b""", re.I)
_LANGUAGE = re.compile(r"""\blang\s*=\s*["']?([\w-]+)|mso-ansi-language\s*:\s*([\w-]+)""", re.I)


def nodes_of(page: str) -> Iterator[tuple[int, str, str | None, str | None, bool]]:
    """(number, part, decoded text or None for a tag, proofing, grammar) of a page's tags and texts in order."""
    spans: list[tuple[str, str]] = []
    for number, part in enumerate(_PARTS.findall(page)):
        if not part.startswith("<"):
            flags, languages = {f for f, _ in spans}, [x for _, x in spans if x]
            proofing = "flagged" if "spelle" in flags else "unchecked" if languages and not languages[-1].startswith("es") else "checked"
            yield number, part, markup.unescape(part), proofing, "grame" in flags
            continue
        span = _SPAN.fullmatch(part)
        if span and span[1]:
            del spans[-1:]
        elif span:
            flag, language = _FLAG.search(span[2]), _LANGUAGE.search(span[2])
            spans.append((flag[1].lower() if flag else "", (language[1] or language[2]).lower() if language else ""))
        yield number, part, None, None, False


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc, node, part, text, proofing, grammar) of all pages; tags have no text."""
    rows = pages.where(F.col(html_col).isNotNull()).select(id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()
        for batch in batches:
            for k, page in enumerate(batch.column(1)):
                found = list(nodes_of(page.as_py()))
                ids = batch.column(0).slice(k, 1).take(pa.array([0] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds))], ["doc", "node", "part", "text", "proofing", "grammar"])

    return rows.mapInArrow(run, NODE.format(kind=rows.schema[0].dataType.simpleString()))


def _one_of(column: Column, words: list[str]) -> Column:
    return column.isin(words)


def _capitals(token: str) -> bool:
    return len(token) > 1 and token.isupper() and all(category(c) == "Lu" for c in token)


def _worth(token: str, lower: str, proofing: str | None, tally: dict, pairs: dict) -> Iterator[tuple[int, int, int, int]]:
    """(at, score, left words, right words) of the seams that the document's pairs or, in a flagged token that is no word, its words may speak for."""
    by_words = proofing == "flagged" and not tally[lower][1]
    for at in range(1, len(token)):
        left, right = lower[:at], lower[at:]
        if (left in tally or left in ONE_LETTER) and (right in tally or right in ONE_LETTER):
            score, a, b = pairs.get((left, right), 0), tally.get(left, (0, 0))[1], tally.get(right, (0, 0))[1]
            if score >= FEWEST or (by_words and (a or left in ONE_LETTER) and (b or right in ONE_LETTER)):
                yield at, score, a, b


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc, proofing, vouching, said) by document and node the seams worth a look; only the counts of one document are held."""
    kinds = [pa.string()] * 3 + [pa.int64()] * 6
    names = ["doc", "token", "lower", "proofing", "uses", "words", "at", "score", "left_words", "right_words"]
    doc, before, kind = None, None, pa.null()
    tally: dict[str, list[int]] = {}
    pairs: dict[tuple[str, str], int] = {}
    asked: set[tuple] = set()
    rows: list[tuple] = []

    def settle() -> None:
        rows.extend((doc, *x, *tally[x[1]], *seam) for x in asked for seam in _worth(*x, tally, pairs))
        for held in (tally, pairs, asked):
            held.clear()

    def out() -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate([kind, *kinds])]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        kind = batch.schema.types[0]
        for of, proofing, vouching, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != doc:
                settle()
                doc, before = of, None
            for token in said.split(" "):
                lower = token.lower()
                counts = tally.setdefault(lower, [0, 0])
                counts[0] += 1
                counts[1] += vouching and not _capitals(token)
                if before is not None:
                    pairs[before, lower] = pairs.get((before, lower), 0) + 1
                before = lower
                if "-" not in lower:
                    asked.add((token, lower, proofing))
            if len(rows) >= AT_ONCE:
                yield out()
    settle()
    if rows:
        yield out()


def seams_with_evidence(nodes: DataFrame) -> DataFrame:
    """(doc, token, lower, proofing, uses, words, at, score, left_words, right_words): a document's texts meet in one place once, and only what may split a token goes on."""
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    vouching = F.coalesce((F.col("proofing") == "checked") & ~F.col("grammar"), F.lit(False))
    rows = nodes.where("text IS NOT NULL AND doc IS NOT NULL").select("doc", "node", "proofing", vouching.alias("vouching"), F.array_join(words, " ").alias("said")).where("said <> ''")
    rows = rows.repartition("doc").sortWithinPartitions("doc", "node").select("doc", "proofing", "vouching", "said")
    kinds = "token string, lower string, proofing string, uses long, words long, at long, score long, left_words long, right_words long"
    return rows.mapInArrow(_evidence, f"doc {rows.schema['doc'].dataType.simpleString()}, {kinds}")


def joined_words(nodes: DataFrame) -> DataFrame:
    """(doc, token, proofing, split): the tokens that a document's own usage splits, by their nodes' proofing."""
    # a word in capitals was never looked at, whatever its span says
    read = F.when((F.col("proofing") != "flagged") & F.col("token").rlike(CAPITALS), "unchecked").otherwise(F.col("proofing"))
    seams = seams_with_evidence(nodes).withColumns({"read": read, "at": F.col("at").cast("int")})
    seams = seams.withColumns({"left": F.substring(F.col("lower"), F.lit(1), F.col("at")), "right": F.substring(F.col("lower"), F.col("at") + 1, F.length("lower"))})
    left, right = F.col("left"), F.col("right")
    n_left, n_right = F.length("left"), F.length("right")
    is_function = lambda c: _one_of(c, FUNCTION_WORDS)
    both = is_function(left) & is_function(right)
    leading = is_function(left) & (n_left > 1) & ((n_right >= LONG_HALF) | ((n_right > 1) & is_function(right))) & ~_one_of(right, INTERROGATIVES)
    trailing = is_function(right) & (n_right > 1) & (n_left >= LONG_HALF) & ~_one_of(right, ENCLITICS)
    phrase = (leading | trailing) & ~_one_of(F.col("lower"), NOT_JOINS) & ((F.col("read") != "checked") | both)
    by_function = is_function(left) | (is_function(right) & ~_one_of(right, ENCLITICS))
    by_content = (n_left >= LONG_HALF) & (n_right >= LONG_HALF) & ~_one_of(left, PREFIXES)
    vocabulary = (F.col("read") == "flagged") & (F.col("words") == 0) & ~_one_of(right, INTERROGATIVES) & (by_function | by_content)
    # which function word speaks for the seam decides between equal ones: the list's order, leading before trailing
    order = F.array(*map(F.lit, FUNCTION_WORDS))
    turn = F.least(F.when(leading, F.array_position(order, left) * 2), F.when(trailing, F.array_position(order, right) * 2 + 1))
    seams = seams.withColumns({"phrase": phrase, "vocabulary": vocabulary, "turn": turn, "both": both}).where("phrase OR vocabulary")
    bar = lambda k: F.coalesce(*(F.when(F.col("read") == p, b[k]) for p, b in BARS.items()))
    score = F.col("score")
    vouched = F.col("phrase") & (score >= bar(0)) & ((F.col("uses") <= bar(2)) | (score >= bar(1) * F.col("uses")))
    known = lambda side: F.when(F.col(f"{side}_words") > 0, F.col(f"{side}_words"))
    half = lambda side: F.when(F.length(side) == 1, _one_of(F.col(side), ONE_LETTER)).otherwise(known(side).isNotNull())
    most = F.lit(2**62)
    rarer = F.least(F.coalesce(known("left"), most), F.coalesce(known("right"), most))
    best = seams.groupBy("doc", "token", "lower", "proofing", "read", "words").agg(
        F.max(F.when(F.col("vocabulary") & half("left") & half("right"), F.struct(rarer.alias("score"), (-F.col("at")).alias("at")))).alias("by_words"),
        F.max(F.when(vouched, F.struct(score.alias("score"), (-F.col("turn")).alias("turn"), "at", "both"))).alias("by_phrase"),
    )
    # a token that was accepted where it was checked is a word, unless it is two function words
    accepted = (F.col("read") == "unchecked") & (F.col("words") > 0) & ~F.col("by_phrase.both")
    at = F.coalesce(-F.col("by_words.at"), F.when(~accepted, F.col("by_phrase.at")))
    best = best.withColumn("at", at)
    # a change of case within a token is a name's, unless a function word stands before it
    changes = F.substring("token", 2, 1 << 30).rlike(r"\p{Lu}") & ~F.col("token").rlike(r"^\p{Lu}+$")
    head = F.regexp_extract("token", r"^(.[^\p{Lu}]*)\p{Lu}", 1)
    case_at = F.when(head.rlike(r"^\p{Ll}+$") & is_function(head), F.length(head))
    found = best.where(F.col("at").isNotNull() & (~changes | F.coalesce(case_at == F.col("at"), F.lit(False))))
    split = F.concat(F.substring(F.col("token"), F.lit(1), F.col("at")), F.lit(" "), F.substring(F.col("token"), F.col("at") + 1, F.length("token")))
    return found.select("doc", "token", "proofing", split.alias("split"))


def spaced(text: Column) -> Column:
    """A blank behind a comma or semicolon between letters, and behind a full stop between a small and a capital letter."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<=\p{L})([,;])(?=\p{L})", "$1 "), r"(?<=\p{Ll})\.(?=\p{Lu})", ". ")


def repaired_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes with ``fixed``: punctuation spaced where something was complained about, joined words split; addresses stay as they are."""
    splits = joined_words(nodes).groupBy("doc", "proofing").agg(F.map_from_entries(F.collect_list(F.struct("token", "split"))).alias("splits"))
    rows = nodes.join(splits, ["doc", "proofing"], "left")
    text = F.when((F.col("proofing") == "flagged") | F.col("grammar"), spaced(F.col("text"))).otherwise(F.col("text"))
    between, found = F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    written = F.transform(found, lambda t: F.when(t.rlike("[@/.]"), t).otherwise(F.coalesce(F.element_at("splits", t), t)))
    fixed = F.array_join(F.zip_with(between, written, lambda b, w: F.concat(b, F.coalesce(w, F.lit("")))), "")
    return rows.withColumn("fixed", F.when(F.col("splits").isNull(), text).otherwise(fixed)).drop("splits")


def repaired_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, html) with joins repaired; parts without a repair are as they were."""
    nodes = materialize(page_nodes(pages, id_col, html_col))
    rows = repaired_nodes(nodes)
    escaped = F.replace(F.replace(F.replace("fixed", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = F.when(F.col("text").isNotNull() & (F.col("fixed") != F.col("text")), escaped).otherwise(F.col("part"))
    return rows.groupBy(F.col("doc").alias(id_col)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", part.alias("part")))), lambda x: x["part"]), "").alias(html_col))
