"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _marked_letters() -> tuple[str, str]:
    """The composed Latin letters and what is left of them without marks (ñ counts as n), by decomposition."""
    found = [(c, unicodedata.normalize("NFD", c)[0]) for k in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", c := chr(k))) > 1]
    return "".join(c for c, _ in found), "".join(p for _, p in found)


MARKED, PLAIN = _marked_letters()

# Question words that a typed question may carry, and two auxiliaries.
QUESTION_WORDS = ["que", "cual", "cuales", "cuanto", "cuanta", "cuantos", "cuantas", "como", "cuando", "donde", "adonde", "quien", "quienes", "va", "ser"]

# Month names.
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "setiembre", "octubre", "noviembre", "diciembre"]


def fold(text: Column, collapse: bool = True, trim: bool = True) -> Column:
    """Without marks, lower case; white space collapsed and trimmed where asked for.

    Combining marks that stand alone are removed too, so decomposed text folds like composed text.
    """
    out = F.lower(F.translate(F.regexp_replace(text, r"[̀-ͯ]", ""), MARKED, PLAIN))
    out = F.regexp_replace(out, r"\s+", " ") if collapse else out
    return F.trim(out) if trim else out


def tokens(text: Column) -> Column:
    """The simple analyzer: lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def article_key(label: Column) -> Column:
    """«Artículo 11 bis» → «11 BIS», an ordinal sign may follow the number; null for what is not one numbered article."""
    folded, pattern = fold(label), r"^articulo (\d+) ?(?:\.?[°º])?(?: (bis|ter|quater|quinquies))?$"
    number, suffix = F.regexp_extract(folded, pattern, 1), F.regexp_extract(folded, pattern, 2)
    return F.when(number != "", F.trim(F.concat(F.regexp_replace(number, r"^0+(?=\d)", ""), F.lit(" "), F.upper(suffix))))


def _parted(text: str | Column) -> str | Column:
    """A blank on either side of every sign that is neither a blank nor an ASCII word character, and at both ends."""
    if isinstance(text, str):
        return " " + re.sub(r"([^a-zA-Z0-9_ ])", r" \1 ", text) + " "
    return F.concat(F.lit(" "), F.regexp_replace(text, r"([^a-zA-Z0-9_ ])", " $1 "), F.lit(" "))


def keyword_counts(folded: Column, keywords: list[list[str]]) -> Column:
    """For each list how many of its keywords stand in a folded text between signs that are no ASCII word characters."""
    lists = [F.array(*(F.lit(_parted(k)) for k in words)) for words in keywords]
    # the text is parted once, whatever the number of keywords
    counted = F.transform(F.array(_parted(folded)), lambda t: F.array(*(F.size(F.filter(words, lambda k: F.contains(t, k))) for words in lists)))
    return F.get(counted, 0)


def keyword_hits(folded: Column, keywords: list[str]) -> Column:
    return F.get(keyword_counts(folded, [keywords]), 0)


def strip_question_words(text: Column, words: list[str] = QUESTION_WORDS) -> Column:
    """Drop runs of letters and digits whose folded form is a question word; signs and all other runs stay, white space is collapsed."""
    forms = {c: c + c.upper() + "".join(m for m, p in zip(MARKED, PLAIN, strict=True) if p.lower() == c) for w in words for c in w}
    any_word = "|".join("".join(f"[{forms[c]}]" for c in w) for w in words)
    bare = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}])(?:{any_word})(?![\p{{L}}\p{{N}}])", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def sentences(text: Column) -> Column:
    """Cut at line ends and behind ``.!?`` before white space and an opening sign, capital or digit."""
    parts = F.split(text, r"\n+|(?<=[.!?])\s+(?=[\p{Lu}\p{N}¿¡«\"(\[])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def _number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("int"), F.lit(2**31 - 1))


def markers(answer: Column) -> Column:
    """Numbers of the markers ``[n]`` in order of place; what is beyond an int counts as the largest."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), _number)


def unclosed_markers(answer: Column) -> Column:
    """Numbers of ``[n`` that no bracket closes: before white space, a sign that no digit follows, or the end."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)(?=\s|[:;—–-]|[.,](?!\d)|$)"), F.lit(1)), _number)


def renumber_markers(text: Column, ordinals: Column, streaming: bool = False) -> Column:
    """Markers ``[n]`` as ``[ordinals[n - 1]]``: a run of markers says each ordinal once, and the blanks before it go.

    A marker without an ordinal (none, null or 0) is deleted. With ``streaming`` a marker that is still being written
    at the text's end is hidden.
    """
    run = r"[ \t]*(?:\[\d+\])+"

    def written(found: Column) -> Column:
        kept = F.array_distinct(F.filter(F.transform(markers(found), lambda n: F.when(n > 0, F.get(ordinals, n - 1))), lambda k: k > 0))
        return F.array_join(F.transform(kept, lambda k: F.concat(F.lit("["), k.cast("string"), F.lit("]"))), "")

    between, runs = F.split(text, run, -1), F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(0)), written)
    out = F.array_join(F.zip_with(between, runs, lambda b, r: F.concat(b, F.coalesce(r, F.lit("")))), "")
    return F.regexp_replace(out, r"[ \t]*\[\d*\z", "") if streaming else out


def drop_unbacked_markers(text: Column, sources: Column) -> Column:
    """A numbered answer without the markers beyond its ``sources``."""
    return renumber_markers(text, F.when(sources > 0, F.sequence(F.lit(1), sources)).otherwise(F.array().cast("array<int>")))


def first_json_object(text: Column) -> Column:
    """From the first brace to the one that closes it; braces within strings, and escaped quotes, don't count. Null without a whole object."""
    begin = F.instr(text, "{")
    body = F.substring(text, begin, F.length(text))
    state = F.struct(*(F.lit(v).alias(n) for n, v in (("depth", 0), ("quoted", False), ("escaped", False), ("at", 0), ("end", 0))))

    def step(s: Column, c: Column) -> Column:
        quote, inside = (c == '"') & ~s["escaped"], s["quoted"] & ~s["escaped"]
        depth = s["depth"] + F.when(s["quoted"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        at = s["at"] + 1
        return F.struct(
            depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (inside & (c == "\\")).alias("escaped"),
            at.alias("at"), F.when((s["end"] == 0) & (depth == 0), at).otherwise(s["end"]).alias("end"),
        )

    end = F.aggregate(F.split(body, ""), state, step, lambda s: s["end"])
    return F.when((begin > 0) & (end > 0), F.substring(body, F.lit(1), end))


def judge_verdict(reply: Column) -> Column:
    """struct<verdict, reason, error> of a reply with a JSON verdict ``pass`` or ``fail``; else why there is none. A reason that is no string is empty."""
    found = first_json_object(reply)
    parsed = F.try_parse_json(found)
    field = lambda name: F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")) == "STRING", F.try_variant_get(parsed, f"$.{name}", "string"))
    ok = F.coalesce(field("verdict").isin("pass", "fail"), F.lit(False))
    error = F.when(found.isNull(), "no_object").when(parsed.isNull(), "malformed").when(~ok, "bad_verdict")
    return F.struct(F.when(ok, field("verdict")).alias("verdict"), F.when(ok, F.coalesce(field("reason"), F.lit(""))).alias("reason"), error.alias("error"))


def clamp(text: Column, limit: int) -> Column:
    """At most ``limit`` characters: cut at the last space past the half, or hard, and an ellipsis."""
    cut = F.substring(text, 1, limit)
    space = F.lit(limit) - F.instr(F.reverse(cut), " ") + 1
    at = F.when((F.instr(cut, " ") > 0) & (space > limit // 2), space - 1).otherwise(limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(cut, F.lit(1), at.cast("int"))), F.lit("…")))


def clean_rewrite(text: Column, limit: int = 1000) -> Column:
    """First line without quotes around it, spaces collapsed; null if empty or too long."""
    line = F.trim(F.split(F.trim(text), r"\n")[0])
    line = F.regexp_replace(F.trim(F.regexp_replace(line, r"^[\"'«“]+|[\"'»”]+$", "")), r"\s+", " ")
    return F.when((line != "") & (F.length(line) <= limit), line)


# Beginnings of real words that start with a doubled syllable.
REDUPLICATED = r"^(?:vivi|sese|dada|rara|caca|queque|coco|papa|mama|nene|bebe|cucu|chacha|titi)"
ADDRESS = r"https?://\S+|www\.\S+|\S+@\S+|\S+\.(?:cr|com|org|net)\S*"


def typo_runs(text: Column) -> Column:
    """Words with a tripled letter, a doubled first letter (but ll), or a start of 2 to 4 letters said twice, each once, in order.

    Roman numerals, words in capitals, addresses and real words that start like that are left out.
    """
    words = F.regexp_extract_all(F.regexp_replace(text, f"(?i){ADDRESS}", " "), F.lit(r"(\p{L}+)"), F.lit(1))

    def odd(word: Column) -> Column:
        low = F.lower(word)
        twice = low.rlike(r"^(\p{L}{2,4})\1\p{L}") & ~low.rlike(REDUPLICATED)
        return (low.rlike(r"(\p{L})\1\1") | low.rlike(r"^(?!ll)(\p{L})\1") | twice) & ~low.rlike(r"^[ivxlcdm]+$") & ~((F.length(word) > 1) & (word == F.upper(word)))

    return F.array_distinct(F.filter(words, odd))


def figures(text: Column) -> Column:
    """Amounts with the colón sign and percentages, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[¢₡]\s?\d[\d.,]*\d|[¢₡]\s?\d|\d+(?:[.,]\d+)?\s?%"), F.lit(0)))


def format_number(value: Column, decimals: int) -> Column:
    """Dots between thousands, a comma before the decimals, rounded half up."""
    return F.translate(F.format_number(F.round(value.cast("decimal(28,8)"), decimals), decimals), ",.", ".,")


def error_description(name: Column) -> Column:
    """An error name as it is if it is short and plain, else ``other``."""
    return F.when(name.rlike(r"^[A-Za-z0-9_.:-]{1,48}$"), name).otherwise("other")


def local_time(ts: Column) -> Column:
    """The fixed local clock, six hours behind UTC, all year."""
    return ts - F.expr("INTERVAL 6 HOURS")


def local_date(ts: Column) -> Column:
    return F.date_format(local_time(ts), "yyyy-MM-dd")


def long_date(date: Column) -> Column:
    """«3 de mayo de 2026»."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(date))
    return F.concat(F.dayofmonth(date).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(date).cast("string"))


def html_paragraphs(html: Column) -> Column:
    """Paragraphs of a page: styles, scripts and comments go, block ends become line ends, other tags spaces, then entities."""
    bare = F.regexp_replace(html, r"(?is)<style\b.*?</style\s*>|<script\b.*?</script\s*>|<!--.*?-->", " ")
    lines = F.regexp_replace(bare, r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|title|head|body|section|article|nav|header|footer|blockquote|pre|hr)\b[^>]*>", "\n")
    plain = F.regexp_replace(lines, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    parts = F.transform(F.split(plain, "\n"), lambda s: F.trim(F.regexp_replace(s, r"[ \t\r\f ]+", " ")))
    return F.filter(parts, lambda s: s != "")


#: Words of a part, and words from one part's begin to the next.
PART_WORDS, PART_STEP = 1000, 900


def sub_parts(words: Column) -> Column:
    """array<struct<part, words>>: windows of ``PART_WORDS`` words, each ``PART_STEP`` behind the last; the window that reaches the end is the last."""
    n = F.ceil(F.greatest(F.lit(0), F.size(words) - PART_WORDS) / F.lit(PART_STEP)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(k.alias("part"), F.slice(words, k * PART_STEP + 1, F.lit(PART_WORDS)).alias("words")))
