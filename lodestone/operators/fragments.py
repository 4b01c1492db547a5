"""Paragraphs as extraction leaves them, put together again, and lists of questions as chunks.

Paragraphs are rows (doc_id, n, p). What goes together stands close together, so a row looks a bounded
number of rows ahead and behind, and the state that runs through a document (its section, the number of the
last question) is the last value of a window. Ids are to be unique; a document with too few questions gives
a row that says so and fails nothing. Blank paragraphs are no text; null ones count as blank. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import chunks

# Words that stand alone where a heading was cut, and how their other half begins.
ARTICLE_WORD = r"^(?:ART[ÍI]CULO|Art[íi]culo|TRANSITORIO|Transitorio)$"
HEADING_WORD = r"^(?:T[ÍI]TULO|T[íi]tulo|CAP[ÍI]TULO|Cap[íi]tulo|SECCI[ÓO]N|Secci[óo]n)$"
NUMBER_START = r"^(?:\d|[IVXLCDM]+\b)"
_SUFFIXES = "bis|ter|qu[áa]ter|quinquies|sexies|septies"
ORDINAL_START = rf"^(?:{_SUFFIXES}|BIS|TER|QU[ÁA]TER|QUINQUIES|SEXIES|SEPTIES)\b"
ENACTS = "DECRETA"
#: Lines that a wrapped caption may have.
CAPTION_LINES = 6

# How a question, an unnumbered one and a page's number look, and a section that goes by another name.
QUESTION = r"(?:^|\s)(\d{1,3})\.\s+(?=(?:¿|[^.?!]{1,180}¿))"
UNNUMBERED = r"^¿[^?]{1,300}\?"
PAGE_NUMBER = r"^(?:[1-9]|[1-3]\d|4[0-3])(?:\s+|$)"
SECTION_NAMES = {"Declaraciones y Pagos": "Declaraciones del RUT"}
#: Words of a section's heading.
SECTION_WORDS = 12


def _only_label(p: Column) -> Column:
    """A paragraph that is nothing but the label of an article."""
    return F.regexp_like(p, F.lit(chunks.ARTICLE.removesuffix("|$)") + "|$)$")) | p.rlike(chunks.TRANSITORY + "$")


def joined_fragments(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, n, p): a word and its number, a number and its suffix, a heading and its caption are one paragraph again.

    A caption may be wrapped over six lines; it is taken where they lead up to the next article or heading,
    or to the end, and look like a caption together.
    """
    order = Window.partitionBy("doc_id").orderBy("n")
    p = F.col("p")
    boundary = p.rlike(ARTICLE_WORD) | p.rlike(HEADING_WORD) | chunks.heading_level(p).isNotNull() | p.rlike(chunks.ARTICLE) | p.rlike(chunks.TRANSITORY)
    prose = (p.rlike("[a-záéíóúñü]") & p.rlike("[.:;]")) | p.rlike(ENACTS)
    rows = paragraphs.select("doc_id", "n", F.coalesce("p", F.lit("")).alias("p")).withColumn("line", F.struct("p", boundary.alias("edge"), prose.alias("prose"))).withColumn("i", F.row_number().over(order))
    rows = rows.withColumn("ahead", F.collect_list("line").over(order.rowsBetween(1, CAPTION_LINES + 2)))
    line = lambda k: F.get("ahead", k)
    first, second = line(F.lit(0))["p"], line(F.lit(1))["p"]
    is_true = lambda c: F.coalesce(c, F.lit(False))
    numbered = is_true(first.rlike(NUMBER_START))
    both = F.concat_ws(" ", p, first)
    word, suffix = p.rlike(ARTICLE_WORD) & numbered, _only_label(p) & is_true(first.rlike(ORDINAL_START))
    more = _only_label(both) & is_true(second.rlike(ORDINAL_START))
    split_heading = p.rlike(HEADING_WORD) & numbered
    begun, taken = F.when(split_heading, both).otherwise(p), F.when(split_heading, 1).otherwise(0)
    follows = F.slice("ahead", taken + 1, F.lit(CAPTION_LINES))
    stop = F.array_position(F.transform(follows, lambda x: x["edge"] | x["prose"]), True)
    lines = F.when(stop > 0, stop.cast("int") - 1).otherwise(F.size(follows))
    caption = F.array_join(F.transform(F.slice(follows, F.lit(1), lines), lambda x: x["p"]), " ")
    ends = F.coalesce(line(taken + lines)["edge"], F.lit(True))
    owned = chunks.heading_level(begun).isNotNull() & (lines > 0) & ends & chunks.caption_shaped(caption)
    whole = F.when(word & more, F.concat_ws(" ", both, second)).when(word | suffix, both).when(owned, F.concat_ws(" ", begun, caption)).otherwise(begun)
    used = F.when(word & more, 2).when(word | suffix, 1).when(owned, taken + lines).otherwise(taken)
    rows = rows.select("doc_id", "n", "i", whole.alias("p"), used.alias("used"))
    # what an earlier paragraph took never begins anything itself
    reach = F.max(F.col("i") + F.col("used")).over(order.rowsBetween(-(CAPTION_LINES + 2), -1))
    return rows.withColumn("reach", reach).where(F.coalesce(F.col("reach") < F.col("i"), F.lit(True))).select("doc_id", "n", "p")


def section_name(text: Column) -> Column:
    """The section that a line names, or null: a few words without signs, a page's number before them left out."""
    bare = F.trim(F.regexp_replace(text, PAGE_NUMBER, ""))
    names = F.create_map(*(F.lit(x) for pair in SECTION_NAMES.items() for x in pair))
    ok = (bare != "") & (F.size(F.split(bare, r"\s+")) <= SECTION_WORDS) & ~bare.rlike("[.!?¿:;]")
    return F.when(ok, F.coalesce(F.element_at(names, bare), bare))


def question_chunks(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, chunk, section, number, body): one row for each numbered question with its answer.

    A section is a short line before a question, alone or in front of it; within a list only one before
    question 1 counts. Numbered questions before any section (a table of contents) are passed over. A
    question without a number between k and k + 2 is k + 1.
    """
    order = Window.partitionBy("doc_id").orderBy("n")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = paragraphs.select("doc_id", "n", F.trim(F.coalesce("p", F.lit(""))).alias("p"))
    number = F.nullif(F.regexp_extract("p", QUESTION, 1), F.lit(""))
    begin = F.regexp_instr("p", F.lit(QUESTION))
    rows = rows.withColumns({"number": number, "next": F.lead(number).over(order)})
    rows = rows.withColumns({"head": F.when(number.isNotNull(), F.trim(F.substring("p", F.lit(1), begin - 1))), "question": F.when(number.isNotNull(), F.trim(F.substring(F.col("p"), begin, F.length("p"))))}).where("p <> ''")
    alone = F.when(F.col("number").isNull() & F.col("next").isNotNull(), section_name(F.col("p")))
    named = F.when(F.col("number").isNotNull(), section_name(F.col("head")))
    rows = rows.withColumns({"alone": alone, "named": named})
    # the first section of the document opens the list; from the first question on only one before question 1 is a section
    opened = F.max(F.coalesce("alone", "named").isNotNull()).over(earlier)
    accepted = F.col("number").isNotNull() & (F.col("named").isNotNull() | F.coalesce(opened, F.lit(False)))
    rows = rows.withColumn("accepted", accepted)
    counting = F.coalesce(F.max("accepted").over(earlier), F.lit(False))
    section = F.when(F.col("alone").isNotNull() & (~counting | (F.col("next") == "1")), F.col("alone")).otherwise(F.when(F.col("accepted"), F.col("named")))
    last = F.last(F.when(F.col("accepted"), F.col("number").cast("int")), ignorenulls=True).over(earlier)
    rows = rows.withColumns({"counting": counting, "opens": section, "last": last})
    inferred = F.col("counting") & F.col("number").isNull() & F.col("opens").isNull() & F.col("p").rlike(UNNUMBERED) & F.coalesce(F.col("next").cast("int") == F.col("last") + 2, F.lit(False))
    starts = F.col("accepted") | inferred
    rows = rows.withColumns({"starts": starts, "asked": F.when(F.col("accepted"), F.col("number").cast("int")).when(inferred, F.col("last") + 1)})
    rows = rows.withColumns({"chunk": F.sum(F.col("starts").cast("int")).over(order), "section": F.last("opens", ignorenulls=True).over(order)})
    inside = rows.where("chunk > 0 AND (starts OR opens IS NULL)")
    text = F.when(F.col("accepted"), F.col("question")).when(F.col("starts"), F.col("p")).otherwise(F.trim(F.regexp_replace("p", PAGE_NUMBER, "")))
    body = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"]), " "))
    return inside.groupBy("doc_id", "chunk").agg(F.max(F.when(F.col("starts"), F.col("section"))).alias("section"), F.max("asked").alias("number"), body.alias("body"))


def too_few_questions(docs: DataFrame, questions: DataFrame, minimum: int) -> DataFrame:
    """(doc_id, found): documents with fewer than ``minimum`` questions, whose rows are not to replace good ones."""
    found = questions.groupBy("doc_id").agg(F.count("*").alias("found"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(0)).alias("found")).where(F.col("found") < minimum)
