"""Laws and regulations as labelled chunks: headings, articles, paths and parts.

Paragraphs are rows (doc_id, n, p). What belongs to a document is grouped by its id, so no group is
larger than a document's own text; ids are to be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import sub_parts

# The grammar of headings and articles, and small words that a caption can't end with.
SUFFIX = r"(?:\s*-[A-Z]{{1,2}}|\s*(?:{0}))?"
LOWER, UPPER = SUFFIX.format("bis|ter|qu[áa]ter|quinquies|sexies|septies"), SUFFIX.format("BIS|TER|QU[ÁA]TER|QUINQUIES|SEXIES|SEPTIES")
ARTICLE = rf"^(ART[ÍI]CULO\s+\d+{UPPER}|Art[íi]culo\s+\d+{LOWER})[ .°º\-–—]*(?:[.°º\-–—]|$)"
TRANSITORY = r"^(TRANSITORIO\s+[IVXLCDM\d]+(?:\s+(?:BIS|TER))?|Transitorio\s+[IVXLCDM\d]+(?:\s+(?:bis|ter))?)[ .°\-–—]*[.°\-–—]"
INLINE = r"(?:ART[ÍI]CULO|Art[íi]culo)\s+\d+(?:\s*(?:bis|ter|BIS|TER))?\s*[.\-–—°]|(?:TRANSITORIO|Transitorio)\s+[IVXLCDM\d]+\s*[.\-–—°]"
HEADING = r"^(T[ÍI]TULO|T[íi]tulo|CAP[ÍI]TULO|Cap[íi]tulo|SECCI[ÓO]N|Secci[óo]n)\s+(?:[IVXLCDM]+l*|\d+|[ÚU]NIC[OA]|[ÚU]nic[oa])(?:[.\-–—°:\s]+([\s\S]*))?$"
DANGLING = r"(?:^|\s)(?:al?|ambos|ante|bajo|como|con|contra|de|del?|desde|durante|el|en|entre|est[aeo]s?|hacia|hasta|las?|los?|mediante|o|para|por|que|se|según|sin|sobre|sus?|tras|u|una?|y)$|[.,:;]$"
# Formulas that enact, how recitals open, and a sentence of twelve words.
ENACTING = "DECRETA|ACUERDA|RESUELVE|DISPONE|ORDENA|EMITE|ADOPTA"
RECITALS = r"(?:\bConsiderandos?\s*:|\bResultandos?\s*:|\bCon\s+fundamento\s+en\b|\bEn\s+uso\s+de\s+(?:las|sus)\b|\bEn\s+ejercicio\s+de\s+(?:las|sus)\b)"
RECITAL_PROSE = r"(?:\S+\s+){11,}\S*\.(?:\s|$)"
CAPTION_WORDS, CAPITAL_CAPTION_WORDS = 20, 40
LEVELS = ("T", "C", "S")


def article_label(p: Column) -> Column:
    """The label of an article or transitory provision that a paragraph opens, or null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(p, x, 1), F.lit("")) for x in (ARTICLE, TRANSITORY)))


def caption_shaped(caption: Column) -> Column:
    """A short line that begins with a capital and doesn't break off."""
    words = F.size(F.split(caption, r"\s+"))
    fits = F.when(caption.rlike("[a-záéíóúñü]"), (words <= CAPTION_WORDS) & ~caption.rlike(DANGLING)).otherwise(words <= CAPITAL_CAPTION_WORDS)
    return caption.rlike("^[A-ZÁÉÍÓÚÑÜ]") & fits


def heading_level(p: Column) -> Column:
    """0 for a title, 1 for a chapter, 2 for a section, null for what is no heading line.

    Behind word and ordinal stands nothing or a caption: a short line that begins with a capital and doesn't break off.
    """
    caption = F.trim(F.regexp_extract(p, HEADING, 2))
    sound = p.rlike(HEADING) & ((caption == "") | caption_shaped(caption))
    return F.when(sound, F.instr(F.lit("".join(LEVELS)), F.upper(F.substring(p, 1, 1))) - 1)


def split_inline(p: Column) -> Column:
    """A paragraph cut before each article that begins within it."""
    return F.filter(F.transform(F.split(p, rf"(?<!^)(?={INLINE})"), lambda x: F.trim(x)), lambda x: x != "")


def _placed(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs with ``level`` and ``label`` of what they open, ``chunk`` (boundaries so far) and ``edges`` (of the document)."""
    rows = paragraphs.withColumns({"level": heading_level(F.col("p")), "label": article_label(F.col("p"))}).withColumn("edge", F.col("level").isNotNull() | F.col("label").isNotNull())
    so_far = Window.partitionBy("doc_id").orderBy("n")
    return rows.withColumns({"chunk": F.sum(F.col("edge").cast("int")).over(so_far), "edges": F.sum(F.col("edge").cast("int")).over(Window.partitionBy("doc_id"))})


def preambles(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, body): the recitals before a document's first boundary, up to the last enacting formula.

    They begin at their opening words; front matter without any that has no long sentence is a title block and
    gives none. Documents without a boundary have no front matter.
    """
    front = _placed(paragraphs).where("chunk = 0 AND edges > 0").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]), " ").alias("front"))
    enacted = rf"(?is)^(.*)\b(?:{ENACTING})N?\s*:"
    recitals = F.when(F.col("front").rlike(enacted), F.regexp_extract("front", enacted, 1)).otherwise(F.col("front"))
    rows = front.select("doc_id", recitals.alias("r")).withColumn("at", F.regexp_instr("r", F.lit(f"(?i){RECITALS}")))
    body = F.trim(F.when(F.col("at") > 0, F.substring(F.col("r"), F.col("at"), F.length("r"))).when(F.col("r").rlike(RECITAL_PROSE), F.col("r")))
    return rows.select("doc_id", body.alias("body")).where("body <> ''")


def structural_chunks(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, chunk, label, path, body): what stands between two boundaries, headings left out.

    What stands before the first boundary is front matter and goes (see ``preambles``), unless the document has no boundary.
    ``path`` lists the headings in effect, each ended by one of its own or a higher level.
    """
    so_far = Window.partitionBy("doc_id").orderBy("n")
    opened = {f"h{k}": F.last(F.when(F.col("level") == k, F.struct("n", "p")), ignorenulls=True).over(so_far) for k in range(len(LEVELS))}
    placed = _placed(paragraphs).withColumns(opened)
    # a heading is in effect while no higher one came after it
    after = lambda k, *of: F.greatest(F.lit(-1), *(F.coalesce(F.col(f"h{x}.n"), F.lit(-1)) for x in of))
    path = F.array_compact(F.array(F.col("h0.p"), F.when(F.col("h1.n") > after(1, 0), F.col("h1.p")), F.when(F.col("h2.n") > after(2, 0, 1), F.col("h2.p"))))
    inside = placed.withColumn("path", path).where("level IS NULL AND (chunk > 0 OR edges = 0)")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]), " ")
    return inside.groupBy("doc_id", "chunk").agg(F.max("label").alias("label"), F.any_value("path").alias("path"), body.alias("body"))


def labelled_parts(chunks: DataFrame, title: Column) -> DataFrame:
    """(doc_id, chunk, label, path, part, content): bodies in parts of bounded length behind ``[title — path — label]``."""
    header = F.concat(F.lit("["), F.concat_ws(" — ", title, F.col("path"), F.col("label")), F.lit("] "))
    rows = chunks.where(F.trim("body") != "").withColumn("header", header)
    parts = rows.select("doc_id", "chunk", "label", "path", "header", F.explode(sub_parts(F.split("body", " ", -1))).alias("x"))
    return parts.select("doc_id", "chunk", "label", "path", F.col("x.part").alias("part"), F.concat("header", F.array_join("x.words", " ")).alias("content"))


def carries_content(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, parts, problem): ``no_chunks``, ``only_headers`` or null for each document."""
    found = parts.groupBy("doc_id").agg(F.count("*").alias("parts"), F.bool_or(F.trim(F.regexp_replace("content", r"^\[[^\]]*\]\s*", "")) != "").alias("carries"))
    problem = F.when(F.col("parts").isNull(), "no_chunks").when(~F.col("carries"), "only_headers")
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("parts", F.lit(0)).alias("parts"), problem.alias("problem"))
