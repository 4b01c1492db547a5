"""What is appended to an answer set (query_id, id, pos) after the cut, for all queries at once.

Every function groups and joins by query, so a set's few dozen rows are the largest group. A pool is
(query_id, id, rank, doc_key); an id stands once in a query's pool, and the cut's rows stand in it.
"""

from __future__ import annotations

import ast
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.search import ranked

#: Kinds of pins in the order in which they are appended.
KINDS = ("crossReference", "derivedInput", "salarioBase", "namedSource")
#: References that are looked up, and chunks that they and named sources may add.
LOOKED_UP, REFERENCE_CAP, NAMED_CAP = 12, 1, 1

# Words before a reference that say that it defers a figure.
FIGURE_WORDS = ("tarifa", "tarifas", "tasa", "tasas", "porcentaje", "porcentajes", "monto", "montos", "cuota", "cuotas", "escala", "tramo", "tramos", "base imponible", "base minima")
# Ordinals that number an article, and suffixes of a number.
ORDINALS = {"primero": 1, "segundo": 2, "tercero": 3, "cuarto": 4, "quinto": 5, "sexto": 6, "septimo": 7, "setimo": 7, "octavo": 8, "noveno": 9, "decimo": 10}
SUFFIXES = ("bis", "ter", "quater", "quinquies")
# Words that open a subdivision of an article.
SUBDIVISIONS = ("ambos", "inciso", "incisos", "apartado", "apartados", "aparte", "denominado", "parrafo", "parrafos", "numeral", "numerales", "subinciso", "subincisos", "literal")
# What a chunk's own document calls itself, by gender.
OWN_HE, OWN_SHE = ("reglamento", "decreto", "codigo", "titulo", "capitulo"), ("resolucion", "norma")
# Words behind «de la ley» with which no other law's name goes on.
NO_NAME = ("y", "e", "o", "u", "que", "se", "en", "a", "al", "el", "la", "los", "las", "con", "como", "cuando", "segun", "citada", "antes", "mencionada", "indicada", "vigente")
#: Characters before a mention in which such words count, and how far they may stand from it.
CLAUSE, NEAR = 120, 80
#: What cuts the text before each mention.
CUT = "\u0001"
_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}


def append_kinds(cut: DataFrame, pins: DataFrame) -> DataFrame:
    """The cut and behind it the pins (query_id, id, kind, pos) by kind and place; an id goes in once, under its first kind."""
    order = reduce(lambda c, k: c.when(F.col("kind") == KINDS[k], k), range(1, len(KINDS)), F.when(F.col("kind") == KINDS[0], 0))
    fresh = pins.join(cut, ["query_id", "id"], "left_anti").groupBy("query_id", "id").agg(F.min(F.struct(order.alias("o"), "pos", "kind")).alias("at"))
    fresh = ranked(fresh, [F.col("at.o"), F.col("at.pos"), F.col("id")], ["query_id"], "n", None)
    last = cut.groupBy("query_id").agg(F.max("pos").alias("last"))
    added = fresh.join(last, "query_id", "left").select("query_id", "id", (F.coalesce("last", F.lit(0)) + F.col("n")).alias("pos"), F.col("at.kind").alias("pin"))
    return cut.select("query_id", "id", "pos", F.lit(None).cast("string").alias("pin")).unionByName(added)


def _either(words) -> str:
    return "(?:" + "|".join(words) + ")"


def _mention() -> tuple[str, str]:
    """Patterns of one numbered article, and of a list of them behind «artículo(s)», in folded text."""
    one = rf"(?:\d+(?: ?\.?[°º])?|{_either(ORDINALS)}\b)(?: {_either(SUFFIXES)}\b)?"
    return one, rf"articulos? {one}(?:(?: ?, ?(?:[ye] )?| [ye] ){one})*"


ONE, MENTION = _mention()


def _target(tail: Column) -> Column:
    """Whose article a mention names, from the text behind it: ``own`` document, ``law`` (the document's, or the one that it regulates), or null.

    Of the regulated law ``law_title`` (folded) and ``law_number`` are looked at; without one ``regulates`` is null.
    """
    subdivision = rf",? ?{_either(SUBDIVISIONS)}\b(?:[^.;:]|\.(?=\d)){{0,{NEAR}}}?(?= del? )"
    mark = r" ?\(\*+\)"
    behind = F.regexp_replace(tail, rf"^(?:{subdivision}|{mark})+", "")
    rest = F.regexp_replace(behind, r"^,? ?", "")
    named = F.substring(rest, len("de la ") + 1, 1 << 30)
    number = F.regexp_extract(named, r"^ley (?:(?:n|no|nro|numero)\.? ?[°º]?\.? ?)?(\d+)", 1)
    # the law's defined term, and no longer name
    term = rest.rlike(rf"^de la ley(?:$|[^\p{{L}}\d ]| {_either(NO_NAME)}\b)")
    regulated = F.when(F.coalesce(F.startswith(named, F.col("law_title")), F.lit(False)), "law").when(number != "", F.when(number == F.col("law_number"), "law")).when(term, "law")
    return (
        F.when(behind.rlike(r"^\.?[-—–]"), None)
        .when(rest.rlike(r"^al? (?:actual )?\d"), None)
        .when(rest.rlike(r"^de (?:esta|la presente) ley\b"), "law")
        .when(rest.rlike(rf"^(?:de este|del presente) {_either(OWN_HE)}\b") | rest.rlike(rf"^de (?:esta|la presente) {_either(OWN_SHE)}\b"), "own")
        .when(F.col("regulates").isNotNull() & rest.rlike(r"^de la ley\b"), regulated)
        .when(rest.rlike(r"^del? "), None)
        .otherwise("own")
    )


def article_references(chunks: DataFrame, laws: DataFrame | None = None) -> DataFrame:
    """(id, doc_key, article, figure, pos): articles of its document, or of the law that this regulates, that a chunk names; its own isn't one.

    chunks: (id, doc_key, article, part, label, text); laws: (doc_key, regulates, title, norma), the law that a
    document regulates with that law's title and norm, one row for each document. A list names each of its
    articles; a subdivision or an editorial mark before the instrument is passed over. Another instrument, a
    range, a heading carried over by a dash, the heading that opens a first part, and preambles name none.
    ``figure``: words for an amount stand before the mention in its clause. ``pos`` numbers a chunk's references.
    """
    stem = T.fold(F.regexp_replace("title", r"\s*\(.*$", ""))
    none = F.lit(None).cast("string")
    linked = chunks.select("id", "doc_key", "article", "part", "label", "text")
    if laws is None:
        linked = linked.withColumns({"regulates": none, "law_title": none, "law_number": none})
    else:
        number = F.nullif(F.regexp_extract("norma", r"^Ley (\d+)$", 1), F.lit(""))
        linked = linked.join(laws.select("doc_key", "regulates", stem.alias("law_title"), number.alias("law_number")), "doc_key", "left")
    linked = linked.where(F.col("text").isNotNull() & ~F.coalesce(T.fold(F.col("label")).startswith("preambulo"), F.lit(False)))
    # the header «[title — path — article]» repeats the chunk's own label
    body = T.fold(F.regexp_replace("text", r"^\[[^\]]*\]\s*", ""))
    linked = linked.withColumn("parts", F.split(F.regexp_replace(body, rf"\b({MENTION})", f"{CUT}$1"), CUT))
    # each of the parts before holds a mention of ten characters at least
    clause = lambda i: F.right(F.array_join(F.slice("parts", F.greatest(F.lit(1), i - CLAUSE // 10), F.least(i, F.lit(CLAUSE // 10 + 1))), ""), F.lit(CLAUSE))
    words = rf"\b{_either(FIGURE_WORDS)}\b[^.;:]{{0,{NEAR}}}$"
    one = lambda i: F.struct(F.get("parts", i).alias("clause"), clause(i).rlike(words).alias("figure"), i.alias("n"))
    opens = (F.get("parts", 0) == "") & (F.coalesce("part", F.lit(0)) == 0)
    mentions = F.filter(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), one), lambda m: ~(opens & (m["n"] == 1)))
    found = linked.where("size(parts) > 1").select("id", "doc_key", "regulates", "law_title", "law_number", F.col("article").alias("own"), F.inline(mentions))
    found = found.withColumn("target", _target(F.regexp_replace("clause", f"^{MENTION}", ""))).where("target IS NOT NULL")
    listed = F.regexp_extract_all(F.regexp_extract("clause", f"^{MENTION}", 0), F.lit(ONE), F.lit(0))
    named = found.select("id", "own", F.col("doc_key").alias("from"), F.when(F.col("target") == "law", F.coalesce("regulates", "doc_key")).otherwise(F.col("doc_key")).alias("doc_key"), "figure", "n", F.posexplode(listed).alias("k", "item"))
    ordinal = F.create_map(*(F.lit(x) for pair in ORDINALS.items() for x in (pair[0], str(pair[1]))))
    digits, suffix = F.regexp_extract("item", r"^\d+", 0), F.regexp_extract("item", rf" ({_either(SUFFIXES)})$", 1)
    plain = F.when(digits != "", F.regexp_replace(digits, r"^0+(?=\d)", "")).otherwise(F.element_at(ordinal, F.split("item", " ")[0]))
    named = named.withColumn("article", F.trim(F.concat(plain, F.lit(" "), F.upper(suffix)))).where(~(F.col("doc_key").eqNullSafe(F.col("from")) & F.col("own").eqNullSafe(F.col("article"))))
    each = named.groupBy("id", "doc_key", "article").agg(F.bool_or("figure").alias("figure"), F.min(F.struct("n", "k")).alias("at"))
    return ranked(each, [F.col("at"), F.col("doc_key"), F.col("article")], ["id"], "pos", None).drop("at")


def referenced(cut: DataFrame, chunks: DataFrame, references: DataFrame) -> DataFrame:
    """(query_id, id, pos): the article that a set refers to and lacks, figures first, if just one chunk (part 0, not withheld) is it."""
    held = cut.join(chunks.select("id", "doc_key", "article"), "id").select("query_id", "doc_key", "article").where("article IS NOT NULL").distinct()
    wanted = cut.join(references.withColumnRenamed("pos", "place"), "id").join(held, ["query_id", "doc_key", "article"], "left_anti")
    wanted = wanted.groupBy("query_id", "doc_key", "article").agg(F.bool_or("figure").alias("figure"), F.min(F.struct("pos", "place")).alias("at"))
    tried = ranked(wanted, [F.desc("figure"), F.col("at"), F.col("article")], ["query_id"], "n", LOOKED_UP)
    # of all chunks one row for each article that stands once
    single = chunks.where("part = 0 AND article IS NOT NULL").groupBy("doc_key", "article").agg(F.count("*").alias("c"), F.min("id").alias("id"), F.bool_or("withheld").alias("withheld")).where("c = 1 AND NOT withheld")
    found = tried.join(single, ["doc_key", "article"]).select("query_id", "id", "n")
    return ranked(found, [F.col("n")], ["query_id"], "pos", REFERENCE_CAP).select("query_id", "id", "pos")


def derived_inputs(cut: DataFrame, pool: DataFrame, inputs: DataFrame) -> DataFrame:
    """(query_id, id, pos): what figures lack, where the cut holds an input of the figure or its kin and the pool all that is missing.

    inputs: (figure, kin, input, doc_key), a few rows for each figure; figures of one ``kin`` make each other eligible.
    """
    kin = F.coalesce(F.col("kin"), F.concat(F.lit("figure "), F.col("figure").cast("string")))
    inputs = inputs.withColumn("kin", kin)
    has = cut.join(pool.select("query_id", "id", "doc_key"), ["query_id", "id"]).select("query_id", "doc_key").distinct()
    reached = has.join(inputs.select("doc_key", "kin").distinct(), "doc_key").select("query_id", "kin").distinct()
    first = pool.groupBy("query_id", "doc_key").agg(F.min_by("id", "rank").alias("id"))
    asked = reached.join(inputs, "kin").join(has.withColumn("held", F.lit(True)), ["query_id", "doc_key"], "left").join(first, ["query_id", "doc_key"], "left")
    missing = F.collect_list(F.when(F.col("held").isNull(), F.struct(F.col("input").alias("pos"), "id")))
    whole = asked.groupBy("query_id", "figure").agg(missing.alias("missing"), F.bool_and(F.col("held").isNotNull() | F.col("id").isNotNull()).alias("whole")).where("whole")
    added = whole.select("query_id", "figure", F.inline("missing"))
    first = added.groupBy("query_id", "id").agg(F.min(F.struct("figure", "pos")).alias("at"))
    return ranked(first, [F.col("at"), F.col("id")], ["query_id"], "pos", None).drop("at")


def resolved_figures(answer_set: DataFrame, inputs: DataFrame) -> DataFrame:
    """(query_id, figure, markers, values): figures all of whose inputs (figure, input, name, value, doc_key) the set (query_id, pos, doc_key) states."""
    wanted = inputs.groupBy("figure").agg(F.count("*").alias("n"))
    at = answer_set.join(inputs, "doc_key").groupBy("query_id", "figure", "input").agg(F.min("pos").alias("pos"), F.any_value(F.struct("name", "value")).alias("v"))
    found = at.groupBy("query_id", "figure").agg(F.count("*").alias("c"), F.array_sort(F.collect_set("pos")).alias("markers"), F.map_from_entries(F.collect_list("v")).alias("values"))
    return found.join(wanted, "figure").where("c = n").select("query_id", "figure", "markers", "values")


def formula(said: str, names: set[str], values: str = "values") -> Column:
    """A formula of + - * / and named inputs as a Column over a map of values; anything else is an error."""

    def build(x: ast.AST) -> Column:
        match x:
            case ast.BinOp(left, op, right) if type(op) in _OPERATORS:
                return _OPERATORS[type(op)](build(left), build(right))
            case ast.UnaryOp(ast.USub(), of):
                return -build(of)
            case ast.Constant(int() | float() as v) if not isinstance(v, bool):
                return F.lit(float(v))
            case ast.Name(name) if name in names:
                return F.element_at(values, name)
        raise ValueError(f"not a formula of {sorted(names)}: {said}")

    return build(ast.parse(said, mode="eval").body)


def series_pin(cut: DataFrame, pool: DataFrame, series: DataFrame) -> DataFrame:
    """(query_id, outcome, id): a chunk of a series for sets that call for it and hold none.

    cut: (query_id, id, triggers, in_series); pool: (query_id, id, rank, servable); series: the servable
    chunks (id, effective) of the whole corpus, the newest of which is taken where the pool has none.
    """
    state = cut.groupBy("query_id").agg(F.bool_or("triggers").alias("t"), F.bool_or("in_series").alias("s"))
    first = pool.where("servable").groupBy("query_id").agg(F.min_by("id", "rank").alias("pooled"))
    newest = series.agg(F.max_by("id", F.struct("effective", -F.col("id"))).alias("newest"))  # one row
    rows = state.join(first, "query_id", "left").join(F.broadcast(newest))
    found = F.coalesce("pooled", "newest")
    outcome = F.when(~F.coalesce("t", F.lit(False)), "not_triggered").when(F.col("s"), "already_in_set").when(found.isNull(), "missing").otherwise("appended")
    return rows.select("query_id", outcome.alias("outcome"), F.when(outcome == "appended", found).alias("id"))


def named_sources(cut: DataFrame, pool: DataFrame, named: DataFrame) -> DataFrame:
    """(query_id, id, pos): the best pooled chunk of the first named document (query_id, doc_key, place) that the set lacks and the pool has."""
    has = cut.join(pool.select("query_id", "id", "doc_key"), ["query_id", "id"]).select("query_id", "doc_key").distinct()
    wanted = named.join(has, ["query_id", "doc_key"], "left_anti").join(pool, ["query_id", "doc_key"])
    best = wanted.groupBy("query_id", "doc_key").agg(F.min("place").alias("place"), F.min_by("id", "rank").alias("id"))
    return ranked(best, [F.col("place"), F.col("id")], ["query_id"], "pos", NAMED_CAP).select("query_id", "id", "pos")
