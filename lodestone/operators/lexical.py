"""Lexical search over stored postings: a small query syntax, strict or any-word matching, cover density.

``postings`` counts a document's words within its row, so nothing is shuffled to make them: a row for each
document and lexeme with the sorted places. They are made once for all the queries that will be asked.
Queries are parsed by expressions into units: alternatives (``or``), words, phrases in quotes and what a
leading minus excludes. A query matches strictly where some document satisfies it; where none does, any
of its words counts, and a document covers the share of the query's lexemes that it holds.

Rows are ranked by cover density: every shortest stretch of a document that satisfies the query counts
0.1, divided by one more than the words between those that matched. For any-word queries each occurrence
is such a stretch. Scores go by 9 places, ties by the smaller id.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import analysis
from lodestone.operators.search import LEG_LIMIT, ranked

#: Words of queries that are handed to the tasks that read the corpus; with more the postings are joined with them.
VOCABULARY = 200_000
#: Postings that a task puts out at once.
AT_ONCE = 8192
#: What a shortest stretch without other words counts.
COVER = 0.1


def postings(chunks: DataFrame, analyzer: str = "simple", asked: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """(id, lexeme, places): ascending places of each lexeme of a document; with ``asked`` (lexeme) of those lexemes only."""
    words, many = None, False
    if asked is not None:
        asked = asked.select("lexeme").distinct()
        found = asked.limit(VOCABULARY + 1).collect()
        many = len(found) > VOCABULARY
        words = None if many else frozenset(r.lexeme for r in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.int64(), pa.string(), pa.list_(pa.int32())
        for batch in batches:
            held: tuple[list, list, list] = ([], [], [])
            out = lambda batch=batch, held=held: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held[0], kinds[0])), pa.array(held[1], kinds[1]), pa.array(held[2], kinds[2])], ["id", "lexeme", "places"])
            for row, text in enumerate(batch.column(1)):
                places: dict[str, list[int]] = {}
                for k, lexeme in enumerate(analysis.lexemes(text.as_py(), analyzer)):
                    if lexeme is not None and (words is None or lexeme in words):
                        places.setdefault(lexeme, []).append(k)
                for column, found in zip(held, ([row] * len(places), places, places.values()), strict=True):
                    column.extend(found)
                if len(held[0]) >= AT_ONCE:
                    yield out()
                    for column in held:
                        column.clear()
            if held[0]:
                yield out()

    rows = chunks.select("id", F.col(text_col).cast("string"))
    out = rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, lexeme string, places array<int>")
    return out.join(asked, "lexeme", "left_semi").select("id", "lexeme", "places") if many else out


def parse_queries(queries: DataFrame, analyzer: str = "simple", text_col: str = "text") -> DataFrame:
    """(query_id, plain, lexemes, units): units are array<struct<branch, unit, negated, words: array<struct<lexeme, offset>>>>.

    Words side by side are all wanted, ``or`` parts alternatives (it binds less), quotes make a phrase and a
    minus excludes. A word of several lexemes is a phrase. Stop words ask for nothing. ``plain`` queries
    have one branch of single words. ``lexemes`` are all distinct ones of the text, excluded
    words and operators included, of which a row covers a share where nothing matches strictly.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    terms = F.regexp_extract_all(text, F.lit(r'-?"[^"]*"|[^\s"]+'), F.lit(0))
    rows = queries.select("query_id", text.alias("text"), F.posexplode_outer(terms).alias("k", "term"))
    is_or = F.coalesce(F.lower("term") == "or", F.lit(False))
    by_query = Window.partitionBy("query_id").orderBy("k")
    # a leading or a trailing "or" parts nothing from nothing
    rows = rows.withColumn("branch", F.sum(is_or.cast("int")).over(by_query)).withColumn("operator", is_or)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lexeme", pa.string()), ("offset", pa.int32())]))
        for batch in batches:
            names = batch.schema.names
            found = [[{"lexeme": w, "offset": k} for k, w in enumerate(analysis.lexemes(t, analyzer)) if w is not None] for t in batch.column(names.index("term")).to_pylist()]
            for words in found:
                first = words[0]["offset"] if words else 0
                for w in words:
                    w["offset"] -= first
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*names, "words"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", words array<struct<lexeme:string,offset:int>>"
    rows = rows.mapInArrow(run, schema)
    # a minus excludes; within a word it parts two words
    unit = F.struct("branch", F.col("k").alias("unit"), F.col("term").startswith("-").alias("negated"), "words")
    units = F.array_sort(F.collect_list(F.when(~F.col("operator") & (F.size("words") > 0), unit)))
    all_words = F.array_distinct(F.flatten(F.collect_list(F.transform("words", lambda w: w["lexeme"]))))
    parsed = rows.groupBy("query_id").agg(units.alias("units"), all_words.alias("lexemes"), F.bool_or("operator").alias("parted"))
    plain = ~F.col("parted") & F.forall("units", lambda u: ~u["negated"] & (F.size(u["words"]) == 1))
    return parsed.select("query_id", plain.alias("plain"), F.array_sort("lexemes").alias("lexemes"), "units")


def cover_density(places: dict[int, list[tuple[int, int]]], branches: list[list[int]]) -> float:
    """Over places (first and last word) of units: the sum over all shortest stretches that hold all units of some branch."""
    entries = sorted((end, begin, unit) for unit, found in places.items() for begin, end in found)
    words = sorted({k for end, begin, _ in entries for k in range(begin, end + 1)})
    last: dict[int, int] = {}
    before, total = -1, 0.0
    for end, here in groupby(entries, key=lambda e: e[0]):
        last.update((unit, begin) for _, begin, unit in here)
        left = max((min(last[u] for u in b) for b in branches if all(u in last for u in b)), default=-1)
        if left > before:
            matched = bisect_right(words, end) - bisect_left(words, left)
            total, before = total + COVER / (2 + end - left - matched), left
    return total


def _unit_places(words: list[dict], places: dict[str, list[int]]) -> list[tuple[int, int]]:
    """Where a word or phrase stands: first and last word."""
    if any(w["lexeme"] not in places for w in words):
        return []
    found = set(places[words[0]["lexeme"]])
    for w in words[1:]:
        found &= {k - w["offset"] for k in places[w["lexeme"]]}
    return [(k, k + words[-1]["offset"]) for k in sorted(found)]


def _strict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of candidate rows (query_id, id, units, found) those that satisfy the query, with their cover density."""
    for batch in batches:
        kept, scores = [], []
        for row, (units, found) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            places = {f["lexeme"]: f["places"] for f in found}
            at = {u["unit"]: _unit_places(u["words"], places) for u in units}
            branches: dict[int, list[int]] = {}
            for u in units:
                branches.setdefault(u["branch"], [])
                if not u["negated"]:
                    branches[u["branch"]].append(u["unit"])
            barred = {u["branch"] for u in units if u["negated"] and at[u["unit"]]}
            whole = [b for k, b in branches.items() if b and k not in barred and all(at[u] for u in b)]
            if whole:
                wanted = {u for b in whole for u in b}
                kept.append(row)
                scores.append(cover_density({u: at[u] for u in wanted}, whole))
        rows = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(scores, pa.float64())], ["query_id", "id", "rank_cd"])


def lexical_matches(parsed: DataFrame, posted: DataFrame) -> DataFrame:
    """(query_id, id, coverage, rank_cd, is_fallback): rows that match strictly, or for queries without any such row those that hold some word.

    ``posted`` is read twice: for how many lexemes a row holds, and for the places of the rows that may
    match strictly. A query's words are few, so they are joined to the postings where these lie.
    """
    asked = parsed.select("query_id", "plain", F.size("lexemes").alias("total"), F.explode("lexemes").alias("lexeme"))
    hits = posted.select("id", "lexeme", F.size("places").alias("tf")).join(asked, "lexeme")
    held = hits.groupBy("query_id", "id").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf"), F.first("total").alias("total"), F.first("plain").alias("plain"))
    # a plain query wants all its words; of another, rows that hold all words of some branch may satisfy it
    needed = parsed.where("NOT plain").select("query_id", F.explode(F.filter("units", lambda u: ~u["negated"])).alias("u")).select("query_id", "u.branch", F.explode("u.words.lexeme").alias("lexeme")).distinct()
    sized = needed.join(needed.groupBy("query_id", "branch").agg(F.count("*").alias("n")), ["query_id", "branch"])
    of_branch = posted.select("id", "lexeme").join(sized, "lexeme").groupBy("query_id", "branch", "id").agg((F.count("*") == F.first("n")).alias("whole"))
    maybe = held.where("plain AND matched = total").select("query_id", "id").union(of_branch.where("whole").select("query_id", "id").distinct())
    words = parsed.select("query_id", "units", F.explode("lexemes").alias("lexeme"))
    candidates = maybe.join(words, "query_id").join(posted, ["id", "lexeme"], "left")
    candidates = candidates.groupBy("query_id", "id").agg(F.first("units").alias("units"), F.collect_list(F.when(F.col("places").isNotNull(), F.struct("lexeme", "places"))).alias("found"))
    kinds = f"query_id {parsed.schema['query_id'].dataType.simpleString()}, id {posted.schema['id'].dataType.simpleString()}"
    strict = candidates.select("query_id", "id", "units", "found").mapInArrow(_strict, f"{kinds}, rank_cd double")
    some = strict.select("query_id").distinct()
    loose = held.join(some, "query_id", "left_anti").select("query_id", "id", (F.col("matched") / F.col("total")).alias("coverage"), (F.col("tf") * COVER).alias("rank_cd"), F.lit(True).alias("is_fallback"))
    return strict.select("query_id", "id", F.lit(1.0).alias("coverage"), "rank_cd", F.lit(False).alias("is_fallback")).union(loose).withColumn("rank_cd", F.round("rank_cd", 9))


def lexical_leg(parsed: DataFrame, posted: DataFrame, limit: int = LEG_LIMIT) -> DataFrame:
    """(query_id, id, coverage, rank_cd, is_fallback, rank): by cover density, then id."""
    return ranked(lexical_matches(parsed, posted), [F.desc("rank_cd"), F.col("id")], ["query_id"], limit=limit)


def step_lexical_leg(each: DataFrame, sentences: DataFrame, limit: int = LEG_LIMIT) -> DataFrame:
    """One leg of several sentences: ``each`` is their own leg by sentence, ``sentences`` (query_id, of) names the query ``of`` a sentence.

    A row takes the best of its numbers in the sentences' legs (then the denser), with that sentence's coverage.
    """
    rows = each.join(sentences, "query_id")
    best = rows.groupBy("of", "id").agg(F.min(F.struct("rank", (-F.col("rank_cd")).alias("r"), (-F.col("coverage")).alias("c"))).alias("best"))
    best = best.select(F.col("of").alias("query_id"), "id", F.col("best.rank").alias("sentence_rank"), (-F.col("best.c")).alias("coverage"), (-F.col("best.r")).alias("rank_cd"))
    return ranked(best, [F.col("sentence_rank"), F.desc("rank_cd"), F.col("id")], ["query_id"], limit=limit)


def strict_sentences(parsed: DataFrame, posted: DataFrame, top: int = 3) -> DataFrame:
    """For every query sentence whether some row satisfies it, and its ``top`` rows: (query_id, strict, rank, id, coverage); one row of nulls for a sentence without any."""
    leg = lexical_leg(parsed, posted, top).select("query_id", (~F.col("is_fallback")).alias("s"), "rank", "id", F.round("coverage", 2).alias("coverage"))
    return parsed.select("query_id").join(leg, "query_id", "left").select("query_id", F.coalesce("s", F.lit(False)).alias("strict"), "rank", "id", "coverage")
