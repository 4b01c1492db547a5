"""Answers: markers against sources, ordinals of citations, keyword classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def invariant(numbers: Column, n_sources: Column) -> Column:
    """struct<kind, unresolved>: ``no_markers`` if none resolves, ``unresolved`` with the others (each once, in order), or ``ok``."""
    resolves = lambda n: (n >= 1) & (n <= n_sources)
    lost = F.array_distinct(F.filter(numbers, lambda n: ~resolves(n)))
    kind = F.when(~F.exists(numbers, resolves), "no_markers").when(F.size(lost) > 0, "unresolved").otherwise("ok")
    return F.struct(kind.alias("kind"), lost.alias("unresolved"))


def ordinals(answers: DataFrame, sources: DataFrame, key: list[str], numbers: str) -> DataFrame:
    """(key, identity, ordinal) of the identities that an answer cites, numbered by first use.

    ``sources`` has the key, ``number`` and ``identity``; sources of the same identity share an ordinal.
    """
    used = answers.select(*key, F.posexplode(numbers).alias("pos", "number")).join(sources, [*key, "number"])
    first = used.groupBy(*key, "identity").agg(F.min("pos").alias("pos"))
    return first.select(*key, "identity", F.row_number().over(Window.partitionBy(*key).orderBy("pos")).alias("ordinal"))


def classify(folded: Column, classes: dict[str, list[str]], first_wins: bool) -> Column:
    """The class with the most keywords in a folded text; of equals the first, or the last. Null without any hit."""
    names = list(classes) if first_wins else list(reversed(classes))
    hits = T.keyword_counts(folded, [classes[n] for n in names])
    best = F.array_max(hits)
    return F.when(best > 0, F.element_at(F.array(*map(F.lit, names)), F.array_position(hits, best).cast("int")))


def https_link(link: Column, page: Column) -> Column:
    """An absolute https link; paths are resolved against the page's host; null for other links."""
    host = F.regexp_extract(page, r"^https?://([^/?#]+)", 1)
    return F.when(link.startswith("https://"), link).when(link.rlike("^/[^/]|^/$") & (host != ""), F.concat(F.lit("https://"), host, link))
