"""License scans by a positional rare-token index, in DataFrame functions only.

Method. Each licence notice is a template of words with a mandatory key phrase. One pass counts in
how many documents each licence word stands, which gives the words' IDF; the two words of highest IDF
in a template's key phrase are its anchors, and a positional index maps a word to the (template,
offset) pairs that it anchors. A file looks up the words of highest IDF that it has, so only templates
whose anchors it holds: every place of an anchor says where the template would begin, and the
beginnings by the first anchor are intersected with those by the second. At what is left the key
phrase is verified word by word, and the share of the template's IDF that stands at the right offsets
is its coverage. A beginning is one 64-bit number, so intersections are linear however often a word
recurs.

Words are runs of digits, A-Z/a-z and characters beyond ASCII; A-Z count as a-z. Base phrases are
templates that are all key phrase, so every place of theirs is found. A null or empty text has no
words and no labels. Everything is done row by row, so repeated or very long rows, and groups of
copies, need no shuffle; only the counts of the licence words (a fixed vocabulary) reach the driver.
An empty table gives no rows; columns that aren't named in ``keep`` can't clash, and those that are must not begin with
two underscores.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts such words before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and labels that every scan counts.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# First sentences of public licence notices as (label, notice, mandatory key phrase).
NOTICES = [
    ("agpl", "GNU Affero General Public License", "gnu affero general public license"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    ("boost", "Distributed under the Boost Software License, Version 1.0", "boost software license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("cc0", "CC0 1.0 Universal", "cc0 1 0"),
    ("epl", "made available under the terms of the Eclipse Public License", "eclipse public license"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "you can redistribute it and or modify it"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", "general public license version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and"),
    ("lgpl", "GNU Lesser General Public License", "gnu lesser general public license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("proprietary", "All rights reserved", "all rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "released into the public domain"),
]

#: The coverage from which a template counts.
ACCEPT = 0.5
#: A beginning as one number: template · 2^SHIFT + place + BEFORE (a template may begin before the text does).
SHIFT, BEFORE = 40, 1 << 20


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def templates() -> list[dict]:
    """All templates: label, words, whether it is a base phrase, the key phrase and its offset."""
    out = [{"label": label, "words": words_of(p), "base": True, "key": words_of(p), "key_at": 0} for p, label in BASE.items()]
    for label, notice, key in NOTICES:
        words, phrase = words_of(notice), words_of(key)
        at = next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)
        out.append({"label": label, "words": words, "base": False, "key": phrase, "key_at": at})
    return out


def document_words(text: Column) -> Column:
    """Words in their own case."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN, -1), lambda w: w != "")


def word_idf(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, float]:
    """IDF over all documents of a fixed list of words: at most one row for each word is collected."""
    found = F.array_distinct(F.transform(F.filter(document_words(F.col(text_col)), lambda w: F.lower(w).isin(words)), lambda w: F.translate(w, UPPER, LOWER)))
    row = docs.select(F.explode_outer(found).alias("w")).groupBy("w").count()
    counts = dict(row.where(F.col("w").isin(words)).collect())
    n = docs.count()
    return {w: math.log((n + 2) / (counts.get(w, 0) + 1)) for w in words}


def license_sites(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_words, sites: array<struct<label, base, start, n_words, coverage>> in order of place.

    Only the columns named in ``keep`` are carried, so other columns can't clash.
    """
    all_templates = templates()
    vocabulary = sorted({w for t in all_templates for w in t["words"]})
    idf = word_idf(docs, vocabulary, text_col)
    anchors: tuple[dict[str, list[tuple[int, int]]], ...] = ({}, {})
    for k, t in enumerate(all_templates):
        in_key = range(t["key_at"], t["key_at"] + len(t["key"]))
        rarest = sorted(in_key, key=lambda j: (-idf[t["words"][j]], j))
        for postings, j in zip(anchors, [rarest[0], rarest[min(1, len(rarest) - 1)]], strict=True):
            postings.setdefault(t["words"][j], []).append((k, j))
    notice = F.array(
        *(
            F.struct(
                F.lit(t["label"]).alias("label"), F.lit(t["base"]).alias("base"), F.array(*map(F.lit, t["words"])).alias("words"), F.array(*map(F.lit, t["key"])).alias("key"), F.lit(t["key_at"]).alias("key_at"),
                F.array(*(F.lit(idf[w] / sum(idf[x] for x in t["words"])) for w in t["words"])).alias("share"),
            )
            for t in all_templates
        )
    )
    w = F.col("__words")
    indexed = sorted({word for postings in anchors for word in postings})
    places = F.filter(F.transform(w, lambda x, i: F.when(F.lower(x).isin(indexed), F.struct(F.lower(x).alias("w"), i.alias("i")))), lambda x: x.isNotNull())

    def begins(postings: dict[str, list[tuple[int, int]]]) -> Column:
        index = F.create_map(*(x for word in sorted(postings) for x in (F.lit(word), F.array(*(F.lit((k << SHIFT) + BEFORE - j) for k, j in postings[word])))))
        known = F.filter("__places", lambda x: x["w"].isin(sorted(postings)))
        return F.flatten(F.transform(known, lambda x: F.transform(F.element_at(index, x["w"]), lambda code: code + x["i"])))

    def site(c: Column) -> Column:
        t = F.get(notice, F.shiftright(c, SHIFT).cast("int"))
        s = (c.bitwiseAND(F.lit((1 << SHIFT) - 1)) - BEFORE).cast("int")
        found = lambda j: F.coalesce(F.translate(F.get(w, s + j), UPPER, LOWER), F.lit(""))
        covered = F.aggregate(F.transform(t["words"], lambda x, j: F.when(found(j) == x, F.get(t["share"], j)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
        key = F.forall(F.transform(t["key"], lambda x, j: found(t["key_at"] + j) == x), lambda ok: ok)
        return F.when(key, F.struct(s.cast("long").alias("start"), t["label"].alias("label"), t["base"].alias("base"), F.size(t["words"]).alias("n_words"), F.round(covered, 6).alias("coverage")))

    sites = F.filter(F.transform("__begins", site), lambda s: s.isNotNull() & (s["coverage"] >= ACCEPT))
    rows = docs.select(*keep, document_words(F.col(text_col)).alias("__words")).withColumn("__places", places)
    rows = rows.withColumn("__begins", F.array_intersect(begins(anchors[0]), begins(anchors[1])))
    return rows.select(*keep, F.size("__words").cast("long").alias("n_words"), F.array_sort(sites).alias("sites"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = license_sites(table(spark, sf_dir, "documents"))
    starts = F.transform(F.filter("sites", lambda s: s["base"]), lambda s: s["start"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda s: s["label"]))), ",")
    return rows.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.filter("sites", lambda s: s["base"])).alias("base_labels"), labels(F.col("sites")).alias("labels"),
        F.coalesce(F.array_max(F.transform("sites", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def op1_sql() -> str:
    """The definition without an index: every place of every key phrase, and its coverage."""
    quote = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    values = ",\n  ".join(f"({k}, '{t['label']}', {str(t['base']).lower()}, {quote(t['words'])}, {quote(t['key'])}, {t['key_at']})" for k, t in enumerate(templates()))
    return f"""
WITH t(t, label, base, words, key, key_at) AS (VALUES
  {values}),
d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
n AS (SELECT count(*) AS n FROM d),
tw AS (SELECT t, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS j FROM t),
df AS (SELECT word, count(DISTINCT r) AS df FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY word),
idf AS (SELECT DISTINCT tw.word, ln((n.n + 2) / (coalesce(df.df, 0) + 1.0)) AS idf FROM tw LEFT JOIN df USING (word) CROSS JOIN n),
shares AS (SELECT t, j, tw.word, idf / sum(idf) OVER (PARTITION BY t) AS share FROM tw JOIN idf USING (word)),
places AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
heads AS (SELECT t.*, p.r, p.i - t.key_at AS s FROM places p JOIN t ON p.word = t.key[1]),
sites AS (SELECT h.r, h.t, h.label, h.base, h.s FROM heads h JOIN d USING (r) WHERE d.w[h.s + h.key_at + 1 : h.s + h.key_at + len(h.key)] = h.key),
covered AS (SELECT s.r, s.t, s.label, s.base, s.s, round(sum(CASE WHEN s.s + x.j >= 0 AND d.w[s.s + x.j + 1] = x.word THEN share ELSE 0 END), 6) AS coverage
  FROM sites s JOIN d USING (r) JOIN shares x ON x.t = s.t GROUP BY ALL HAVING coverage >= {ACCEPT})
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(c.s) FILTER (c.base) AS n_base,
  min(c.s) FILTER (c.base) AS first_word, max(c.s) FILTER (c.base) AS last_word,
  coalesce(string_agg(DISTINCT c.label, ',' ORDER BY c.label) FILTER (c.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT c.label, ',' ORDER BY c.label), '') AS labels, coalesce(max(c.coverage), 0.0) AS score
FROM d LEFT JOIN covered c USING (r) GROUP BY d.r, d.doc_id, d.w
"""
