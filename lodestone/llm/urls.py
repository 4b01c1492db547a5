"""URL filters: stated host rules, and association rules that FP-growth mines from labels.

A page is labelled through the document whose number its path names: it is bad if that document is
marked as toxic or of low quality, else good. The URL's parts (host labels, path words, query keys) and
the label form a transaction, in which parts that stand in the very same urls are one item. Spark's
FP-growth finds the frequent combinations of core items, of which no url has more than ``MOST_PARTS``:
an item is late instead if in some url so many others tell more. Combinations with a late item are
found level by level, each from those with one part less, so that every combination of every length is
looked at and none has to be listed that holds a shorter one of the same urls. Those that imply a label
are kept if ``LEAST`` urls show them and the lower end of their confidence (Wilson's interval) is at least ``LIFT`` times that label's share of all labelled urls and the label likelier than not, unless a shorter combination says as
much. So rules exist for whichever label is rarer too, and the same urls give the same rule however
large the table around them is. The kept rules are indexed by their rarest part, joined with the URLs'
parts and verified in full; of the rules that match the one of the greatest lift decides.

A stated rule ``host/path`` fits its host and all subdomains if the path starts with the rule's; the
longest wins and is stronger than what was mined. Without any rule a page is allowed. Null urls, and
urls without ``://``, have an empty host and path and no parts. Verdicts are worked out once for each
distinct url and joined back, so repeated rows get equal results. Empty tables give no rows; only the
id and the url are carried, so other columns can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.licenses import LOWER, UPPER
from lodestone.session import materialize, table

# Stated rules.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: Labelled urls that must show a combination with its label, least confidence, how many times the label's
#: share the lower end of the confidence must be, and the standard deviations of that lower end: so many
#: combinations are tried that fewer would let chance ones pass.
LEAST, CONFIDENCE, LIFT, SURE = 20, 0.5, 1.2, 2.58
#: Items of a labelled url that FP-growth combines (so at most 2^MOST_PARTS a url); combinations with others are found by levels.
MOST_PARTS = 12
BAD, GOOD = "=bad", "=good"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule (of equal length the first in order of text), or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def url_parts(url: Column) -> Column:
    """Distinct parts: host labels but the last as ``h:``, the last as ``t:``, path words as ``p:`` (numbers as ``p:#``), query keys as ``q:``."""
    labels, path = F.filter(F.split(host_of(url), r"\."), lambda x: x != ""), F.lower(path_of(url))
    n = F.size(labels)
    hosts = F.transform(labels, lambda x, i: F.when(i == n - 1, F.concat(F.lit("t:"), x)).otherwise(F.concat(F.lit("h:"), x)))
    words = F.transform(F.filter(F.split(path, r"[/._-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.when(x.rlike(r"^\d+$"), F.lit("#")).otherwise(x)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(hosts, words, keys))).otherwise(F.array().cast("array<string>"))


def lower_end(share: Column, n: Column, sure: float = SURE) -> Column:
    """Lower end of Wilson's interval of a share that n urls show."""
    z2 = sure * sure
    return (share + z2 / (2 * n) - sure * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def _items(each: DataFrame, least: int) -> DataFrame:
    """(item, members, n, b): parts that ``least`` urls of one label have, those of the very same urls (by two hashes of 64 bits) as one, named by the first in order of text."""
    marks = each.groupBy("part").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    marks = marks.where(F.greatest("b", F.col("n") - F.col("b")) >= least)
    return marks.groupBy("n", "b", "x", "y").agg(F.min("part").alias("item"), F.collect_list("part").alias("members")).drop("x", "y")


def _ordered(each: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """(bad, items) with the items of each url, those first whose urls' labels depart most from the common share (in standard deviations), then by text."""
    departs = F.abs(F.col("b") - share * F.col("n")) / F.sqrt(F.col("n") * F.lit(share * (1 - share) + 1e-12))
    told = each.join(items.select(F.col("item").alias("part"), F.struct((-F.round(departs, 9)).alias("d"), F.col("item"), "n").alias("entry")), "part")
    return told.groupBy("row", "bad").agg(F.array_sort(F.collect_list("entry")).alias("items")).select("bad", "items")


def _core_sets(rows: DataFrame, least: int) -> DataFrame:
    """(parts, n, b): by FP-growth the combinations that ``least`` urls of one label show."""
    # the labels must be among the items even where they are rare, so they are mined with them
    rows = materialize(rows.where(F.size("items") > 0).select(F.array_append("items", F.when(F.col("bad"), BAD).otherwise(GOOD)).alias("items")))
    # the support is an absolute count at every size; half a url is taken off against rounding
    shown = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / max(rows.count(), least), minConfidence=1e-9).fit(rows).freqItemsets
    labels = F.array(F.lit(BAD), F.lit(GOOD))
    sets = shown.select(F.array_sort(F.array_except("items", labels)).alias("parts"), F.get(F.array_intersect("items", labels), 0).alias("label"), "freq").where("size(parts) > 0")
    of = lambda label: F.max(F.when(F.col("label") == label, F.col("freq")))
    counts = sets.groupBy("parts").agg(F.max(F.when(F.col("label").isNull(), F.col("freq"))).alias("n"), of(BAD).alias("b"), of(GOOD).alias("g"))
    return counts.select("parts", "n", F.coalesce("b", F.col("n") - F.col("g")).alias("b")).where("b IS NOT NULL")


def _longer(held: DataFrame) -> DataFrame:
    """From (parts, rest, n, b) every combination with one more of the rest: (row, n, b, k, part, parts)."""
    more = held.withColumn("row", F.monotonically_increasing_id()).select("row", "n", "b", "parts", F.posexplode("rest").alias("k", "part"))
    return materialize(more.withColumn("parts", F.array_sort(F.array_append("parts", F.col("part")))))


def _going_on(longer: DataFrame, open_sets: DataFrame) -> DataFrame:
    """(parts, rest, n, b) of the open combinations; the rest are the parts behind the last with which the same start is open too."""
    live = longer.join(open_sets.select("parts"), "parts", "left_semi").groupBy("row", "n", "b").agg(F.array_sort(F.collect_list(F.struct("k", "part", "parts"))).alias("live"))
    each = live.select("n", "b", "live", F.posexplode("live").alias("i", "x"))
    each = each.select("x.parts", F.transform(F.slice("live", F.col("i") + 2, F.size("live")), lambda x: x["part"]).alias("rest"), "n", "b")
    return each.groupBy("parts", "rest").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))


def _judged(sets: DataFrame, shorter: DataFrame | None, shares: dict[str, float], least: int, confidence: float, lift: float, sure: float) -> DataFrame:
    """(parts, n, b) of one length with a struct for each label: confidence, whether it is a rule that no shorter one outdoes, the best confidence so far, whether a longer one may be a rule.

    A combination is left out if a part of it stands in just as many urls (then that part implies
    the label as surely), or if a part of it was left out or can't become a longer rule.
    """
    if shorter is None:
        rows = sets.withColumns({f"top_{y}": F.lit(-1.0) for y in shares})
    else:
        parts = sets.select("parts", "n", "b", F.explode(F.transform("parts", lambda x: F.array_remove("parts", x))).alias("part_of"))
        found = parts.join(shorter.select(F.col("parts").alias("part_of"), F.col("n").alias("more"), *(F.col(y)["top"].alias(y) for y in shares)), "part_of")
        rows = found.groupBy("parts", "n", "b").agg(F.count("*").alias("found"), F.min("more").alias("more"), *(F.max(y).alias(f"top_{y}") for y in shares))
        rows = rows.where((F.col("found") == F.size("parts")) & (F.col("more") > F.col("n"))).drop("found", "more")
    for y, share in shares.items():
        freq = F.col("b") if y == "bad" else F.col("n") - F.col("b")
        sure_of, best = freq / F.col("n"), F.col(f"top_{y}")
        rule = (freq >= least) & (sure_of >= confidence) & (lower_end(sure_of, F.col("n"), sure) >= lift * share)
        top = F.when(rule, F.greatest(best, sure_of)).otherwise(best)
        # a longer combination shows the label at most as often; with that and no exception it would have to be sure enough
        more = (freq >= F.greatest(F.lit(least), F.lit(1))) & (lower_end(F.lit(1.0), F.greatest(freq, F.lit(1)), sure) >= lift * share - 1e-9) & (top < 1)
        rows = rows.withColumn(y, F.struct(freq.alias("freq"), sure_of.alias("confidence"), (rule & (sure_of > best)).alias("rule"), top.alias("top"), more.alias("more")))
    return rows.select("parts", "n", "b", *shares)


def mine_rules(labelled: DataFrame, least: int = LEAST, confidence: float = CONFIDENCE, lift: float = LIFT, sure: float = SURE) -> DataFrame | None:
    """From (parts, bad) the pruned rules (rule_id, label, parts, key, confidence, support, lift); None without enough labels."""
    known = labelled.where("bad IS NOT NULL").select(F.array_distinct("parts").alias("parts"), "bad").where(F.size("parts") > 0)
    keyed = materialize(known.withColumn("row", F.monotonically_increasing_id()))
    n, n_bad = keyed.agg(F.count("*"), F.count_if("bad")).first()
    if n < least:
        return None
    shares = {"bad": n_bad / n, "good": (n - n_bad) / n}
    each = keyed.select("row", "bad", F.explode("parts").alias("part"))
    items = materialize(_items(each, least))
    rows = materialize(_ordered(each, items, shares["bad"]))
    if not rows.limit(1).count():
        return None
    name = lambda x: x["item"]
    late = materialize(rows.select(F.explode(F.slice("items", MOST_PARTS + 1, F.size("items"))).alias("x")).select("x.item").distinct())
    if late.limit(1).count():
        # late items come first, rare ones first of all, so that every combination with one begins with one
        marked = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "bad", F.explode("items").alias("x")).select("row", "bad", "x.item", "x.n")
        marked = marked.join(late.withColumn("late", F.lit(True)), "item", "left").withColumn("late", F.coalesce("late", F.lit(False)))
        rows = materialize(marked.groupBy("row", "bad").agg(F.array_sort(F.collect_list(F.struct((~F.col("late")).alias("core"), "n", "item"))).alias("items")).select("bad", "items"))
        core = rows.select("bad", F.transform(F.filter("items", lambda x: x["core"]), name).alias("items"))
        longer = _longer(rows.groupBy(F.transform("items", name).alias("rest")).agg(F.count("*").alias("n"), F.count_if("bad").alias("b")).withColumn("parts", F.array().cast("array<string>")))
    else:
        core, longer = rows.select("bad", F.transform("items", name).alias("items")), None
    sets, levels, opened = materialize(_core_sets(core, least)), [], None
    while opened is None or opened.limit(1).count():
        found = sets.where(F.size("parts") == len(levels) + 1)
        if longer is not None:
            if opened is not None:
                held = _going_on(longer, opened)
                longer = _longer(held.join(late, F.get("parts", F.lit(0)) == F.col("item"), "left_semi") if len(levels) == 1 else held)
            others = longer if levels else longer.join(late, F.col("part") == F.col("item"), "left_semi")
            found = found.unionByName(others.groupBy("parts").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).where(F.greatest("b", F.col("n") - F.col("b")) >= least))
        levels.append(materialize(_judged(found, opened, shares, least, confidence, lift, sure)))
        opened = levels[-1].where(" OR ".join(f"{y}.more" for y in shares))
    every = reduce(DataFrame.unionByName, levels)
    rules = reduce(DataFrame.unionByName, (every.where(F.col(y)["rule"]).select("parts", F.lit(label).alias("label"), F.col(y)["confidence"].alias("confidence"), (F.col(y)["freq"] / n).alias("support"), (F.col(y)["confidence"] / share).alias("lift")) for (y, share), label in zip(shares.items(), (BAD, GOOD)) if share))
    # each item stands for all its members
    rules = materialize(rules.withColumn("rule", F.monotonically_increasing_id()))
    members = rules.select("rule", F.explode("parts").alias("item")).join(items, "item").groupBy("rule").agg(F.collect_list("members").alias("members"))
    product = F.aggregate("members", F.array(F.array().cast("array<string>")), lambda done, m: F.flatten(F.transform(done, lambda x: F.transform(m, lambda y: F.array_append(x, y)))))
    rules = rules.drop("parts").join(members.select("rule", F.explode(product).alias("parts")), "rule").drop("rule").withColumn("parts", F.array_sort("parts"))
    kept = materialize(rules.withColumn("rule_id", F.concat(F.array_join("parts", " "), F.lit(" "), F.col("label"))))
    counts = items.select(F.explode("members").alias("part"), F.col("n").alias("freq"))
    rarest = kept.select("rule_id", F.explode("parts").alias("part")).join(counts, "part").groupBy("rule_id").agg(F.min(F.struct("freq", "part"))["part"].alias("key"))
    return materialize(kept.join(rarest, "rule_id"))


def match_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, confidence, mined, bad): for each url that a rule matches the one of the greatest lift (then the better supported, then by text)."""
    parts = urls.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).distinct().withColumn("parts", url_parts(F.col("url")))
    looked_up = parts.select("url", "parts", F.explode("parts").alias("key")).join(rules.withColumnRenamed("parts", "needed"), "key")
    full = looked_up.where(F.size(F.array_except("needed", "parts")) == 0)
    best = full.groupBy("url").agg(F.min(F.struct(-F.col("lift"), -F.col("support"), F.col("rule_id"), F.col("label"), F.col("confidence"))).alias("best"))
    return best.select("url", F.col("best.confidence").alias("confidence"), F.col("best.rule_id").alias("mined"), (F.col("best.label") == BAD).alias("bad"))


def filter_urls(pages: DataFrame, rules: dict[str, str], mined: DataFrame | None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, mined, confidence) for every row."""
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    if mined is None:
        rows = rows.withColumns({"confidence": F.lit(None).cast("double"), "mined": F.lit(None).cast("string"), "bad": F.lit(None).cast("boolean")})
    else:
        rows = rows.join(materialize(match_rules(rows, mined)), "url", "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule = stated_rule(F.col("host"), F.col("path"), rules)
    said = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair)) if rules else None
    verdict = F.when(F.col("bad"), "block").otherwise("allow")
    if said is not None:
        verdict = F.coalesce(F.element_at(said, F.col("rule")), verdict)
    rows = rows.withColumns({"host": host, "path": path}).withColumn("rule", rule).withColumn("verdict", verdict)
    return rows.select(id_col, "host", "path", "rule", "verdict", "mined", "confidence")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(parts, bad) of the pages whose path names a labelled document; a document labelled twice is bad if any label says so."""
    bad = labels.groupBy("doc_id").agg(F.bool_or((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    number = F.expr(r"try_cast(regexp_extract(path, '/(\\d+)(?:[./]|$)', 1) AS bigint)")
    rows = pages.select("url", path_of(F.col("url")).alias("path")).select(url_parts(F.col("url")).alias("parts"), number.alias("doc_id"))
    return rows.where("doc_id IS NOT NULL").join(bad, "doc_id").select("parts", "bad")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url: page_id, host, path, rule, verdict, mined, confidence."""
    pages = table(spark, sf_dir, "pages")
    mined = mine_rules(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return filter_urls(pages, RULES, mined)
