"""Prefix trie of conversations: every distinct beginning, who shares it, and what sharing it saves.

Method. A turn is a key of 16 bytes (SHA-256 of role and text, cut), a conversation the string of its turns'
keys. Equal conversations become one sequence with a count; the distinct sequences are sorted over the
cluster, and the longest common prefixes of neighbours form the LCP array. Its Cartesian tree is the
trie: a value's interval ends at the nearest smaller values on either side. Each range partition is a
block whose values are resolved by one pass with a stack no deeper than the longest conversation. A
value whose interval leaves its block begins in the nearest block to the left with a smaller minimum;
only the minima, two integers for each partition, are gathered. Neighbours with equal values are one node,
and the depths between a node and its parent, which the array doesn't name, are expanded.

What a node sums up over its subtree is a sum or a minimum over its interval, so blocks give
partial sums for the open intervals (a row for each block and depth at most) and these are merged by the
block in which they began. With L the code points of a node's last text, the sum of (members - 1)·L over
a subtree is the sum over members of the L on their paths less the sum of L over nodes, both additive.

Turns are ordered by number (null first), then role, then key. Rows without a conversation id belong to no
conversation. A negative number's base is the next hundred towards zero. Repeated rows are turns of their own. Texts and roles that are null count as empty. An empty
table gives no rows, and a table of conversations without any turn can't exist before rebuilding; a rebuilt
one may be turnless and ends at the root. A conversation is one row of 20 bytes a turn. Copies are aggregated
before anything is sorted; the ids that end at a node are joined in runs of ``RUN`` numbers and, where a node
has more than one run, hashed as a stream, so no list of ids is ever whole. Other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import materialize, table

#: Bytes of a turn's key, conversation numbers of a run of ids, and rows that a task puts out at once.
KEY, RUN, ROWS = 16, 256, 8192
# Conversations that share a base, and the turns that may come from it (fewer than MOST).
GROUP, MOST = 100, 6


def _digest(column, size: int = KEY):
    return F.unhex(F.substring(F.sha2(column, 256), 1, 2 * size))


def conversation_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): array<struct<key, points>> in order, the key in hexadecimal digits."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    # only keys are shuffled, never texts
    row = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"), role.alias("role"), key.alias("key"), F.length(text).alias("points"))
    ordered = F.transform(F.array_sort(F.collect_list("row")), lambda x: F.struct(x["key"].alias("key"), x["points"].alias("points")))
    return turns.where("conv_id IS NOT NULL").select("conv_id", row.alias("row")).groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation with the first turns of its base before its own later ones, as many as its number's CRC says."""
    heads = conversations.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST - 1).alias("head"))
    rows = conversations.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": (F.crc32(F.col("conv_id").cast("string")) % MOST).cast("int")})
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    # at most GROUP conversations share a base
    return rows.join(heads, "base", "left").select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's runs, which come one after the other in order."""
    current, state, out = None, None, []
    for batch in batches:
        for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if seq == current:
                state.update(b"," + ids.encode())
            else:
                if state is not None:
                    out.append((current, state.hexdigest()))
                current, state = seq, hashlib.sha256(ids.encode())
        if len(out) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string()))], ["seq", "streamed"])
            out = []
    if state is not None:
        out.append((current, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string()))], ["seq", "streamed"])


def sequences(conversations: DataFrame) -> DataFrame:
    """(seq, key, points, n, least, ends): the distinct sequences, their copies, smallest id and digest of ids."""
    keys = F.unhex(F.array_join(F.transform("turns", lambda x: x["key"]), ""))
    rows = conversations.select("conv_id", keys.alias("key"), F.transform("turns", lambda x: x["points"]).alias("points"))
    rows = rows.withColumns({"seq": _digest(F.col("key")), "run": F.floor(F.col("conv_id") / RUN)})
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    runs = materialize(rows.groupBy("seq", "run").agg(F.any_value("key").alias("key"), F.any_value("points").alias("points"), F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids")))
    whole = materialize(
        runs.groupBy("seq").agg(F.any_value("key").alias("key"), F.any_value("points").alias("points"), F.sum("n").alias("n"), F.min("least").alias("least"), F.count("*").alias("runs"), F.sha2(F.min("ids"), 256).alias("one"))
    )
    several = runs.select("seq", "run", "ids").join(whole.where("runs > 1").select("seq"), "seq", "left_semi")
    streamed = several.repartition("seq").sortWithinPartitions("seq", "run").select("seq", "ids").mapInArrow(_streamed, "seq binary, streamed string")
    return whole.join(streamed, "seq", "left").select("key", "points", "n", "least", F.coalesce("streamed", "one").alias("ends"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common from their beginning."""
    n = min(len(a), len(b)) // KEY
    if a[: n * KEY] == b[: n * KEY]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[: middle * KEY] == b[: middle * KEY] else (low, middle)
    return low


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds block, place and the LCP with the row before (-1 for a block's first)."""
    block, at, before = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
        lcp = [-1 if b is None else common(b, k) for b, k in zip([before, *keys], keys, strict=False)]
        before = keys[-1] if keys else before
        n = len(keys)
        yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array(lcp, pa.int32()), *batch.columns], ["block", "at", "lcp", *batch.schema.names])
        at += n


def block_edges(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(block, LCP of its first row with the row before it, smallest LCP of the block), in order: two numbers for each partition."""
    ends = rows.groupBy("block").agg(F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"), F.min(F.when(F.col("at") > 0, F.col("lcp"))).alias("least"))
    # a row for each partition
    pairs = ends.withColumn("before", F.lag("last").over(Window.orderBy("block")))
    n = F.least(F.length("first"), F.length("before")) / KEY
    turn = lambda c, k: F.substr(c, k * KEY + 1, F.lit(KEY))
    differ = F.filter(F.sequence(F.lit(0), n.cast("int")), lambda k: (k == n.cast("int")) | (turn(F.col("first"), k) != turn(F.col("before"), k)))
    out = pairs.select("block", F.when(F.col("before").isNull(), -1).otherwise(F.get(differ, 0)).alias("edge"), "least").orderBy("block").collect()
    return [(r.block, r.edge, r.edge if r.least is None else min(r.edge, r.least)) for r in out]


NODE = "block int, at long, depth int, open boolean, parent_block int, parent_at long, n_convs long, least long, n_children long, n_leaves long, on_paths long, on_nodes long, ends string"
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
_NAMES = [x.split()[0] for x in NODE.split(", ")]
#: What the stack holds of a node: the row at which it began (None: in an earlier block), its last text's code points, and sums.
_AT, _POINTS, _N, _LEAST, _CHILDREN, _LEAVES, _PATHS, _NODES, _ENDS = range(9)


class _Block:
    """One block's pass over its rows."""

    def __init__(self, block: int, edges: list[tuple[int, int, int]]):
        k = next(k for k, e in enumerate(edges) if e[0] == block)
        self.block, self.edge = block, edges[k][1]
        self.next_edge = edges[k + 1][1] if k + 1 < len(edges) else -1
        # the nearest block to the left whose minimum is smaller than the depth
        self.owners: list[int] = []
        for depth in range(self.edge + 1):
            self.owners.append(next(b for b, _, least in reversed(edges[:k]) if least < depth))
        self.stack: list[list] = []
        self.ends_at = -1

    def add(self, at: int, lcp: int, depth: int, points: list[int], n: int, least: int, ends: str) -> Iterator[tuple]:
        if at == 0:
            lcp = self.edge
            for d in range(lcp + 1):
                self.stack.append([None, points[d - 1] if d else 0, 0, None, 0, 0, 0, 0, None])
        else:
            yield from self.pop(lcp)
        for d in range(lcp + 1, depth + 1):
            if d:
                self.stack[-1][_CHILDREN] += 1
            size = points[d - 1] if d else 0
            self.stack.append([at, size, 0, None, 0, 0, 0, size, None])
        top = self.stack[-1]
        top[_N], top[_LEAST], top[_ENDS] = top[_N] + n, least if top[_LEAST] is None else min(least, top[_LEAST]), ends
        self.ends_at = depth

    def pop(self, lcp: int, end: bool = False) -> Iterator[tuple]:
        """Close the nodes deeper than ``lcp``; at the block's end all, and those that the next block shares stay open."""
        stack = self.stack
        if lcp < self.ends_at:
            stack[-1][_LEAVES] = 1
        while len(stack) - 1 > (-1 if end else lcp):
            depth, x = len(stack) - 1, stack.pop()
            paths = x[_PATHS] + x[_N] * x[_POINTS]
            began = x[_AT] is not None
            parent_block = parent_at = None
            if stack:
                up = stack[-1]
                up[_N] += x[_N]
                up[_LEAST] = x[_LEAST] if up[_LEAST] is None else min(up[_LEAST], x[_LEAST])
                up[_LEAVES] += x[_LEAVES]
                up[_PATHS] += paths
                up[_NODES] += x[_NODES]
                if began:
                    parent_block, parent_at = (self.owners[depth - 1], -1) if up[_AT] is None else (self.block, up[_AT])
            yield (self.block if began else self.owners[depth], x[_AT], depth, not began or (end and depth <= lcp), parent_block, parent_at, x[_N], x[_LEAST], x[_CHILDREN], x[_LEAVES], paths, x[_NODES], x[_ENDS])

    def close(self) -> Iterator[tuple]:
        yield from self.pop(self.next_edge, end=True)


def _nodes(batches: Iterator[pa.RecordBatch], edges: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Nodes of the blocks, whose rows come in order."""

    def found() -> Iterator[tuple]:
        current = None
        for batch in batches:
            for block, at, lcp, key, points, n, least, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current.block != block:
                    if current is not None:
                        yield from current.close()
                    current = _Block(block, edges)
                yield from current.add(at, lcp, len(key) // KEY, points, n, least, ends)
        if current is not None:
            yield from current.close()

    held: list[tuple] = []
    for row in found():
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES, strict=True)], _NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES, strict=True)], _NAMES)


def prefix_trie(conversations: DataFrame, blocks: int | None = None) -> DataFrame:
    """The trie of (conv_id, turns) as ``conversation_turns`` gives them: a row for each node.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    blocks = blocks or int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = materialize(sequences(conversations))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    rows = materialize(distinct.repartitionByRange(blocks, "key").sortWithinPartitions("key").mapInArrow(_neighbours, f"block int, at long, lcp int, {kinds}"))
    edges = block_edges(rows)
    ordered = rows.repartition(blocks, "block").sortWithinPartitions("block", "at").select("block", "at", "lcp", "key", "points", "n", "least", "ends")
    found = materialize(ordered.mapInArrow(lambda b: _nodes(b, edges), NODE))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "on_paths", "on_nodes")]
    merged = found.where("open").groupBy("block", "depth").agg(F.max("at").alias("at"), F.max("parent_block").alias("parent_block"), F.max("parent_at").alias("parent_at"), F.min("least").alias("least"), F.max("ends").alias("ends"), *sums)
    nodes = found.where("NOT open").drop("open").unionByName(merged)
    # an open node is known by the row at which it began to its own block and by the block alone to others
    known = nodes.where("n_children > 0").select("block", "at", "depth", "least").unionByName(merged.select("block", F.lit(-1).cast("long").alias("at"), "depth", "least"))
    parents = known.select(F.col("block").alias("parent_block"), F.col("at").alias("parent_at"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent_conv_id"))
    return nodes.join(parents, ["parent_block", "parent_at", "depth"], "left").select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("on_paths") - F.col("on_nodes")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return prefix_trie(rebuilt(conversation_turns(table(spark, sf_dir, "conversations"))))


OP12_SQL = """
WITH crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
x AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i FROM x),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: xor(crc.t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM x) CROSS JOIN crc),
r AS (SELECT c.conv_id, 0 AS own, t.i, {'role': role, 'text': text} AS turn FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.i <= c.h
      UNION ALL SELECT c.conv_id, 1, t.i, {'role': role, 'text': text} FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
s AS (SELECT c.conv_id, list(turn ORDER BY own, i) FILTER (turn IS NOT NULL) AS turns, count(turn) AS n FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, n, d, CASE WHEN d > 0 THEN turns[1:d] ELSE [] END AS prefix FROM (SELECT *, unnest(range(n + 1)) AS d FROM s)),
g AS (SELECT d, prefix, count(*) AS n_convs, min(conv_id) AS conv_id, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY d, prefix),
k AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
w AS (SELECT g.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN g.d > 0 THEN (n_convs - 1) * length(g.prefix[g.d].text) ELSE 0 END AS saved
      FROM g LEFT JOIN k ON k.d = g.d AND (g.d = 0 OR k.prefix = g.prefix)),
u AS (SELECT a AS d, CASE WHEN a > 0 THEN prefix[1:a] ELSE [] END AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS a FROM w) GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN u ON u.d = w.d AND u.prefix = w.prefix LEFT JOIN g up ON up.d = w.d - 1 AND up.prefix = (CASE WHEN w.d > 1 THEN w.prefix[1:w.d - 1] ELSE [] END)
"""
