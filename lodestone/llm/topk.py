"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query in blocks (a stated query set against all rows).
Each pass counts the scores of a query's current range in equal bins, the counts are added up over
all blocks, and the bin with the k-th highest score becomes the next range. When the range is one
score wide, or few enough rows lie at or above it, one last pass keeps the rows from the range's
lower end on, at most k of a block, and orders them by score and id.

Rows are taken as they are: a repeated candidate row takes a place for each repetition; a repeated
query id is one query (its smallest vector). A query's own id is never among its candidates. Vectors
that are null or hold null or non-finite components take no part. Vectors of different lengths are
padded with zeros. Ties go to the smaller id. Empty tables give no rows. Only
the id and the vector are carried, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import materialize, table

#: Rows of a block of candidates or queries, bins of a pass (a power of two), and how many rows at
#: or above a range end the refinement.
BLOCK, QUERY_BLOCK, BITS, FEW = 1024, 512, 8, 64


def _packed(batches: Iterator[pa.RecordBatch], size: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: the vectors as one matrix of the smallest integers that hold it (their bytes come first), every other column as one int64 array."""

    def block(rows: list[list]) -> pa.RecordBatch:
        vectors = rows[0]
        width = max(map(len, vectors))
        matrix = np.zeros((len(vectors), width), np.int64)
        for k, v in enumerate(vectors):
            matrix[k, : len(v)] = v
        least, most = int(matrix.min(initial=0)), int(matrix.max(initial=0))
        kind = next(x for x in (np.int16, np.int32, np.int64) if np.iinfo(x).min <= least and most <= np.iinfo(x).max)
        arrays = [pa.array([len(vectors)], pa.int32()), pa.array([bytes([kind().itemsize]) + matrix.astype(kind).tobytes()], pa.binary())]
        arrays += [pa.array([np.array(c, np.int64).tobytes()], pa.binary()) for c in rows[1:]]
        return pa.RecordBatch.from_arrays(arrays, ["n", "vectors", *names])

    held: list[list] = []
    for batch in batches:
        for begin in range(0, batch.num_rows, size):
            part = [c.to_pylist() for c in batch.slice(begin, size).columns]
            held = [a + b for a, b in zip(held, part, strict=True)] if held else part
            while len(held[0]) >= size:
                yield block([c[:size] for c in held])
                held = [c[size:] for c in held]
    if held and held[0]:
        yield block(held)


def _pack(df: DataFrame, size: int, names: list[str]) -> DataFrame:
    return df.select("v", *names).mapInArrow(lambda b: _packed(b, size, names), "n int, vectors binary, " + ", ".join(f"{x} binary" for x in names))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond what doubles hold exactly, with Python's integers, cut to a long."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, width)
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
            out = {name: np.frombuffer(value, np.int64) for name, value in row.items() if isinstance(value, bytes) and not name.endswith("vectors")}
            for n, m in (("n", "vectors"), ("c_n", "c_vectors")):
                out[m] = np.frombuffer(row[m], f"i{row[m][0]}", offset=1).reshape(row[n], -1)
            yield out


def _count(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each query the counts of a block by bin, from the top as far as k scores need."""
    for x in _blocks(batches):
        scores = _scores(x["vectors"], x["c_vectors"])
        lo, hi, shift = x["lo"][:, None], x["hi"][:, None], x["shift"][:, None]
        inside = (scores >= lo) & (scores < hi) & (x["query_id"][:, None] != x["c_id"][None, :])
        bins = (np.where(inside, scores, lo) - lo) >> shift
        wide = int(bins.max(initial=0)) + 1
        keys = (np.arange(len(bins))[:, None] * wide + bins)[inside]
        counts = np.bincount(keys, minlength=len(bins) * wide).reshape(len(bins), wide)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, at = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(x["query_id"][q]), pa.array(at.astype(np.int64)), pa.array(counts[q, at].astype(np.int64))], ["query_id", "bin", "n"])


def _keep(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each query a block's rows at or above its range, the best k by (score, smaller id)."""
    for x in _blocks(batches):
        scores = _scores(x["vectors"], x["c_vectors"])
        inside = (scores >= x["lo"][:, None]) & (x["query_id"][:, None] != x["c_id"][None, :])
        q, c = np.nonzero(inside)
        s, ids = scores[q, c], x["c_id"][c]
        order = np.lexsort((ids, -s.astype(float) if not len(s) or np.abs(s.astype(float)).max() < 2.0**53 else -s.astype(object), q))
        q, ids, s = q[order], ids[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        near = rank < k
        yield pa.RecordBatch.from_arrays([pa.array(x["query_id"][q[near]]), pa.array(ids[near]), pa.array(s[near])], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: "F.Column", k: int = 5, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    ``vector_col`` holds arrays of long; rows for which ``is_query`` holds are the queries.
    """
    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("c_id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    size = F.aggregate("v", F.lit(0).cast("double"), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    n, n_queries, most = rows.agg(F.count("*"), F.count_if("q"), F.max(size)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], schema)
    # each part of the candidates meets a copy of every block of queries, so there are no more parts than tasks can use
    spread = max(1, min(n // BLOCK, 2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    candidates = _pack(rows.select("c_id", "v"), BLOCK, ["c_id"]).select(F.col("n").alias("c_n"), F.col("vectors").alias("c_vectors"), "c_id", F.pmod(F.xxhash64("c_id"), F.lit(spread)).alias("part"))
    candidates = materialize(candidates)
    # no score lies beyond the sum of a query's components times the largest component of all
    bound = F.least(F.lit(float(2**61)), F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))) * F.lit(float(most or 0)) + 1).cast("long")
    bits = F.greatest(F.lit(0), F.length(F.bin(F.col("hi") - F.col("lo"))) - F.lit(BITS))
    queries = rows.where("q").groupBy(F.col("c_id").alias("query_id")).agg(F.min("v").alias("v")).select("query_id", "v", (-bound).alias("lo"), (bound + 1).alias("hi"), F.lit(0).cast("long").alias("above"))
    state = materialize(queries.withColumn("shift", bits.cast("long")))

    def pairs(queries: DataFrame) -> DataFrame:
        """Every block of candidates beside every block of queries, dealt by the candidates' part."""
        blocks = _pack(queries.repartition(max(1, n_queries // QUERY_BLOCK), "query_id"), QUERY_BLOCK, ["query_id", "lo", "hi", "shift"])
        copies = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
        # Spark takes the copies to be as small as the stored queries and would send them all through the driver
        return copies.hint("merge").join(candidates, "part").drop("part")

    while True:
        counts = pairs(state).mapInArrow(lambda b: _count(b, k), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        ahead = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        found = placed.join(state.select("query_id", "above"), "query_id").where((F.col("ahead") + F.col("above") < k) & (F.col("ahead") + F.col("above") + F.col("n") >= k)).select("query_id", "bin", "ahead", "n")
        width = F.expr("shiftleft(cast(1 as bigint), cast(shift as int))")
        low = F.col("lo") + F.col("bin") * width
        # a query without a k-th score keeps its range: all its rows are wanted
        refined = state.join(found, "query_id", "left").select(
            "query_id", "v", F.coalesce(low, F.col("lo")).alias("lo"), F.coalesce(F.least(F.col("hi"), low + width), F.col("hi")).alias("hi"), (F.col("above") + F.coalesce("ahead", F.lit(0))).alias("above"), F.col("n").alias("inside")
        )
        state = materialize(refined.withColumn("shift", bits.cast("long")))
        wide = state.where((F.col("inside") + F.col("above") > FEW) & (F.col("hi") - F.col("lo") > 1)).limit(1).count()
        if not wide:
            break
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept = pairs(state).mapInArrow(lambda b: _keep(b, k), "query_id long, vec_id long, score long")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vec_id divisible by 50 the five highest inner products of floor(256·x)."""
    rows = table(spark, sf_dir, "embeddings")
    e = F.col("embedding")
    sound = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(e, lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return top_k(rows.where(sound).select("vec_id", whole.alias("v")), F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0))
WHERE rank <= 5
"""
