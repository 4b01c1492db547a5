"""Vector legs and phrases: for many queries at once, the best rows of a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.session import materialize

#: Rows of a leg, vectors of a block, queries whose best rows a task keeps, words of a run by which phrases are found, and runs that are handed to every task.
LEG_LIMIT, BLOCK, KEPT_QUERIES, RUN, HANDED = 50, 1024, 50_000, 4, 200_000


def ranked(rows: DataFrame, order: list[Column], by: list[str], name: str = "rank", limit: int | None = LEG_LIMIT) -> DataFrame:
    """Number the rows of each group; with a limit only its first rows stay."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if limit is None else out.where(F.col(name) <= limit)


def phrase_matches(queries: DataFrame, chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id, id) where the row holds the query's words in order, one behind the other.

    Queries are cut into runs of ``RUN`` words, the last one flush with their end. A row's runs are joined with
    them where the row lies (beyond ``HANDED`` by a shuffle), so only runs that some query has are dealt out; a
    row in which all runs of a query stand at their places holds it.
    """
    runs = lambda words, k: F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda p: F.array_join(F.slice(words, p, k), " "))
    q = queries.select("query_id", tokens(F.col(text_col)).alias("words")).where(F.size("words") > 0).withColumn("k", F.least(F.size("words"), F.lit(RUN)))
    asked = q.select("query_id", "k", F.size("words").alias("total"), F.posexplode(runs(F.col("words"), F.col("k"))).alias("at", "run"))
    asked = asked.where((F.col("at") % RUN == 0) | (F.col("at") == F.col("total") - F.col("k")))
    asked = materialize(asked.withColumn("of", F.ceil(F.col("total") / F.col("k")).cast("int")).drop("total"))
    many = {r["k"]: r["count"] for r in asked.groupBy("k").count().collect()}
    lengths, handed = sorted(many), sum(many.values()) <= HANDED
    said = chunks.select("id", tokens(F.col(text_col)).alias("words"))
    # a row for each run of a row, of the lengths that are asked for; the words themselves stay behind
    each = [F.when(F.size("words") >= k, runs(F.col("words"), F.lit(k))).otherwise(F.array().cast("array<string>")) for k in lengths]
    places = reduce(DataFrame.union, (said.select("id", F.lit(k).alias("k"), F.posexplode(x).alias("pos", "run")) for k, x in zip(lengths, each, strict=True))) if lengths else said.selectExpr("id", "0 AS k", "0 AS pos", "'' AS run").where("false")
    held = places.join(F.broadcast(asked) if handed else asked, ["k", "run"])
    whole = held.groupBy("query_id", "id", (F.col("pos") - F.col("at")).alias("begin")).agg(F.count("*").alias("n"), F.max("of").alias("of"))
    return whole.where("n = of").select("query_id", "id").distinct()


# -- vectors -------------------------------------------------------------------------------------


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity in doubles; a vector of norm 0 counts as norm 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.coalesce(F.nullif(F.sqrt(dot(x, x)), F.lit(0.0)), F.lit(1.0))
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def vector_leg(queries: DataFrame, vectors: DataFrame, limit: int = LEG_LIMIT, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, distance, rank): the nearest rows by cosine distance (to 9 places), then id.

    Exact: every vector is compared with every query of the stated set. Both sides are packed into blocks
    of ``BLOCK`` rows, the blocks are joined, and a task keeps the best ``limit`` rows of each query over
    all pairs of blocks that it sees. Null vectors take no part.
    """
    asked = queries.where(F.col("vector").isNotNull()).select(F.col("query_id").alias("id"), "vector")
    held = vectors.where(F.col("vector").isNotNull()).select("id", "vector")
    kind = lambda df: df.schema["id"].dataType.simpleString()
    left = asked.mapInArrow(_pack, f"ids array<{kind(asked)}>, matrix binary").withColumnsRenamed({"ids": "query_ids", "matrix": "query_matrix"})
    right = held.mapInArrow(_pack, f"ids array<{kind(held)}>, matrix binary")
    near = right.crossJoin(left).mapInArrow(_nearest(limit, exclude_self), f"query_id {kind(asked)}, id {kind(held)}, distance double")
    return ranked(near, [F.col("distance"), F.col("id")], ["query_id"], limit=limit)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks: ids in order and the rows' unit vectors as one matrix."""
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            part = batch.slice(begin, BLOCK)
            order = np.argsort(np.array(part.column(0).to_pylist(), dtype=object), kind="stable")
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(part.num_rows, -1)[order]
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            ids = pa.array([part.column(0).take(pa.array(order)).to_pylist()], pa.list_(part.schema.types[0]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([(x / np.where(norm == 0, 1, norm)).tobytes()], pa.binary())], ["ids", "matrix"])


def _nearest(limit: int, exclude_self: bool):
    """Keeps a running best of each query; what is kept is handed on when too many queries have been met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        kinds = None

        def out() -> pa.RecordBatch:
            rows = [(q, i, x) for q, pairs in best.items() for x, i in pairs]
            columns = [pa.array([r[0] for r in rows], kinds[1].value_type), pa.array([r[1] for r in rows], kinds[0].value_type), pa.array([r[2] for r in rows], pa.float64())]
            best.clear()
            return pa.RecordBatch.from_arrays(columns, ["query_id", "id", "distance"])

        for batch in batches:
            kinds = batch.schema.field("ids").type, batch.schema.field("query_ids").type
            for row in range(batch.num_rows):
                ids, matrix, query_ids, query_matrix = (batch.column(n)[row].as_py() for n in ("ids", "matrix", "query_ids", "query_matrix"))
                held, asked = np.frombuffer(matrix).reshape(len(ids), -1), np.frombuffer(query_matrix).reshape(len(query_ids), -1)
                distances = np.round(1 - asked @ held.T, 9) + 0.0  # no negative zero
                wanted = min(len(ids), limit + exclude_self)
                # all that are no further than the last wanted, so that ties go by id, in whose order the rows are
                bounds = np.partition(distances, wanted - 1, axis=1)[:, wanted - 1]
                for q, line, bound in zip(query_ids, distances, bounds, strict=True):
                    near = np.nonzero(line <= bound)[0]
                    near = near[np.argsort(line[near], kind="stable")][:wanted]
                    found = [(float(line[j]), ids[j]) for j in near if not exclude_self or ids[j] != q]
                    best[q] = sorted([*best[q], *found])[:limit] if q in best else found[:limit]
                if len(best) > KEPT_QUERIES:
                    yield out()
        if best:
            yield out()

    return run


def step_vector_leg(each: DataFrame, sentences: DataFrame, limit: int = LEG_LIMIT) -> DataFrame:
    """One leg of several sentences: ``each`` is their own leg by sentence, ``sentences`` (query_id, of) names the query ``of`` a sentence.

    A row takes its best number in the sentences' legs (of equal numbers the nearer), and these make the
    leg, so the sentences' first rows come before any second row.
    """
    best = each.join(sentences, "query_id").groupBy("of", "id").agg(F.min(F.struct("rank", "distance")).alias("best"))
    best = best.select(F.col("of").alias("query_id"), "id", F.col("best.rank").alias("sentence_rank"), F.col("best.distance").alias("distance"))
    return ranked(best, [F.col("sentence_rank"), F.col("distance"), F.col("id")], ["query_id"], limit=limit)
