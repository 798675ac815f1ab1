"""Exact top-k by inner product: a Voronoi kNN join.

Vectors become whole numbers, ``floor(256 x)``.

1. Pivots are drawn by a hash from the data, about a quarter of the root of its rows (PIVOTS bounds them). Each vector belongs to the cell of its
   nearest pivot; queries are data too, so they have a cell.
2. Each cell is summarised by its rows, its radius (greatest distance to the pivot) and its greatest norm.
3. Each query is solved within its own cell. Its k-th score there bounds its k-th score from below.
4. A cell of pivot p, radius r and norm m has no score above ``min(q.p + |q| r, |q| m)``. Only where that reaches the query's bound is the
   query sent to the cell and solved there. The best k of all its cells are the answer.

A vector moves once for each QUERIES queries that its cell gets; cells and their queries are dealt out in blocks of bounded size, each solved by exact
matrix products, so a cell that holds most rows is no single task. Where vectors have clusters, few cells are left in step 4; vectors that
fill a sphere evenly have a k-th neighbour hardly nearer than any other, so that no exact bound leaves out a cell, and the join is a blocked product of
all queries and all vectors.

Queries: rows whose id is divisible by 50. Ties go to the smaller id. Defined results: vectors that are null or hold null or non-finite
components take no part; vectors of other lengths never meet (each length is joined on its own); rows repeated with id and vector
count once; rows without an id take no part; fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, EVERY, PIVOTS = 5, 50, 4096
#: Vectors and queries of a block.
CHUNK, QUERIES = 8192, 4096
SLACK = 1e-6


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double> of whole numbers), dim and squared norm."""
    x = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double"))), F.lit(False))
    v = F.transform(x, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("double"))
    rows = vectors.select("vec_id", "embedding").where(ok).select("vec_id", v.alias("v")).dropDuplicates(["vec_id", "v"])
    return rows.select("vec_id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c).alias("square"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products; in double precision where that is exact, else in 64-bit integers."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    return (q @ x.T).astype(np.int64) if most < 2**53 else q.astype(np.int64) @ x.astype(np.int64).T


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(1)[None, :]))


def place(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v, square and cell (nearest pivot) and far (distance to it) of each vector, written to the shared folder."""
    dim = pivots.shape[1]

    def run(batches):
        for batch in batches:
            if len(batch):
                d = _distances(_matrix(batch.column("v"), dim), pivots)
                cell = d.argmin(1)
                new = [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("vec_id", "v", "square")] + new, ["vec_id", "v", "square", "cell", "far"])

    return common.materialize(rows.select("vec_id", "v", "square").mapInArrow(run, "vec_id long, v array<double>, square double, cell int, far double"), "cells")


def sent(asked: DataFrame, pivots: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> DataFrame:
    """vec_id, v and cell: a row for each query and cell, other than its own, that may hold one of its best.

    ``asked`` has vec_id, v, cell and least, a score that k others reach (null: there are fewer). Cells without rows have a negative norm.
    """
    dim = pivots.shape[1]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch.column("v"), dim)
            long = np.sqrt((q * q).sum(1))[:, None]
            most = np.minimum(q @ pivots.T + long * radius[None, :], long * norm[None, :])
            least = batch.column("least").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            may = (most * (1 + SLACK * np.sign(most)) + SLACK >= least[:, None]) & (norm >= 0)[None, :]
            may[np.arange(len(q)), batch.column("cell").to_numpy()] = False
            row, cell = np.nonzero(may)
            for at in range(0, len(row), CHUNK):
                take = pa.array(row[at : at + CHUNK])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(cell[at : at + CHUNK].astype(np.int32))], ["vec_id", "v", "cell"])

    return asked.select("vec_id", "v", "cell", "least").mapInArrow(run, "vec_id long, v array<double>, cell int")


def solve(asked: DataFrame, placed: DataFrame, sizes: dict[int, int], dim: int, k: int) -> DataFrame:
    """query_id, vec_id and score: at least the best k vectors for each query in the cell that its row names (a query may have several rows)."""
    spark = placed.sparkSession
    asks = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each pivot
    cells = [(c, -(-sizes[c] // CHUNK), -(-n // QUERIES)) for c, n in sorted(asks.items()) if c in sizes]
    parts = F.broadcast(spark.createDataFrame(cells, "cell int, dparts long, qparts long"))  # one row for each pivot
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    place_of = lambda c, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(c))
    left = asked.join(parts, "cell").withColumn("qpart", place_of("qparts", 1)).select("cell", upto("dparts").alias("dpart"), "qpart", "vec_id", "v")
    left = left.toDF("of_cell", "of_dpart", "of_qpart", "query_id", "q")  # names apart from the data's, as both may come from one table
    right = placed.join(parts, "cell").withColumn("dpart", place_of("dparts", 2)).select("cell", "dpart", upto("qparts").alias("qpart"), "vec_id", "v")

    def run(_, left, right):
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64())] * 3, names)
        left, right = left.combine_chunks(), right.combine_chunks()
        ids = right.column("vec_id").to_numpy()
        x = _matrix(right.column("v").combine_chunks(), dim)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        asks = left.column("query_id").to_numpy()
        q = _matrix(left.column("q").combine_chunks(), dim)
        out = []
        for at in range(0, len(asks), 256):
            s = products(q[at : at + 256], x)
            own = asks[at : at + 256]
            s[own[:, None] == ids[None, :]] = -np.iinfo(np.int64).max
            if len(ids) > 8 * k:  # all that reach the k-th score, then the best of these: ties stay in the order of the ids
                kth = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
                row, col = np.nonzero(s >= kth[:, None])
            else:
                row, col = np.divmod(np.arange(s.size), len(ids))
            score = s[row, col]
            best = np.lexsort((col, -score, row))
            row, col, score = row[best], col[best], score[best]
            first = np.searchsorted(row, row)  # where the row's entries begin
            ok = (np.arange(len(row)) - first < k) & (score > -np.iinfo(np.int64).max)
            out.append((own[row[ok]], ids[col[ok]], score[ok]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    keys = ["cell", "dpart", "qpart"]
    return left.groupBy("of_cell", "of_dpart", "of_qpart").cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _join_dimension(rows: DataFrame, dim: int, n: int, k: int, every: int) -> DataFrame:
    rows = rows.where(F.col("dim") == dim)
    count = int(min(PIVOTS, max(1, np.ceil(np.sqrt(n) / 4))))
    pivots = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()])  # at most PIVOTS vectors
    placed = place(rows, pivots)
    radius, norm, sizes = np.zeros(len(pivots)), np.full(len(pivots), -1.0), {}
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.max("square").alias("square"), F.count(F.lit(1)).alias("n")).collect():  # one row for each pivot
        radius[r.cell], norm[r.cell], sizes[r.cell] = r.far, np.sqrt(r.square), r.n
    asked = placed.where(F.col("vec_id") % every == 0)
    near = common.materialize(_best(solve(asked.select("vec_id", "v", "cell"), placed, sizes, dim, k), k), "near")
    least = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    far = common.materialize(sent(asked.join(least, "vec_id", "left"), pivots, radius, norm), "sent")
    return _best(near.drop("rank").unionByName(solve(far, placed, sizes, dim, k)), k)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score."""
    rows = common.materialize(whole_vectors(vectors), "whole")
    kinds = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each length of vector
    parts = [_join_dimension(rows, r.dim, r.n, k, every) for r in sorted(kinds) if r.dim]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op8_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor(256.0::DOUBLE * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % {EVERY} = 0 AND len(q.v) > 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
