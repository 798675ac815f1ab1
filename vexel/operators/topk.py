"""Exact nearest neighbours of a set of queries: partial top-k in every batch, then a merge of the small rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_sq

#: Bytes of queries of a block, and vectors of one where both are dealt into blocks.
BLOCK_BYTES, ROWS = 32 << 20, 1 << 16
SLACK = 16
#: Hits that a task gathers before it leaves out those that can't be among the k best any more.
HELD = 1 << 20


def matrix(column: pa.Array, d: int | None = None) -> np.ndarray:
    """n x d doubles; rows must be whole vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if d is None else d) if len(column) else np.zeros((0, d or 0))


def valid(vectors: DataFrame, d: int, column: str = "embedding") -> DataFrame:
    """Rows with a vector of d finite components: others can't take a rank."""
    x = F.col(column)
    ok = x.isNotNull() & (F.size(x) == d) & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return vectors.where(ok)


def left_to_right(q: np.ndarray, x: np.ndarray, product: bool = False) -> np.ndarray:
    """Squared distance (or inner product) of paired rows, added up left to right as the SQL form does."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j] if product else (q[:, j] - x[:, j]) ** 2
    return out


def best_rows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, product: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, value) of the k best of a batch. Matrix products choose candidates, their values are then computed plainly."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    crude = -(q @ x.T) if product else (x**2).sum(1)[None, :] - 2 * (q @ x.T)
    m = min(len(x), k + SLACK)
    pick = np.argpartition(crude, m - 1, axis=1)[:, :m] if m < len(x) else np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
    # everything within rounding of the last candidate is one too
    if m < len(x):
        edge = np.take_along_axis(crude, pick, 1).max(1)
        near = (crude <= edge[:, None] + 1e-9 * (1 + np.abs(edge[:, None]))).nonzero()
    else:
        near = np.repeat(np.arange(len(q)), m), pick.reshape(-1)
    value = left_to_right(q[near[0]], x[near[1]], product)
    rank = np.lexsort((ids[near[1]], -value if product else value, near[0]))
    row, col, value = near[0][rank], near[1][rank], value[rank]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], ids[col[keep]], value[keep]


class Best:
    """The k least values of each of n queries among the hits so far, ties to the smaller id. ``bound``: the k-th of them when hits were last left out."""

    def __init__(self, n: int, k: int):
        self.k, self.bound, self.parts, self.rows, self.most = k, np.full(n, np.inf), [], 0, HELD

    def add(self, query: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        self.parts.append((query, ids, value))
        self.rows += len(ids)
        if self.rows > self.most:
            self.cut()
            self.most = max(HELD, 2 * self.rows)

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, value) of the hits that stay, by query and value."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, ids, value = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        rank = np.lexsort((ids, value, query))
        query, ids, value = query[rank], ids[rank], value[rank]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last, keep = place == self.k - 1, place < self.k
        self.bound[query[last]] = value[last]
        self.parts, self.rows = [(query[keep], ids[keep], value[keep])], int(keep.sum())
        return self.parts[0]


def collected(queries: DataFrame, kind: str = "float") -> tuple[np.ndarray, np.ndarray]:
    """qid and embedding of a bounded set of queries of one length, through Arrow: a driver's list of Python numbers takes many times the memory."""
    rows = queries.select(F.col("qid").cast("long").alias("qid"), F.col("embedding").cast(f"array<{kind}>").alias("x")).toArrow()
    flat = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return rows.column("qid").to_numpy(), flat.reshape(len(rows), -1 if len(rows) else 0)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", product: bool = False, value: str = "dist") -> DataFrame:
    """(qid, rank, id, dist): the k nearest vectors of each query, ties to the smaller id; ``product``: by inner product, greatest first.

    Up to BLOCK_BYTES of queries go round to one scan of the vectors. More queries are dealt into blocks of that size, the vectors into blocks
    of ROWS, and each pair of blocks is one group; nothing but counts comes to the driver.
    """
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], f"qid long, rank int, id long, {value} double")
    asked = queries.select("qid", "embedding").where(F.col("embedding").isNotNull())
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("d")).first()
    if size.least != size.d:
        raise ValueError("queries of different lengths")
    d = size.d or 0
    base = valid(vectors.select(F.col(id_col).cast("long").alias("id"), "embedding"), d)
    blocks = max(1, -(-size.n * 8 * d // BLOCK_BYTES))
    return ranked((_with_all if blocks == 1 else _by_blocks)(base, asked, k, d, product, value, blocks), k, value, descending=product)


def _hits(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, product: bool, value: str):
    for a in range(0, len(qids), 256):
        row, hit, v = best_rows(q[a : a + 256], x, ids, k, product)
        yield pa.RecordBatch.from_arrays([pa.array(qids[a : a + 256][row]), pa.array(hit), pa.array(v)], ["qid", "id", value])


def _with_all(base: DataFrame, asked: DataFrame, k: int, d: int, product: bool, value: str, blocks: int) -> DataFrame:
    shared = base.sparkSession.sparkContext.broadcast(collected(asked, "double"))  # BLOCK_BYTES at most

    def run(batches):
        qids, q = shared.value
        best = Best(len(q), k)
        for batch in batches:
            if len(batch):
                x, ids = matrix(batch.column("embedding"), d), batch.column("id").to_numpy()
                for a in range(0, len(q), 256):
                    row, hit, v = best_rows(q[a : a + 256], x, ids, k, product)
                    best.add(a + row, hit, -v if product else v)
        row, hit, v = best.cut()
        for at in range(0, len(row), ROWS):
            some = slice(at, at + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(qids[row[some]]), pa.array(hit[some]), pa.array(-v[some] if product else v[some])], ["qid", "id", value])

    return base.mapInArrow(run, f"qid long, id long, {value} double")


def _by_blocks(base: DataFrame, asked: DataFrame, k: int, d: int, product: bool, value: str, blocks: int) -> DataFrame:
    parts = max(1, -(-base.count() // ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block_of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select(every(parts).alias("part"), block_of("qid", blocks).alias("block"), "qid", "embedding").toDF("of_part", "of_block", "qid", "q")
    right = base.select(block_of("id", parts).alias("part"), every(blocks).alias("block"), "id", "embedding")

    def run(_, left, right):
        left, right = left.combine_chunks(), right.combine_chunks()
        found = []
        if len(left) and len(right):
            q, x = (matrix(t.column(c).combine_chunks(), d) for t, c in ((left, "q"), (right, "embedding")))
            found = list(_hits(left.column("qid").to_numpy(), q, right.column("id").to_numpy(), x, k, product, value))
        return pa.Table.from_batches(found, pa.schema([("qid", pa.int64()), ("id", pa.int64()), (value, pa.float64())]))

    return left.groupBy("of_part", "of_block").cogroup(right.groupBy("part", "block")).applyInArrow(run, f"qid long, id long, {value} double")


def ranked(hits: DataFrame, k: int, value: str = "dist", descending: bool = False) -> DataFrame:
    """The k best of each qid with rank from 1; Spark cuts each partition to k rows before the shuffle."""
    order = F.desc(value) if descending else F.asc(value)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(order, "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "id", value)


def exact_topk_sql(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", product: bool = False, value: str = "dist", where: Column | None = None) -> DataFrame:
    """The same in DataFrame functions only: the specification, for small tables."""
    base = vectors if where is None else vectors.where(where)
    base = base.select(F.col(id_col).alias("id"), F.col("embedding").alias("x"))
    pairs = queries.select("qid", F.col("embedding").alias("q")).join(base)
    pairs = pairs.select("qid", "id", (dot if product else l2_sq)("q", "x").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    return ranked(pairs, k, value, product)
