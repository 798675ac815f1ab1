"""IVF-PQ: an inverted file of product-quantised residuals as Parquet, approximate search and exact re-ranking."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import COARSE_SALT
from . import quantize as Q
from .topk import Best, collected, left_to_right, matrix, ranked, valid


#: Rows of a short list that are sent around (the driver builds their hash table), and of a batch of hits.
SHORT_ROWS, BATCH = 1 << 17, 1 << 16


@dataclass(frozen=True)
class BuildParams:
    nlist: int = 1024
    m: int = 8
    ksub: int = 256
    n_train: int = 200_000
    coarse_iters: int = 10
    pq_iters: int = 10
    seed: int = 88172645463325252
    #: Folders of lists that a search can leave out; 0: one for each 4 million vectors, 16 at least.
    buckets: int = 0


@dataclass
class IvfPq:
    meta: dict
    centroids: np.ndarray
    book: np.ndarray
    codes: DataFrame

    @property
    def lists(self) -> int:
        return len(self.centroids)


def sample(vectors: DataFrame, n: int, id_col: str = "id") -> np.ndarray:
    """Whole vectors by id: all of them up to n, else n of them, those with the least hashes of their ids. Only these come to the driver, through Arrow."""
    d = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = valid(vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")), d)
    total, place = rows.count(), F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    if total > n:
        rows = rows.where(place < int(min(1, (n + 5 * n**0.5 + 10) / total) * (1 << 30)))
    rows = rows.withColumn("place", place).toArrow()
    x = matrix(rows.column("embedding").combine_chunks(), d).astype(np.float32)
    ids = rows.column("id").to_numpy()
    least = np.lexsort((ids, rows.column("place").to_numpy()))[:n]
    return x[least[np.argsort(ids[least], kind="stable")]]


def train(vectors: DataFrame, p: BuildParams, id_col: str = "id") -> tuple[np.ndarray, np.ndarray]:
    """Quantizers from n_train vectors, a sample whose size is a parameter."""
    x = sample(vectors, p.n_train, id_col)
    if not len(x) or x.shape[1] % p.m:
        raise ValueError("no training rows" if not len(x) else f"{x.shape[1]} dimensions don't split into {p.m}")
    centroids = Q.kmeans(x, p.nlist, p.coarse_iters, p.seed ^ COARSE_SALT)
    return centroids, Q.train_codebook(x - centroids[Q.nearest(x, centroids)], p.m, p.ksub, p.pq_iters, p.seed)


def encode_vectors(vectors: DataFrame, centroids: np.ndarray, book: np.ndarray, id_col: str = "id") -> DataFrame:
    """(list_id, id, code): assignment and encoding in one pass, quantizers sent around (their size is set by the parameters)."""
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, book))
    d = centroids.shape[1]

    def run(batches):
        centers, parts = shared.value
        for batch in batches:
            x = matrix(batch.column("embedding"), d).astype(np.float32)
            own = Q.nearest(x, centers)
            codes = Q.encode(x - centers[own], parts) if len(x) else np.zeros((0, len(parts)), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], ["list_id", "id", "code"])

    return valid(vectors.select(F.col(id_col).cast("long").alias("id"), "embedding"), d).mapInArrow(run, "list_id int, id long, code binary")


def build(vectors: DataFrame, path: str, p: BuildParams = BuildParams(), id_col: str = "id") -> IvfPq:
    """Writes codes (by bucket of lists, sorted by list), quantizers and, last, the description."""
    spark = vectors.sparkSession
    n = vectors.count()
    p = replace(p, buckets=p.buckets or min(p.nlist, max(16, -(-n // (4 << 20)))))
    files = max(1, -(-n * (p.m + 12) // (128 << 20)))  # of about 128 MB
    centroids, book = train(vectors, p, id_col)
    codes = encode_vectors(vectors, centroids, book, id_col).withColumn("bucket", F.col("list_id") % p.buckets)
    codes.repartition(max(files, p.buckets), "bucket", F.pmod("id", F.lit(max(1, files // p.buckets)))).sortWithinPartitions("bucket", "list_id", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/codes")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list_id int, embedding array<float>").write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(s, c, v.tolist()) for s, b in enumerate(book) for c, v in enumerate(b)], "s int, c int, sub array<float>").write.mode("overwrite").parquet(f"{path}/codebook")
    n = spark.read.parquet(f"{path}/codes").count()
    meta = {"n": n, "d": int(centroids.shape[1]), **asdict(p)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> IvfPq:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    centroids = np.array([r.embedding for r in spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()], np.float32)
    book = [r.sub for r in spark.read.parquet(f"{path}/codebook").orderBy("s", "c").collect()]
    return IvfPq(meta, centroids, np.array(book, np.float32).reshape(meta["m"], -1, meta["d"] // meta["m"]), spark.read.parquet(f"{path}/codes"))


def list_sizes(codes: DataFrame, lists: int) -> DataFrame:
    """(list_id, size, offset), empty lists too."""
    every = codes.sparkSession.range(lists).select(F.col("id").cast("int").alias("list_id"))
    sizes = every.join(codes.groupBy("list_id").count(), "list_id", "left").select("list_id", F.coalesce("count", F.lit(0)).alias("size"))
    before = Window.orderBy("list_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each list
    return sizes.withColumn("offset", F.sum("size").over(before) - F.col("size"))


def _edges(q: np.ndarray, centroids: np.ndarray, nprobe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance and number of the farthest of each query's nprobe nearest lists, and the lists that any query has among these."""
    edge, last, asked = np.zeros(len(q)), np.zeros(len(q), np.int64), np.zeros(len(centroids), bool)
    block = max(1, Q.CELLS // len(centroids))
    for at in range(0, len(q), block):
        apart = Q.distances(q[at : at + block], centroids)
        near = apart.argsort(1, kind="stable")[:, :nprobe]
        asked[near.reshape(-1)] = True
        last[at : at + block] = near[:, -1]
        edge[at : at + block] = np.take_along_axis(apart, near[:, -1:], 1)[:, 0]
    return edge, last, np.flatnonzero(asked)


def pair_distance(r: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """What a look-up table adds up to, for paired rows of query residuals and decoded vectors: sums of the m parts, each left to right."""
    out, size = np.zeros(len(r)), r.shape[1] // m
    for s in range(m):
        part = np.zeros(len(r))
        for j in range(s * size, (s + 1) * size):
            part += (r[:, j].astype(np.float64) - x[:, j].astype(np.float64)) ** 2
        out += part
    return out


def search(index: IvfPq, queries: DataFrame, nprobe: int, k: int) -> DataFrame:
    """(qid, rank, id, dist): the k best approximate distances in each query's nprobe nearest lists.

    The queries are a bounded set; only they and one list for each come to the driver. A task keeps the k best of each query over all its lists: matrix products with the
    decoded vectors of a list leave out those that can't be among them, the others' distances are then added up plainly.
    """
    spark, d = queries.sparkSession, index.centroids.shape[1]
    asked = queries.select("qid", "embedding").where(F.col("embedding").isNotNull())
    if asked.where(F.size("embedding") != d).limit(1).count():
        raise ValueError("query and index differ in length")
    qids, q = collected(valid(asked, d))
    if not len(q) or nprobe <= 0 or k <= 0:
        return spark.createDataFrame([], "qid long, rank int, id long, dist double")
    edge, last, lists = _edges(q, index.centroids, nprobe)
    shared = spark.sparkContext.broadcast((qids, q, edge, last, index.centroids, index.book))
    codes = index.codes.where(F.col("list_id").isin(lists.tolist()))
    if "bucket" in codes.columns:
        codes = codes.where(F.col("bucket").isin(sorted({c % index.meta["buckets"] for c in lists.tolist()})))

    def run(batches):
        qids, q, edge, last, centers, book = shared.value
        best = Best(len(q), k)
        for batch in batches:
            lists, ids = batch.column("list_id").to_numpy(), batch.column("id").to_numpy()
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            for c in np.unique(lists):
                rows = np.flatnonzero(lists == c)
                x, own = Q.decode(code[rows], book), ids[rows]
                x64 = x.astype(np.float64)
                square = (x64**2).sum(1)
                apart = Q.distances(q, centers[c : c + 1])[:, 0]
                asks = np.flatnonzero((apart < edge) | ((apart == edge) & (c <= last)))
                step = max(1, Q.CELLS // len(rows))
                for at in range(0, len(asks), step):
                    j = asks[at : at + step]
                    r = q[j] - centers[c]
                    r64 = r.astype(np.float64)
                    crude = square[None, :] - 2 * (r64 @ x64.T) + (r64**2).sum(1)[:, None]
                    top = best.bound[j]
                    free = np.flatnonzero(np.isinf(top)) if len(rows) > k else []
                    if len(free):
                        top[free] = np.partition(crude[free], k - 1, axis=1)[:, k - 1]
                    # everything within rounding of the last one is a candidate too
                    a, b = (crude <= (top + 1e-9 * (1 + np.abs(top)))[:, None]).nonzero()
                    best.add(j[a], own[b], pair_distance(r[a], x[b], len(book)))
        j, ids, dist = best.cut()
        for at in range(0, len(j), BATCH):
            some = slice(at, at + BATCH)
            yield pa.RecordBatch.from_arrays([pa.array(qids[j[some]]), pa.array(ids[some]), pa.array(dist[some])], ["qid", "id", "dist"])

    return ranked(codes.select("list_id", "id", "code").mapInArrow(run, "qid long, id long, dist double"), k)


def rerank(vectors: DataFrame, queries: DataFrame, shortlist: DataFrame, k: int, id_col: str = "id", rows: int | None = None) -> DataFrame:
    """Exact distances of the shortlist, k best: a join on the id, then pairs of rows in numpy.

    ``rows``: a bound of the short list's rows; up to SHORT_ROWS it goes to the vectors, so that these aren't shuffled.
    """
    short = shortlist.select("qid", "id")
    if rows is not None and rows <= SHORT_ROWS:
        short = F.broadcast(short)
    pairs = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").alias("x")).join(short, "id")
    pairs = pairs.join(queries.select("qid", F.col("embedding").alias("q")), "qid")

    def run(batches):
        for batch in batches:
            if len(batch):
                d = left_to_right(matrix(batch.column("q")), matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("id"), pa.array(d)], ["qid", "id", "dist"])

    return ranked(pairs.select("qid", "id", "q", "x").mapInArrow(run, "qid long, id long, dist double"), k)


def search_and_rerank(index: IvfPq, vectors: DataFrame | Callable[[DataFrame], DataFrame], queries: DataFrame, nprobe: int = 16, k: int = 10, shortlist: int = 256, id_col: str = "id") -> DataFrame:
    """``vectors``: a table, or a function from a table of ids to their vectors (id, embedding), where those can be made anew."""
    short = search(index, queries, nprobe, shortlist)
    if callable(vectors):
        vectors, id_col = vectors(short.select("id").distinct()), "id"
    return rerank(vectors, queries, short, k, id_col, queries.count() * shortlist)


def latencies(index: IvfPq, vectors: DataFrame | Callable[[DataFrame], DataFrame], queries: DataFrame, nprobe: int, k: int, shortlist: int, untimed: int = 20) -> list[float]:
    """Milliseconds of each query (a bounded set), asked one at a time; the first ``untimed`` are asked once more beforehand."""
    spark, rows = queries.sparkSession, queries.select("qid", "embedding").collect()
    took = []
    for j, row in enumerate(rows[:untimed] + rows):
        began = time.perf_counter()
        search_and_rerank(index, vectors, spark.createDataFrame([row], "qid long, embedding array<float>"), nprobe, k, shortlist).collect()
        if j >= min(untimed, len(rows)):
            took.append((time.perf_counter() - began) * 1000)
    return took
