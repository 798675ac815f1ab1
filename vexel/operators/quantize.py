"""Training: Lloyd's k-means over a bounded sample or all rows, product quantizer, encoding and table look-up distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import PQ_SALT, Streams

#: Distances that are in memory at once.
CELLS = 1 << 22


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """n x k squared distances, added up left to right."""
    out = np.zeros((len(x), len(centers)))
    for j in range(x.shape[1]):
        out += (x[:, j, None].astype(np.float64) - centers[None, :, j].astype(np.float64)) ** 2
    return out


def nearest(x: np.ndarray, centers: np.ndarray, block: int = 8192) -> np.ndarray:
    """Nearest center of each row, ties to the lowest number. Matrix products choose candidates; where rounding leaves several, plain sums decide."""
    c = np.asarray(centers, np.float64)
    square = (c * c).sum(1)
    block = max(1, min(block, CELLS // max(1, len(c))))
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), block):
        part = np.asarray(x[at : at + block], np.float64)
        crude = square[None, :] - 2 * (part @ c.T)
        least = crude.min(1)
        room = 1e-12 * ((part * part).sum(1) + square.max()) * part.shape[1]
        near = crude <= (least + room)[:, None]
        own = near.argmax(1)
        for row in np.flatnonzero(near.sum(1) != 1):  # also rows that hold NaN, which have no candidate
            few = np.flatnonzero(near[row]) if near[row].any() else np.arange(len(c))
            own[row] = few[distances(x[at + row : at + row + 1], centers[few])[0].argmin()]
        out[at : at + block] = own
    return out


def lloyd_on_all(vectors: DataFrame, centers: np.ndarray, steps: int) -> np.ndarray:
    """Lloyd's steps over all rows of ``embedding``: sums by cluster and dimension in the tasks, means in double, kept as float32. An empty cluster stays where it is."""
    centers = np.array(centers, np.float32)
    k, d = centers.shape
    for _ in range(steps):
        shared = vectors.sparkSession.sparkContext.broadcast(centers)

        def run(batches, shared=shared):
            for batch in batches:
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                own = nearest(x, shared.value)
                n = np.bincount(own, minlength=k)
                some = np.flatnonzero(n)
                sums = np.stack([np.bincount(own, x[:, j].astype(np.float64), k)[some] for j in range(d)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, d)), pa.array(np.tile(np.arange(d), len(some))), pa.array(sums.reshape(-1)), pa.array(np.repeat(n[some], d))], ["c", "j", "x", "n"])

        rows = vectors.select("embedding").mapInArrow(run, "c long, j long, x double, n long").groupBy("c", "j").agg((F.sum("x") / F.sum("n")).alias("x"))
        for r in rows.collect():  # one row for each cluster and dimension
            centers[r.c, r.j] = r.x
    return centers


def initial_rows(n: int, k: int, rng: Streams, redraws: int = 64) -> list[int]:
    """k row numbers; a row drawn before is drawn again, up to ``redraws`` times."""
    taken: list[int] = []
    seen: set[int] = set()
    for _ in range(k):
        row = int(rng.below(n)[0])
        for _ in range(redraws):
            if row not in seen:
                break
            row = int(rng.below(n)[0])
        seen.add(row)
        taken.append(row)
    return taken


def lloyd(x: np.ndarray, centers: np.ndarray, steps: int, rng: Streams | None = None) -> np.ndarray:
    """A fixed number of steps; means in double, kept as float32. Empty clusters, in ascending order, become drawn rows."""
    x, centers = np.asarray(x, np.float32), np.array(centers, np.float32)
    k, d = centers.shape
    for _ in range(steps):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j].astype(np.float64), k) for j in range(d)], axis=1)
        filled = n > 0
        centers[filled] = (sums[filled] / n[filled, None]).astype(np.float32)
        for c in np.flatnonzero(~filled):
            if rng is not None:
                centers[c] = x[int(rng.below(len(x))[0])]
    return centers


def kmeans(x: np.ndarray, k: int, steps: int, seed: int) -> np.ndarray:
    if len(x) < k:
        raise ValueError(f"{len(x)} training rows for {k} clusters")
    rng = Streams(np.array([seed], np.uint64))
    return lloyd(x, x[initial_rows(len(x), k, rng)], steps, rng)


def split(x: np.ndarray, m: int) -> np.ndarray:
    if x.shape[1] % m:
        raise ValueError(f"{x.shape[1]} dimensions don't split into {m}")
    return x.reshape(len(x), m, -1)


def train_codebook(residuals: np.ndarray, m: int, ksub: int, steps: int, seed: int) -> np.ndarray:
    """m x ksub x (d / m)."""
    if not 1 <= ksub <= 256:
        raise ValueError("a code is one byte: 1 <= ksub <= 256")
    parts = split(residuals, m)
    return np.stack([kmeans(parts[:, s], ksub, steps, seed ^ PQ_SALT ^ (s + 1)) for s in range(m)])


def encode(residuals: np.ndarray, book: np.ndarray) -> np.ndarray:
    parts = split(residuals, len(book))
    return np.stack([nearest(parts[:, s], book[s]) for s in range(len(book))], axis=1).astype(np.uint8)


def decode(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.concatenate([book[s][codes[:, s]] for s in range(len(book))], axis=1)


def lookup_table(residual: np.ndarray, book: np.ndarray) -> np.ndarray:
    """m x ksub distances of a query residual's parts."""
    parts = split(residual[None], len(book))[0]
    return np.stack([distances(parts[s][None], book[s])[0] for s in range(len(book))])


def table_distance(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes))
    for s in range(len(table)):
        out += table[s][codes[:, s]]
    return out
