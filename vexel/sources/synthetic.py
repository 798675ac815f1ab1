"""Regenerable clustered vectors and queries with a planted nearest neighbour."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.rng import CENTER_SALT, GOLDEN, QUERY_SALT, QUERY_STEP, Streams, U, vector_seeds

BLOCK = 4096


@dataclass(frozen=True)
class DatasetSpec:
    d: int = 128
    num_centers: int = 200_000
    center_scale: float = 1.0
    noise: float = 0.2
    seed: int = 88172645463325252

    def centers(self, which: np.ndarray) -> np.ndarray:
        """Only the centers asked for, so none are stored or sent around."""
        with np.errstate(over="ignore"):
            r = Streams(U(self.seed) ^ CENTER_SALT ^ np.asarray(which, U) * GOLDEN)
        return np.stack([r.bell() * np.float32(self.center_scale) for _ in range(self.d)], axis=1)

    def vectors(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n x d float32, center of each)."""
        r = Streams(vector_seeds(self.seed, ids))
        center = r.below(self.num_centers)
        known, at = np.unique(center, return_inverse=True)
        base = self.centers(known)[at]
        shift = np.stack([r.symmetric() * np.float32(self.noise) for _ in range(self.d)], axis=1)
        return base + shift, center.astype(np.int64)

    def queries(self, n: int, numbers: np.ndarray, noise: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, targets): a vector of the data set, moved a little."""
        with np.errstate(over="ignore"):
            r = Streams(U(self.seed) ^ QUERY_SALT ^ np.asarray(numbers, U) * QUERY_STEP)
        target = r.below(n)
        shift = np.stack([r.symmetric() * np.float32(noise) for _ in range(self.d)], axis=1)
        return self.vectors(target)[0] + shift, target.astype(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x, np.float32).reshape(-1)))


def _table(rows: DataFrame, make, names: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at in range(0, len(ids), BLOCK):
                x, more = make(ids[at : at + BLOCK])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + BLOCK]), _lists(x), pa.array(more)], names)

    return rows.mapInArrow(run, f"{names[0]} long, embedding array<float>, {names[2]} long")


def vectors_of(ids: DataFrame, spec: DatasetSpec) -> DataFrame:
    """(id, embedding, center_id) of the ids of a one-column table: the vectors are made anew, not looked up."""
    return _table(ids, spec.vectors, ["id", "embedding", "center_id"])


def synthetic_vectors(spark: SparkSession, spec: DatasetSpec, n: int, start: int = 0) -> DataFrame:
    """(id, embedding, center_id); a lazy scan, generated where it is read."""
    return vectors_of(spark.range(start, start + n), spec)


def planted_queries(spark: SparkSession, spec: DatasetSpec, n: int, nq: int, noise: float = 0.02) -> DataFrame:
    """(qid, embedding, target_id)."""
    return _table(spark.range(nq), lambda ids: spec.queries(n, ids, noise), ["qid", "embedding", "target_id"])
