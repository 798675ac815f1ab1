"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles of the training rows. Cyclic boosting goes round the features; each step
grows a shallow tree (depth two) over one feature's bins against the logistic loss and adds it, shrunk, to that
feature's lookup table. Then the pairs of features whose joint table takes most of the remaining gradient are chosen and
boosted in turn with depth-two trees over both. A score is the logistic of a sum of table entries, read by vectorised
bin numbers.

Features of all documents are computed once from whole texts and kept in a narrow table in the shared folder; labels join that,
never the texts. The model is fitted on at most ``SAMPLE`` labelled training rows, chosen by a hash of the id.

Defined results: null and empty texts have the features of an empty text; repeated labels count once (the largest); without any label
of one of the classes, every score is the share of the label among training rows (0.5 without rows); repeated rows get equal scores;
an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .features import NAMES, features

SAMPLE = 30_000
BINS, PAIR_BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, SMOOTH = 48, 8, 60, 6, 40, 0.3, 5.0
THRESHOLD, HELD = 0.3, 5


def _tree(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Depth-two regression tree over ordered bins: value of each bin (Newton steps, smoothed)."""

    def split(a, b):
        g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
        gain = g[:-1] ** 2 / (h[:-1] + SMOOTH) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + SMOOTH)
        return a + 1 + int(gain.argmax())

    edges = {0, len(grad)}
    for _ in range(2):
        e = sorted(edges)
        edges |= {split(a, b) for a, b in zip(e, e[1:], strict=False) if b - a > 1}
    e = sorted(edges)
    sums = [np.add.reduceat(x, e[:-1]) for x in (grad, hess)]
    return np.repeat(sums[0] / (sums[1] + SMOOTH), np.diff(e))


def _pair_tree(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """One cut of each feature: four leaves, the best of all such trees."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    quarters = lambda x: (x[:-1, :-1], x[:-1, -1:] - x[:-1, :-1], x[-1:, :-1] - x[:-1, :-1], x[-1, -1] - x[:-1, -1:] - x[-1:, :-1] + x[:-1, :-1])
    gain = sum(a**2 / (b + SMOOTH) for a, b in zip(quarters(g), quarters(h), strict=True))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(grad)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = grad[rows, cols].sum() / (hess[rows, cols].sum() + SMOOTH)
    return out


@dataclass
class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = float(y.mean()) if len(y) else 0.5
        if not len(y) or not 0 < share < 1:
            return AdditiveModel(base=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
        m = AdditiveModel(base=float(np.log(share / (1 - share))))
        cut = lambda c, k: np.unique(np.quantile(c, np.linspace(0, 1, k + 1)[1:-1]))
        m.edges = [cut(c, BINS) for c in x.T]
        m.coarse = [cut(c, PAIR_BINS) for c in x.T]
        bins = m._bins(x, m.edges)
        m.tables = [np.zeros(len(e) + 1) for e in m.edges]
        raw = np.full(len(y), m.base)

        def push(places, size, shape, grow, table):
            p = 1 / (1 + np.exp(-raw))
            step = RATE * grow(np.bincount(places, y - p, size).reshape(shape), np.bincount(places, p * (1 - p), size).reshape(shape))
            table += step
            np.add(raw, step.reshape(-1)[places], out=raw)

        for _ in range(ROUNDS):
            for k, table in enumerate(m.tables):
                if len(table) > 1:
                    push(bins[k], len(table), len(table), _tree, table)
        crude, gains = m._bins(x, m.coarse), []
        sizes = [len(e) + 1 for e in m.coarse]
        p = 1 / (1 + np.exp(-raw))
        for i in range(len(sizes)):
            for j in range(i):
                place, size = crude[i] * sizes[j] + crude[j], sizes[i] * sizes[j]
                if min(sizes[i], sizes[j]) > 1:
                    g, h = np.bincount(place, y - p, size), np.bincount(place, p * (1 - p), size)
                    gains.append((float((g**2 / (h + SMOOTH)).sum()), i, j))
        for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
            m.pairs.append((i, j))
            m.pair_tables.append(np.zeros((sizes[i], sizes[j])))
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in zip(m.pairs, m.pair_tables, strict=True):
                push(crude[i] * sizes[j] + crude[j], table.size, table.shape, _pair_tree, table)
        return m

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        if self.tables:
            for table, b in zip(self.tables, self._bins(x, self.edges), strict=True):
                raw += table[b]
            crude = self._bins(x, self.coarse)
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                raw += table[crude[i], crude[j]]
        return 1 / (1 + np.exp(-raw))


def _feature_batches(batches):
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column("text")]
        flat = np.array(rows, np.float32).reshape(-1, len(NAMES))
        ends = np.arange(0, flat.size + 1, len(NAMES), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.reshape(-1)))], ["doc_id", "x"])


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and x: array<float> in the order of NAMES."""
    common.small_batches(docs.sparkSession)
    return common.texts(docs).mapInArrow(_feature_batches, "doc_id long, x array<float>")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    spark = docs.sparkSession
    measured = common.materialize(document_features(docs), "features")
    known = common.labelled_sample(labels, "quality", HELD, sample)
    # of an id in several rows the least features count; at most ``sample`` rows
    rows = measured.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([r.x for r in rows], np.float32).reshape(-1, len(NAMES))
    model = spark.sparkContext.broadcast(AdditiveModel.fit(x, np.array([float(r.y > 0) for r in rows])))

    def run(batches):
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            s = model.value.score(flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return measured.select("doc_id", common.held_out(HELD).alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
