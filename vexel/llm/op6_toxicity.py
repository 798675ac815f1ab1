"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values.

1. Labelled training rows, at most ``SAMPLE`` by a hash of the id, are read once. Three of four count tokens in toxic and in other
   documents; the fourth calibrates.
2. A token's toxic share has a Dirichlet prior centred on the share of its first letters (PREFIX of them), whose own prior is centred
   on the overall share; so a rare form of a toxic stem counts as toxic, and a rare clean word doesn't. All tokens of the counting rows
   enter these sums. The log-odds of a token's share against the overall share, less PENALTY for being in a passage at all, are its score; below
   zero they count LEAK of that, as passages are mostly made of words that clean texts have too. So the expected score of clean text is negative.
   A token in fewer than MIN_DOCS documents has the log-odds of its prefix, one whose prefix is in fewer than 2 MIN_DOCS those of the prior: 0.
3. A linear scan over the scores of all tokens finds all maximal scoring segments: the disjoint passages whose score no extension or
   shortening would raise.
4. Clean calibration documents give the rate and scale of the extreme-value law of a document's best segment,
   ``P(S >= s) = 1 - exp(-K n exp(-rate s))``, by maximum likelihood. Passages whose surprise passes that law's ``SIGNIFICANT`` are reported; the surprise of the
   best one, through a logistic fitted on the calibration rows, is the document's score.

Defined results: null and empty texts have no passage; without toxic or without clean labels no token has a score and
every document scores 0; repeated labels count once (the largest); repeated rows get equal results; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, HELD, THRESHOLD = 40_000, 5, 0.5
PREFIX, STRENGTH, PENALTY, LEAK, MIN_DOCS, SIGNIFICANT = 4, 8.0, 1.5, 0.03, 4, 1e-3
EDGES = b".,;:!?\"'()[]{}*#%&$"


def tokens(text: str) -> list[bytes]:
    """Words without case (A-Z) and without punctuation at their ends."""
    return [w.strip(EDGES) for w in text.encode().lower().split()]


def token_score(odds: float) -> float:
    return (odds - PENALTY) * (1.0 if odds > PENALTY else LEAK)


@dataclass
class Lexicon:
    words: dict[bytes, float] = field(default_factory=dict)
    prefixes: dict[bytes, float] = field(default_factory=dict)

    @staticmethod
    def fit(rows: list[tuple[bytes, int, int]], toxic: int, clean: int, sums: dict[bytes, tuple[int, int]] | None = None) -> Lexicon:
        """rows: token, toxic and clean training documents that hold it; toxic and clean: how many there are.

        sums: the same two numbers of all tokens of a prefix; where they are given, rows may leave out tokens in fewer than MIN_DOCS documents.
        """
        if not toxic or not clean:
            return Lexicon()
        share = toxic / (toxic + clean)
        if sums is None:
            sums = {}
            for w, t, c in rows:
                if len(w) > PREFIX:
                    n = sums.get(w[:PREFIX], (0, 0))
                    sums[w[:PREFIX]] = (n[0] + t, n[1] + c)
        odds = lambda s: float(np.log(s / (1 - s)) - np.log(share / (1 - share)))
        mean = {p: (t + STRENGTH * share) / (t + c + STRENGTH) for p, (t, c) in sums.items()}
        prior = lambda w: mean[w[:PREFIX]] if len(w) > PREFIX else share
        words = {w: token_score(odds((t + STRENGTH * prior(w)) / (t + c + STRENGTH))) for w, t, c in rows if w and t + c >= MIN_DOCS}
        return Lexicon(words, {p: token_score(odds(mean[p])) for p, n in sums.items() if sum(n) >= 2 * MIN_DOCS})

    def scores(self, text: str) -> np.ndarray:
        """Scores of all tokens; without a lexicon none is above zero."""
        word, prefix, unseen = self.words.get, self.prefixes.get, token_score(0.0)
        found = ((word(w), w) for w in tokens(text))
        return np.array([prefix(w[:PREFIX], unseen) if s is None else s for s, w in found], float)


def best_segment(scores: np.ndarray) -> float:
    """The highest score of a segment; 0 if no token scores above zero."""
    if not len(scores):
        return 0.0
    total = np.cumsum(scores)
    lowest = np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
    return max(0.0, float((total - lowest).max()))


def maximal_segments(at: list[int], scores: list[float], gap: float | list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score).

    ``at`` and ``scores`` are the tokens that score above zero, in order; ``gap`` is what each other token costs, or a list of what all those
    between each of ``at`` and the one before it (or the beginning) cost.

    A list of candidates is kept with the cumulative score left of and at the end of each; a new hit is merged
    with the nearest candidate that begins lower, if that candidate ends lower. Each candidate is merged or passed once.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, end, left sum, right sum, index of nearest candidate with a lower left sum
    total, last = 0.0, 0
    for k, (place, score) in enumerate(zip(at, scores, strict=True)):
        total -= gap[k] if isinstance(gap, list) else gap * (place - last)
        last = place + 1
        first, end, left, right = place, place + 1, total, total + score
        total = right
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((first, end, left, right, j))
                break
            first, _, left, _, lower = found[j]
            del found[j:]
            j = lower
    return [(f, e, r - le) for f, e, le, r, _ in found]


def passages_of(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence of scores."""
    at = np.flatnonzero(scores > 0)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    before = np.concatenate([[0.0], total[at + 1][:-1]])
    return maximal_segments(at.tolist(), scores[at].tolist(), (before - total[at]).tolist())


@dataclass
class Calibration:
    """Extreme-value law of clean documents' best segments, and a logistic of the surprise."""

    rate: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    shift: float = -30.0

    @staticmethod
    def fit(best: np.ndarray, n: np.ndarray, y: np.ndarray) -> Calibration:
        if not len(y) or y.min() == y.max():
            return Calibration()
        clean = (y == 0) & (n > 0)
        c = Calibration()
        s, m = best[clean], n[clean].astype(float)
        if len(s):  # for each rate the likeliest k is known; of a grid of rates the likeliest counts
            fits = []
            for rate in np.geomspace(0.05, 4.0, 128):
                expect = m * np.exp(-rate * s)
                k = len(s) / expect.sum()
                fits.append((len(s) * np.log(k * rate) - (rate * s).sum() - k * expect.sum(), float(rate), float(k)))
            _, c.rate, c.k = max(fits)
        x = np.minimum(c.surprise(best, n), 60)
        w = np.array([-3.0, 0.5])
        a = np.stack([np.ones_like(x), x], axis=1)
        for _ in range(50):  # Newton steps with a small ridge, so separable rows keep it finite
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            grad = a.T @ (y - p) - 0.05 * w * np.array([0, 1])
            w = w + np.clip(np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag([1e-3, 0.05]), grad), -2, 2)
        c.shift, c.slope = float(w[0]), float(max(w[1], 0.0))
        return c

    def surprise(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-log of the chance that a clean document of n tokens has such a segment; 0 without one."""
        expect = self.k * np.maximum(n, 1) * np.exp(-self.rate * best)
        return np.where(best > 0, -np.log(-np.expm1(-np.minimum(expect, 50)) + 1e-300), 0.0)

    def score(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.shift + self.slope * np.minimum(self.surprise(best, n), 60), -40, 40)))


def _token_rows(batches):
    """(token, toxic documents, other documents) of a batch's documents, summed."""
    for batch in batches:
        counts: dict[bytes, list[int]] = {}
        for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
            for w in set(tokens(text.as_py())):
                counts.setdefault(w, [0, 0])[0 if y else 1] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())], ["token", "t", "c"])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    calibration: Calibration

    def best(self, text: str) -> tuple[float, int]:
        scores = self.lexicon.scores(text)
        return best_segment(scores), len(scores)

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Significant passages: first token, end, surprise."""
        scores = self.lexicon.scores(text)
        out = [(f, e, float(self.calibration.surprise(np.array([s]), np.array([len(scores)]))[0])) for f, e, s in passages_of(scores)]
        return [x for x in out if x[2] >= -np.log(SIGNIFICANT)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    known = common.labelled_sample(labels, "toxic", HELD, sample)
    common.small_batches(docs.sparkSession)
    rows = common.materialize(common.texts(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y"), "labelled")  # at most ``sample`` texts and their repeats
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4))
    sizes = {r[0]: r[1] for r in rows.where(fold > 0).groupBy((F.col("y") > 0).cast("int")).count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counted = rows.where(fold > 0).select("text", "y").mapInArrow(_token_rows, "token binary, t long, c long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # every token counts for its prefix; what is collected is bounded by the sample: tokens and prefixes in several of its documents
    prefix = F.when(F.length("token") > PREFIX, F.substring("token", 1, PREFIX))
    counted = common.materialize(counted, "counts")
    sums = counted.select(prefix.alias("prefix"), "t", "c").where("prefix is not null").groupBy("prefix").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") + F.col("c") >= MIN_DOCS)
    sums = {bytes(r.prefix): (r.t, r.c) for r in sums.collect()}
    kept = sorted((bytes(r.token), r.t, r.c) for r in counted.where(F.col("t") + F.col("c") >= MIN_DOCS).collect())
    lexicon = Lexicon.fit(kept, toxic, clean, sums)
    model = ToxicityModel(lexicon, Calibration())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            got = [shared.value.best(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), batch.column("y")], ["best", "n", "y"])

    seen = rows.where(fold == 0).select("text", "y").mapInArrow(measure, "best double, n long, y int").collect()  # a quarter of the sample, three numbers each
    seen.sort(key=tuple)
    model.calibration = Calibration.fit(np.array([r.best for r in seen]), np.array([r.n for r in seen]), np.array([float(r.y > 0) for r in seen]))
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages (first token, end, surprise) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    common.small_batches(docs.sparkSession)
    passage = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())]))

    def run(batches):
        use = shared.value
        for batch in batches:
            all_of = [t.as_py() for t in batch.column("text")]
            got = [use.best(t) for t in all_of]
            s = use.calibration.score(np.array([g[0] for g in got], float), np.array([g[1] for g in got], float))
            far = use.calibration.surprise(np.array([g[0] for g in got], float), np.array([g[1] for g in got], float)) >= -np.log(SIGNIFICANT)  # else no passage is significant
            found = [[dict(zip(("first", "end", "surprise"), p, strict=True)) for p in use.passages(t)] if f else [] for t, f in zip(all_of, far, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(found, passage)], ["doc_id", "held_out", "score", "predicted", "passages"]
            )

    rows = common.texts(docs).withColumn("held_out", common.held_out(HELD))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first:int,end:int,surprise:double>>")


def reject_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs without the rows whose score reaches THRESHOLD; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    common.small_batches(docs.sparkSession)

    def run(batches):
        use = shared.value
        for batch in batches:
            got = [use.best(t or "") for t in batch.column("text").to_pylist()]
            s = use.calibration.score(np.array([g[0] for g in got], float), np.array([g[1] for g in got], float))
            yield batch.filter(pa.array(s < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train(docs, common.table(spark, sf_dir, "labels")))
