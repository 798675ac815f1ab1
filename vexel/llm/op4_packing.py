"""Best-fit packing of token sequences by fitted length patterns.

1. Each document becomes its ids and an end id, cut into pieces of at most CAPACITY ids; only the first piece may be
   shorter. Pieces are rows of a few numbers; ids don't leave the task.
2. The histogram of piece lengths (at most CAPACITY numbers, whatever the input) goes to the driver.
3. Every pair and triple of occurring lengths that fills a sequence exactly is a pattern. Non-negative least squares fits
   repeat counts of the patterns to the histogram (accelerated projected gradient on the sparse pattern matrix);
   the counts are rounded, never beyond what the histogram holds.
4. What rounding leaves over is packed by best-fit decreasing, still as counts of lengths.
5. The n-th piece of a length takes the n-th place that the plan has for the length. Places are numbered within
   (length, bucket) and shifted by prefix sums, so a length that a third of all pieces share is no hot group.

Defined results: null and empty texts are one piece that holds the end id; pieces of equal length are
numbered by (bucket, doc_id, piece, crc), nulls first; repeated rows get places of their own; an empty table gives none.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY, END = 1024, 2
#: Pieces numbered in one window partition, about.
BUCKET = 20_000
SPECIAL = "<|endoftext|>"


class ByteTokenizer:
    """ids of byte_bpe_50k. A text is encoded in one call: where texts bring new words all along, a memo of words costs more than it saves."""

    def __init__(self, ranks_path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.own = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})

    def packed(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        return self.own.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=1)
def tokenizer() -> ByteTokenizer:
    return ByteTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece boundaries of a document of n ids."""
    return [0, *range(n % capacity or capacity, n + 1, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _piece_batches(batches):
    use = tokenizer()
    end = np.array([END], "<u4").tobytes()
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = use.packed(text.as_py()) + end
            at = cuts(len(ids) // 4)
            rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Pairs and triples of occurring lengths that fill a sequence exactly, as rows of three (0: unused)."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    a = lengths[(lengths * 2 <= capacity)]
    pairs = np.stack([a, capacity - a, np.zeros_like(a)], axis=1)[have[capacity - a]]
    x, y = np.meshgrid(a, lengths, indexing="ij")
    z = capacity - x - y
    ok = (x <= y) & (y <= z)
    x, y, z = x[ok], y[ok], z[ok]
    ok = have[z]
    return np.concatenate([pairs, np.stack([x[ok], y[ok], z[ok]], axis=1)]).astype(np.int64)


def fit(rows: np.ndarray, histogram: np.ndarray, weights: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative repeat counts whose lengths come closest to the histogram in weighted least squares."""
    n = len(histogram)
    use = (rows > 0) * weights[rows]
    histogram = histogram * weights
    times = lambda x: sum(np.bincount(rows[:, k], x * use[:, k], n) for k in range(3))
    back = lambda r: sum(r[rows[:, k]] * use[:, k] for k in range(3))
    x = v = np.zeros(len(rows))
    probe = np.ones(len(rows))
    for _ in range(20):
        probe = back(times(probe))
        probe /= max(size := np.linalg.norm(probe), 1e-12)
    rate, t = 1 / max(1.02 * size, 1e-12), 1.0
    for _ in range(steps):
        new = np.maximum(0, v - rate * back(times(v) - histogram))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, x = new + (last - 1) / t * (new - x), new
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts of lengths: (contents, repeats)."""
    free: dict[int, list[list]] = {}  # room left: [contents, repeats]
    rooms: list[int] = []
    done = []

    def put(room, contents, n):
        if not room:
            done.append((contents, n))
            return
        if room not in free:
            free[room] = []
            insort(rooms, room)
        free[room].append([contents, n])

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length  # of one length only: as many as go in
                if n >= per:
                    put(capacity - per * length, (length,) * per, n // per)
                    n %= per
                else:
                    put(capacity - n * length, (length,) * n, 1)
                    n = 0
                continue
            room = rooms[at]
            group = free[room][-1]
            take = min(n, group[1])
            group[1] -= take
            if not group[1]:
                free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(at)
            put(room - length, (*group[0], length), take)
            n -= take
    return done + [(g[0], g[1]) for groups in free.values() for g in groups]


def rounded(rows: np.ndarray, x: np.ndarray, left: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeats of the patterns, never beyond what the histogram holds, and what is left of it."""
    out, left = [], left.copy()
    for k in np.argsort(-x, kind="stable"):
        n = int(np.rint(x[k]))
        if n < 1:
            break
        contents = tuple(int(c) for c in rows[k] if c)
        n = min(n, *(int(left[c]) // contents.count(c) for c in contents))
        if n:
            out.append((contents, n))
            for c in contents:
                left[c] -= n
    return out, left


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(contents, repeats): together they hold every piece of the histogram.

    Fits with equal weights and with weights by length, each rounded whole and in parts, are tried; the one with the fewest sequences counts.
    """
    left = histogram.astype(np.int64).copy()
    full = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    rows = patterns(np.flatnonzero(left), capacity)
    tries = []
    if len(rows):
        for weights in (np.ones(capacity + 1), (np.arange(capacity + 1) / capacity) ** 2):
            x = fit(rows, left.astype(float), weights)
            for part in (1.0, 0.8, 0.5, 0.2):
                some, rest = rounded(rows, part * x, left)
                tries.append(some + best_fit(rest, capacity))
    return full + min(tries or [best_fit(left, capacity)], key=lambda t: sum(n for _, n in t))


def places(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: rank r of a length is in the last row not beyond it."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for contents, n in planned:
        offset = 0
        for c in contents:
            out.append((c, used.get(c, 0), sequence, offset))
            used[c] = used.get(c, 0) + n
            offset += c
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def cut_documents(docs: DataFrame) -> DataFrame:
    """PIECES of every document."""
    common.small_batches(docs.sparkSession)
    return common.texts(docs).mapInArrow(_piece_batches, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """PIECES, sequence_id and offset."""
    spark = docs.sparkSession
    pieces = common.materialize(cut_documents(docs), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[r[0]] = r[1]
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity)))  # bounded by the patterns, not by the input
    buckets = max(1, -(-int(histogram.sum()) // BUCKET))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = pieces.withColumn("place", F.row_number().over(own) - 1).join(shift, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("shift")).alias("rank"))

    def assign(batches):
        rows = table.value
        keys = rows[:, 0] << 50 | rows[:, 1] if len(rows) else np.zeros(0, np.int64)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 50 | rank, side="right") - 1
            cols = [*batch.columns[:5], pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(assign, PIECES + ", sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
