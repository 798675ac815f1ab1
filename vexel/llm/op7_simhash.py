"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits; two link if at most DISTANCE of them differ. The bits are split into BLOCKS blocks; of these at
least BLOCKS - DISTANCE are equal in a close pair, so every set of that many blocks is a join key and each close pair meets on one.
Equal fingerprints are one node, whatever the number of their documents.

* A key with up to DENSE fingerprints is solved in place: sorted by key, all pairs of a run are compared by exclusive-or
  and bit count, and joined at once, so only links of a spanning forest leave the task, never all pairs.
* Fingerprints that share a key with more than DENSE others are linked through centres: two fingerprints differ in at most
  four bits just when some value is within two bits of both. Each such fingerprint is dealt to all values within
  two bits (2081 rows); all that meet at a value are within four bits of each other, so linking them to the least is exact, and the
  work grows with their number, not its square.

Components of the links then give each document the least doc_id that it can reach.

Defined results: null and empty texts and those without words have fingerprint zero, linked like any other; texts of fewer than
SHINGLE words have one shingle; a bit set in exactly half the shingles counts as not set; null ids take part, and count
only where a component has no other id (then component_id is null); repeated rows get equal results; an empty table gives none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SHINGLE, SEED, DISTANCE, BLOCKS = 4, 42, 4, 6
DENSE = 2048
#: Compared rows held at once.
STEP = 1 << 16


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        values = [hashed(b" ".join(words), SEED)]
    else:
        values = [hashed(b" ".join(w), SEED) for w in zip(*(words[k:] for k in range(SHINGLE)), strict=False)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(values), STEP):
        part = np.array(values[at : at + STEP], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprint_batches(batches):
    for batch in batches:
        found = [fingerprint(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("th"), pa.array(found, pa.int64())], ["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed integer)."""
    return _marked(docs).drop("th")


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text; null: that of the empty one) and fp."""
    common.small_batches(docs.sparkSession)
    rows = common.texts(docs).withColumn("th", F.xxhash64("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, th long, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """For each set of blocks - distance blocks, the mask of their bits (signed)."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << ends[k + 1]) - 1) ^ ((1 << ends[k]) - 1) for k in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(one[k] for k in c)) for c in combinations(range(blocks), blocks - distance)]


def block_keys(nodes: DataFrame) -> DataFrame:
    """(fp, block set, key) of each fingerprint."""
    masks = F.array(*(F.lit(m) for m in block_masks()))
    return nodes.select("fp", F.posexplode(masks).alias("part", "mask")).select("fp", "part", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _forest(a: np.ndarray, b: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row a, row b) as links of each row to the least fingerprint that it reaches."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = inverse[: len(a)], inverse[len(a) :]
    order = np.argsort(fp[nodes], kind="stable")
    root = np.empty(len(nodes), np.int64)
    root[order] = np.arange(len(nodes))  # a node's number is the rank of its fingerprint
    a, b = root[a], root[b]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (deeper := new[new] < new).any():
            new = np.where(deeper, new[new], new)
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    ranked = fp[nodes][order]
    moved = label != np.arange(len(nodes))
    return ranked[moved], ranked[label[moved]]


def _close_runs(batches):
    """Rows sorted by (part, key) -> links of each run's spanning forest. A run may cross batches."""
    names, kept = ["a", "b"], None

    def solve(part, key, fp):
        run = np.concatenate([[True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
        number = np.cumsum(run)
        left, right, waiting = [], [], 0
        rows = np.arange(len(fp))
        gap = 1
        while len(rows := rows[rows + gap < len(fp)]):
            rows = rows[number[rows + gap] == number[rows]]
            close = rows[np.bitwise_count((fp[rows] ^ fp[rows + gap]).view(np.uint64)) <= DISTANCE]
            left.append(close)
            right.append(close + gap)
            waiting += len(close)
            if waiting > 1 << 21:  # fold what is linked so far
                a, b = np.concatenate(left), np.concatenate(right)
                keep = np.unique(np.stack([a, b]), axis=1)
                a, b = _forest(keep[0], keep[1], fp)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names)
                left, right, waiting = [], [], 0
            gap += 1
        if waiting:
            a, b = _forest(np.concatenate(left), np.concatenate(right), fp)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names)

    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "key", "fp")]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        n = len(cols[0])
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) if n else np.zeros(0, bool)
        cut = n - int(same.sum())
        kept = [c[cut:] for c in cols]
        if cut:
            yield from solve(*(c[:cut] for c in cols))
    if kept is not None and len(kept[0]):
        yield from solve(*kept)


def _centre_batches(batches):
    """(centre, fp) for every value within two bits of fp."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    masks = np.concatenate([[np.uint64(0)], one, [one[i] | one[j] for i, j in combinations(range(64), 2)]]).astype(np.uint64)
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 256):
            part = fp[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).reshape(-1).view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], ["centre", "fp"])


def close_links(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that have the components of all pairs within DISTANCE bits."""
    keys = common.materialize(block_keys(nodes), "blocks")
    sizes = keys.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.join(sizes, ["part", "key"])
    sparse = shared.where(F.col("n") <= dense).select("part", "key", "fp").repartition("part", "key").sortWithinPartitions("part", "key")
    links = sparse.mapInArrow(_close_runs, "a long, b long")
    crowd = shared.where(F.col("n") > dense).select("fp").distinct()
    centres = crowd.mapInArrow(_centre_batches, "centre long, fp long")
    least = centres.groupBy("centre").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    through = crowd.mapInArrow(_centre_batches, "centre long, fp long").join(least, "centre").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()
    return links.unionByName(through).distinct()


def near_duplicates(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint, component_id for every document."""
    found = common.materialize(fingerprints(docs), "fingerprints")
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(close_links(nodes.select("fp"), dense))
    labelled = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of = labelled.join(ids, "component").select("fp", "component_id")
    return found.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least id (nulls last), of an id with several texts that of the least hash.

    A row that is repeated with id and text stays once, whichever of its other columns come first. Rows without an id are in groups too.
    """
    found = common.materialize(_marked(docs), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    nodes = found.groupBy("fp").agg(F.min(place).alias("least"))
    parts = connected_components(close_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    kept = nodes.join(parts, "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("least").alias("least")).select("least.doc_id", "least.th")
    times = found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toDF("_vexel_id", "_vexel_th", "_vexel_n")
    kept = kept.join(times, kept["doc_id"].eqNullSafe(times["_vexel_id"]) & (kept["th"] == times["_vexel_th"]), "left").select("doc_id", "th", "_vexel_n").toDF("_vexel_id", "_vexel_th", "_vexel_n")
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_vexel_id"]) & (text == kept["_vexel_th"]))
    once = joined.where("_vexel_n is null").select(*(docs[c] for c in docs.columns))
    # rows that are repeated whole: one of each (few kinds, so these alone are dealt again)
    again = joined.where("_vexel_n is not null").dropDuplicates(["_vexel_id", "_vexel_th"]).select(*(docs[c] for c in docs.columns))
    return once.unionByName(again)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
