"""LM scoring: a log-bilinear model, trained in numpy by noise-contrastive estimation.

The model's classes are the most frequent words, the end of a text and BUCKETS groups of the other words (by their first two bytes).
The vectors of the CONTEXT classes before a token, each scaled by its position, add up to a prediction; its products
with all class vectors, normalised over all classes, give the class's probability. A word of a group has the
probability of its group times its smoothed share of it, so the probabilities of all words add up to one.

1. Count the tokens of all training texts (summed by task before the shuffle).
2. Train on all training texts. They are dealt by a hash of id and text to shards of about SHARD tokens, and the shards to ROUNDS rounds. In each round every
   shard makes one pass over its texts, in the order of their ids, by noise-contrastive estimation from the round's start; the shards'
   parameters are averaged, weighted by their tokens (summed by Spark, parameter by parameter), and are the next round's start. So
   neither the layout of the table nor the cluster has a part in the model.
3. Score all texts. Words of HEAD, a table bounded by its entries and their length, are scored in the task; the counts of
   all others come from a join on the word, so no vocabulary that grows with the input is sent around.

Defined results: null and empty texts are one end token; without training texts every token has base 0.1/0.1; a text's context
begins with end tokens; repeated rows are scored each; an empty table gives none.

The classes are few beside the vocabulary, as each token's probability is normalised over all of them: words beyond the WORDS most frequent have no vector of their own.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HELD = 10
WORDS, BUCKETS, HEAD, LONGEST = 447, 64, 150_000, 64
DIM, CONTEXT, NOISE, BATCH, BLOCK, RATE = 16, 4, 24, 4096, 512, 0.15
CLASSES = WORDS + 1 + BUCKETS
END = WORDS
SHARD, ROUNDS = 1 << 21, 4
#: Words a task gathers before it counts them and passes the sums on.
FLUSH = 4_000_000


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, int]:
    """Words with A-Z lower-cased, the number of each one's text, and the number of texts; an end (an empty word) follows each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some).cast(pa.binary()), text[some.to_numpy(zero_copy_only=False)], len(texts)


def bucket(word: bytes) -> int:
    return zlib.crc32(word[:2]) % BUCKETS


@dataclass
class Parameters:
    """Class vectors as context (r) and as prediction (q), position scales (c), biases (b)."""

    r: np.ndarray
    q: np.ndarray
    c: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(unigram: np.ndarray) -> Parameters:
        rng = np.random.default_rng(7)
        return Parameters(
            rng.normal(0, 0.3, (CLASSES, DIM)).astype(np.float32), rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32), np.full((CONTEXT, DIM), 0.6, np.float32), np.log(unigram).astype(np.float32)
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in (self.r, self.q, self.c, self.b)]).astype(np.float64)

    @staticmethod
    def of(flat: np.ndarray) -> Parameters:
        ends = np.cumsum([CLASSES * DIM, CLASSES * DIM, CONTEXT * DIM])
        r, q, c, b = np.split(flat.astype(np.float32), ends)
        return Parameters(r.reshape(CLASSES, DIM), q.reshape(CLASSES, DIM), c.reshape(CONTEXT, DIM), b)

    def predict(self, contexts: np.ndarray) -> np.ndarray:
        """Predicted vectors of rows of CONTEXT classes, nearest first."""
        return sum((self.r * self.c[j])[contexts[:, j]] for j in range(CONTEXT))

    def log_probability(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of the normalised probability of each target."""
        out = np.empty(len(targets))
        wide = np.concatenate([self.q, self.b[:, None]], axis=1).T.copy()
        tables = [self.r * self.c[j] for j in range(CONTEXT)]
        guess = np.ones((BLOCK, DIM + 1), np.float32)
        # a bound of every exponent, so that single precision can't overflow
        far = sum(float(np.abs(t).max()) for t in tables) * float(np.abs(self.q).sum(1).max()) + float(np.abs(self.b).max()) > 80
        for at in range(0, len(targets), BLOCK):
            rows, t = contexts[at : at + BLOCK], targets[at : at + BLOCK]
            g = guess[: len(t)]
            g[:, :DIM] = tables[0][rows[:, 0]]
            for j in range(1, CONTEXT):
                g[:, :DIM] += tables[j][rows[:, j]]
            logits = g @ wide
            own = logits[np.arange(len(t)), t].astype(np.float64)
            if far:
                top = logits.max(axis=1, keepdims=True)
                logits -= top
                own -= top[:, 0]
            np.exp(logits, out=logits)
            out[at : at + BLOCK] = own - np.log(logits.sum(axis=1))
        return out


class Trainer:
    """Noise-contrastive estimation with one set of noise classes for each batch, and Adagrad."""

    def __init__(self, start: Parameters, unigram: np.ndarray, seed: int = 11):
        self.p = Parameters(*(x.copy() for x in (start.r, start.q, start.c, start.b)))
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)
        self.cum = np.cumsum(unigram)
        self.rng = np.random.default_rng(seed)
        self.seen = 0
        self.power = [np.full_like(x, 0.1) for x in (self.p.r, self.p.q, self.p.c, self.p.b)]

    def step(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        p, n = self.p, len(targets)
        guess = p.predict(contexts)
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE) * self.cum[-1]), CLASSES - 1)
        data = 1 / (1 + np.exp((guess * p.q[targets]).sum(1) + p.b[targets] - self.log_noise[targets]))
        false = -1 / (1 + np.exp(-(guess @ p.q[noise].T + p.b[noise] - self.log_noise[noise])))
        d_guess = data[:, None] * p.q[targets] + false @ p.q[noise]
        d_q = self.scatter([targets], (data[:, None] * guess).T)[0]
        np.add.at(d_q, noise, false.T @ guess)
        d_b = np.bincount(targets, data, CLASSES) + np.bincount(noise, false.sum(0), CLASSES)
        by_place = self.scatter([contexts[:, j] for j in range(CONTEXT)], d_guess.T)  # summed by class for each position
        d_r = (by_place * p.c[:, None, :]).sum(0)
        d_c = (by_place * p.r).sum(1)
        for x, d, power in zip((p.r, p.q, p.c, p.b), (d_r, d_q, d_c, d_b), self.power, strict=True):
            d = (d / n).astype(np.float32) * 20
            power += d * d
            x += RATE * d / np.sqrt(power)
        self.seen += n

    @staticmethod
    def scatter(rows: list[np.ndarray], values: np.ndarray) -> np.ndarray:
        """For each array of classes, the sums of the values (DIM x tokens) by class."""
        out = np.empty((len(rows), CLASSES, DIM), np.float32)
        values = np.ascontiguousarray(values, np.float64)
        for j, of in enumerate(rows):
            for k in range(DIM):
                out[j, :, k] = np.bincount(of, values[k], CLASSES)
        return out


class Vocabulary:
    """Words of HEAD with their training counts and classes; sums of the groups."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, groups: np.ndarray):
        head = sorted(head, key=lambda x: (-x[1], x[0]))
        ends = next((c for w, c in head if not w), 0)
        words = [(w, c) for w, c in head if w]
        self.head = pa.array([w for w, _ in words], pa.binary())  # the end comes after the last
        self.counts = np.array([c for _, c in words] + [ends], np.float64)
        self.classes = np.array([k if k < WORDS else WORDS + 1 + bucket(w) for k, (w, _) in enumerate(words)] + [END], np.int32)
        self.total, self.distinct = total, distinct
        self.base = np.log10(total + 0.1 * (distinct + 1))
        sums = groups.astype(np.float64).copy()  # rows: tokens, distinct words; the frequent words leave their groups
        for w, c in words[:WORDS]:
            sums[0, bucket(w)] -= c
            sums[1, bucket(w)] -= 1
        self.share = np.log10(sums[0] + 0.1 * (sums[1] + 1))
        self.unigram = np.concatenate([self.counts[:-1][:WORDS], np.zeros(max(0, WORDS - len(words))), [ends], sums[0]]) + 0.5
        self.unigram /= self.unigram.sum()

    def look_up(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places in HEAD (-1: elsewhere) and classes of words."""
        at = pc.fill_null(pc.index_in(flat, value_set=self.head), -1).to_numpy(zero_copy_only=False)
        classes = self.classes[at]
        rest = np.flatnonzero(at < 0)
        start = pc.binary_slice(flat.take(pa.array(rest)), 0, 2).dictionary_encode()
        groups = np.array([WORDS + 1 + bucket(w) for w in start.dictionary.to_pylist()] or [0], np.int32)
        classes[rest] = groups[start.indices.to_numpy(zero_copy_only=False)]
        return at, classes

    def sequence(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """words, the text of each, and, with an end after each text: place in HEAD and class of each token, and each text's length."""
        flat, text, n = words_of(texts)
        own_at, own_classes = self.look_up(flat)
        lengths = np.bincount(text, minlength=n) + 1
        at = np.full(len(flat) + n, len(self.head), np.int64)
        classes = np.full(len(flat) + n, END, np.int32)
        place = np.arange(len(flat)) + text
        at[place], classes[place] = own_at, own_classes
        return flat, text, at, classes, lengths


def contexts_of(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of the CONTEXT classes before each token, nearest first; END before a text's first token."""
    out = np.full((len(classes), CONTEXT), END, np.int32)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(classes)) - first
    for j in range(CONTEXT):
        rows = np.flatnonzero(place > j)
        out[rows, j] = classes[rows - j - 1]
    return out


def _count_batches(batches):
    kept: list[pa.Array] = []
    texts = 0

    def rows():
        c = pc.value_counts(pa.chunked_array(kept, pa.binary()))
        return pa.RecordBatch.from_arrays([c.field(0), c.field(1)], ["token", "c"])

    for batch in batches:
        flat, _, n = words_of(batch.column("text"))
        kept.append(flat)
        texts += n
        if sum(map(len, kept)) > FLUSH:
            yield rows()
            kept.clear()
    if kept:
        yield rows()
    yield pa.RecordBatch.from_arrays([pa.array([b""] * (texts > 0), pa.binary()), pa.array([texts] * (texts > 0), pa.int64())], ["token", "c"])


def token_counts(train: DataFrame) -> DataFrame:
    """(token, c) over all training texts; the end is the empty token."""
    return train.select("text").mapInArrow(_count_batches, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    group = (F.crc32(F.substring("token", 1, 2)) % BUCKETS).cast("int")
    step = F.floor(F.log2("c") * 16).cast("int")
    sums = counts.groupBy((F.length("token") == 0).alias("end"), group.alias("g")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    groups = np.zeros((2, BUCKETS), np.int64)
    total = distinct = 0
    for r in sums:
        total, distinct = total + r.c, distinct + r.v
        if not r.end:
            groups[:, r.g] += (r.c, r.v)
    short = counts.where(F.length("token") <= LONGEST)
    have, least = 0, 1 << 40
    for r in sorted(short.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("m")).collect(), key=lambda r: -r.s):
        have += r.n
        if have > HEAD:
            break
        least = r.m
    head = short.where((F.col("c") >= least) | (F.length("token") == 0)).collect()  # at most HEAD + 1 words of at most LONGEST bytes
    return Vocabulary([(bytes(r.token), r.c) for r in head], total, distinct, groups)


def encoded(train: DataFrame, words: Vocabulary) -> DataFrame:
    """shard, doc_id, h (hash of the text) and the text's classes, each two bytes, of every training text, written to the shared folder."""
    shared = train.sparkSession.sparkContext.broadcast(words)
    shards = max(ROUNDS, -(-words.total // SHARD))

    def run(batches):
        for batch in batches:
            classes, lengths = shared.value.sequence(batch.column("text"))[3:]
            ends = np.concatenate([[0], np.cumsum(lengths)]) * 2
            flat = pa.py_buffer(classes.astype("<u2").tobytes())
            packed = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64)), flat]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "doc_id", "h")), packed], ["shard", "doc_id", "h", "classes"])

    rows = train.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return common.materialize(rows.mapInArrow(run, "shard long, doc_id long, h long, classes binary"), "encoded")


def _train_shard(shared):
    def run(key, table):
        unigram, start = shared.value
        trainer = Trainer(start, unigram, 11 + key[0].as_py())
        table = table.sort_by([("doc_id", "ascending"), ("h", "ascending")])
        parts = [np.frombuffer(x.as_py(), "<u2").astype(np.int32) for x in table.column("classes")]
        targets = np.concatenate(parts)
        contexts = contexts_of(targets, np.array([len(x) for x in parts]))
        order = trainer.rng.permutation(len(targets))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            trainer.step(contexts[part], targets[part])
        flat = trainer.p.flat() * trainer.seen
        return pa.table({"k": pa.array(np.arange(len(flat))), "x": pa.array(flat), "w": pa.array(np.full(len(flat), float(trainer.seen)))})

    return run


def train_model(train: DataFrame, words: Vocabulary) -> Parameters:
    texts = encoded(train, words)
    model = Parameters.start(words.unigram)
    for turn in range(ROUNDS):
        shared = train.sparkSession.sparkContext.broadcast((words.unigram, model))
        trained = texts.where(F.col("shard") % ROUNDS == turn).groupBy("shard").applyInArrow(_train_shard(shared), "k long, x double, w double")
        rows = trained.groupBy("k").agg((F.sum("x") / F.sum("w")).alias("x")).collect()  # one row for each parameter
        if rows:
            flat = np.empty(len(rows))
            for r in rows:
                flat[r.k] = r.x
            model = Parameters.of(flat)
    return model


def _score_batches(shared):
    def run(batches):
        use, model = shared.value
        tail = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int32())]))
        for batch in batches:
            flat, text, at, classes, lengths = use.sequence(batch.column("text"))
            if not len(lengths):
                continue
            score = model.log_probability(contexts_of(classes, lengths), classes) / np.log(10)
            grouped = classes > END
            score -= np.where(grouped, use.share[np.maximum(classes - END - 1, 0)], 0)
            known = at >= 0
            own = np.where(known, np.log10(use.counts[at] + 0.1), 0)
            score += np.where(grouped, own, 0)
            first = np.cumsum(lengths) - lengths
            total = lambda x: pa.array(np.add.reduceat(x, first).astype(float))
            rest = np.flatnonzero(at[np.arange(len(flat)) + text] < 0)
            coded = flat.take(pa.array(rest)).dictionary_encode()
            size = max(1, len(coded.dictionary))
            pairs, n = np.unique(text[rest] * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(lengths) + 1) * size).astype(np.int32)
            items = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % size)), pa.array(n.astype(np.int32))], fields=list(tail.value_type))
            rests = pa.ListArray.from_arrays(pa.array(ends), items, type=tail)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(lengths.astype(np.int64)), total(known & (use.counts[at] > 0)), total(own - use.base), total(score), rests],
                ["doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score", "tail"],
            )

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = common.texts(docs).withColumn("held_out", common.held_out(HELD))
    train = docs.where(~F.col("held_out"))
    counts = common.materialize(token_counts(train), "counts")
    words = vocabulary(counts)
    shared = spark.sparkContext.broadcast((words, train_model(train, words)))
    schema = "doc_id long, held_out boolean, n_tokens long, head_known double, head_base double, head_score double, tail array<struct<token:binary,n:int>>"
    # written with a number for each row, so that repeated ids stay apart
    rows = common.materialize(docs.mapInArrow(_score_batches(shared), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.n")
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = tail.join(counts, "token", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(c + F.lit(0.1))).alias("s"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("k"))
    got = rows.drop("tail").join(sums, "row", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return got.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known").cast("long") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.col("s")).alias("base_score"), (F.col("head_score") + F.col("s")).alias("score"),
    )


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(common.table(spark, sf_dir, "documents"))
