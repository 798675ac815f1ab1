"""Embedding ingest through an injected encoder, traits and colour ground truth."""

from __future__ import annotations

import hashlib
import json
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Encoder(Protocol):
    d: int

    def __call__(self, items: list) -> np.ndarray: ...


class HashingEncoder:
    """A deterministic stand-in: signs of hashed words, summed."""

    def __init__(self, d: int = 64):
        self.d = d

    def __call__(self, items: list) -> np.ndarray:
        out = np.zeros((len(items), self.d), np.float32)
        for row, item in zip(out, items, strict=True):
            for w in (item if isinstance(item, bytes) else (item or "").encode()).split() or [b""]:
                h = hashlib.blake2b(w, digest_size=8).digest()
                row[int.from_bytes(h[:4], "little") % self.d] += 1 if h[4] & 1 else -1
        return out


def embed(rows: DataFrame, encoder: Encoder, id_col: str, item_col: str, batch: int = 128) -> DataFrame:
    """(id, embedding): unit vectors in float32; a zero vector stays zero."""

    def run(batches):
        for b in batches:
            ids, items = b.column(0), b.column(1).to_pylist()
            for at in range(0, len(items), batch):
                x = np.asarray(encoder(items[at : at + batch]), np.float32)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(size > 0, size, 1)
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(x)), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1).astype(np.float32)))], ["id", "embedding"])

    return rows.select(F.col(id_col).cast("long").alias("id"), item_col).mapInArrow(run, "id long, embedding array<float>")


def trait_map(attributes: Column) -> Column:
    """array<struct<trait_type, value>> as a map; of repeated types the last counts."""
    return F.aggregate(
        attributes, F.expr("cast(map() as map<string,string>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["trait_type"]), F.create_map(x["trait_type"], x["value"]))
    )


def trait_distribution(rows: DataFrame, traits: str, kind: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(traits)[kind], F.lit("?")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def is_gold(r: Column, g: Column, b: Column) -> Column:
    return (r > 170) & (g > 140) & (b < 110) & (F.abs(r - g) < 45) & (g - b > 70)


def gold_fraction(pixels: DataFrame) -> DataFrame:
    """(token, frac) over the patch of rows 30..51 and columns 24..41, greatest first, then greater token first."""
    patch = pixels.where(F.col("y").between(30, 51) & F.col("x").between(24, 41))
    return patch.groupBy("token").agg(F.avg(is_gold(F.col("r"), F.col("g"), F.col("b")).cast("double")).alias("frac")).orderBy(F.desc("frac"), F.desc("token"))


def gold_list(shares: DataFrame, n: int = 60) -> DataFrame:
    """(token, frac) of the n greatest shares, ties to the greater token."""
    return shares.select("token", "frac").orderBy(F.desc("frac"), F.desc("token")).limit(n)


def contact_sheet(scored: DataFrame, columns: int = 4, n: int = 16, score: str = "score") -> DataFrame:
    """(row, col, token, score) of the n best tokens, laid out line by line; ties to the greater token."""
    top = scored.select("token", F.col(score).alias("score")).orderBy(F.desc("score"), F.desc("token")).limit(n)
    at = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("token"))) - 1  # over n rows
    return top.withColumn("at", at).select(F.floor(F.col("at") / columns).cast("int").alias("row"), (F.col("at") % columns).alias("col"), "token", "score")


def write_embeddings(rows: DataFrame, encoder: Encoder, path: str, id_col: str, column: str, model: str = "") -> DataFrame:
    """Encodes a column and writes (id, embedding) as Parquet and, last, a description; returns what was written."""
    embed(rows, encoder, id_col, column).write.mode("overwrite").parquet(f"{path}/embeddings")
    spark = rows.sparkSession
    out = spark.read.parquet(f"{path}/embeddings")
    size = out.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    spark.createDataFrame([(json.dumps({"n": size.n, "d": size.d, "model": model}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return out
