"""Imports and exports: raw little-endian floats with a JSON description, image tables, trait files."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import token_of_url


def read_floats(spark: SparkSession, path: str) -> np.ndarray:
    """A file of float32, read through Spark's file systems; up to three trailing bytes are left out."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return np.frombuffer(data[: len(data) // 4 * 4], "<f4")


def open_flat(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """(token, embedding) and the description of a folder with meta.json and embeddings.f32."""
    meta = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/meta.json").collect()))
    d, tokens = int(meta["d"]), meta["tokens"]
    x = read_floats(spark, f"{folder}/embeddings.f32")
    if x.size != d * len(tokens):
        raise ValueError(f"{x.size} floats for {len(tokens)} tokens of {d}")
    rows = [(int(t), v.tolist()) for t, v in zip(tokens, x.reshape(-1, d), strict=True)]
    return spark.createDataFrame(rows, "token long, embedding array<float>"), {"d": d, "n": len(tokens), "model": meta.get("model", "")}


def write_flat(vectors: DataFrame, folder: str, model: str = "") -> None:
    """An export to one local file, for small collections; Parquet is the working format."""
    rows = vectors.select("token", "embedding").orderBy("token").collect()
    Path(folder).mkdir(parents=True, exist_ok=True)
    x = np.array([r.embedding for r in rows], "<f4")
    x.tofile(f"{folder}/embeddings.f32")
    Path(folder, "meta.json").write_text(json.dumps({"n": len(rows), "d": int(x.shape[1]) if len(rows) else 0, "model": model, "tokens": [r.token for r in rows]}, indent=1))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(token, image bytes) of every Parquet file below a folder."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(folder)
    return rows.select(F.expr("try_cast(token AS bigint)").alias("token"), "image") if "token" in rows.columns else rows.select(token_of_url("token_metadata").try_cast("bigint").alias("token"), F.col("image.bytes").alias("image"))


def read_thumbnails(spark: SparkSession, folder: str) -> DataFrame:
    """(token, image) of the .jpg files of a folder; the token is the name before the first dot."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder)
    return files.select(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).alias("token"), F.col("content").alias("image"))


def read_traits(spark: SparkSession, path: str) -> DataFrame:
    """(token, traits map) of a JSON object of objects."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("token", "traits"))


def write_traits(traits: DataFrame, path: str) -> None:
    traits.write.mode("overwrite").json(path)
