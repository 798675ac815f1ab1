"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Texts and bytes per Arrow batch: many short texts or a few long ones.
BATCH_ROWS, BATCH_BYTES = 1000, 64 << 20
#: Of tables that hold the whole input's texts, by tag; of others it is the session's.
COMPRESSION = {"occurrences": "zstd", "texts": "zstd"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vexel-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=COMPRESSION.get(tag))
    out = spark.read.schema(df.schema).parquet(path)
    out._vexel_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_vexel_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back(spark: SparkSession) -> bool:
    """Ask the driver's JVM to collect garbage and to return freed memory to the system; whether its version can do the latter.

    The heap shrinks with a full collection. What the JVM's compilers free stays with the C library, which seldom returns it by itself.
    """
    gateway = spark.sparkContext._gateway
    java = gateway.jvm.java.lang
    java.System.gc()
    beans = java.management.ManagementFactory.getPlatformMBeanServer()
    name = gateway.jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    types = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    signature, values = gateway.new_array(java.Class, len(types)), gateway.new_array(java.Object, len(types))
    for k, t in enumerate(types):
        signature[k] = java.Class.forName(t)
    values[0], values[1] = name, "systemTrimNativeHeap"
    try:  # through the interface, as the server's own class is not open to reflection
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", signature).invoke(beans, values)
    except Py4JJavaError:  # Java before 17.0.9, or not on Linux
        return False
    return True


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python operators (a session setting)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and nothing else, so that extra columns can't clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def held_out(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``modulus`` is 0; a null id counts as empty text (crc 0), so nothing is learnt from it."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == 0


def labelled_sample(labels: DataFrame, label: str, modulus: int, bound: int) -> DataFrame:
    """At most ``bound`` labelled training rows (doc_id, y), chosen by a hash of the id.

    Rows that are held out or null are left out; of repeated ids the largest label counts. Every row
    is taken as long as there are no more than ``bound``.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(modulus))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    )
    n = known.count()
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30))
    if n > bound:
        known = known.where(place < int(1.05 * bound / n * (1 << 30)))
    return known.orderBy(place, "doc_id").limit(bound)
