"""Queries over the tables, and the SQL of those that SQL can express.

The trained objects of these queries are small and fixed by rule, so that SQL can follow: the first eight vectors are the
centroids; the codebook is one Lloyd step, over the first 500 vectors, from the residuals of the sixteen that follow.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.rng import COARSE_SALT, Streams
from ..operators import evaluate, ingest, ivfpq, topk
from ..operators import quantize as Q
from ..session import shared_folder
from ..sources import synthetic

LISTS, M, KSUB, NPROBE, SHORT, K, EVERY = 8, 8, 16, 3, 40, 10, 100
#: Rows that index_search ranks by exact distances for each query.
SHORTLIST = 200
SEED = synthetic.DatasetSpec().seed


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def asked(spark: SparkSession, sf: str, every: int = EVERY) -> DataFrame:
    """The queries of a search: rows whose id is divisible by ``every``."""
    return emb(spark, sf).select(F.col("vec_id").alias("qid"), "embedding").where(F.col("qid") % every == 0)


def _head(spark: SparkSession, sf: str, n: int) -> np.ndarray:
    return np.array([r[0] for r in emb(spark, sf).where(F.col("vec_id") < n).orderBy("vec_id").select("embedding").collect()], np.float32)


@dataclass
class Trained:
    centroids: np.ndarray
    book: np.ndarray
    codes: DataFrame


def trained(spark: SparkSession, sf: str) -> Trained:
    centroids = _head(spark, sf, LISTS)
    x = np.array([r[0] for r in emb(spark, sf).where(F.col("vec_id") < 500).orderBy("vec_id").select("embedding").collect()], np.float32)
    parts = Q.split(x - centroids[Q.nearest(x, centroids)], M)
    book = np.stack([Q.lloyd(parts[:, s], parts[LISTS : LISTS + KSUB, s], 1) for s in range(M)])
    return Trained(centroids, book, ivfpq.encode_vectors(emb(spark, sf), centroids, book, "vec_id"))


def _index(spark: SparkSession, sf: str) -> ivfpq.IvfPq:
    t = trained(spark, sf)
    return ivfpq.IvfPq({"buckets": 1}, t.centroids, t.book, t.codes)


def centers(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).where(F.col("vec_id") < LISTS).select(F.col("vec_id").cast("int").alias("list_id"), F.col("embedding").alias("c"))


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    pairs = emb(spark, sf).join(F.broadcast(centers(spark, sf)))  # eight centers
    pairs = pairs.select("vec_id", "embedding", "list_id", "c", V.l2_sq("embedding", "c").alias("dist"))
    best = F.min_by(F.struct("list_id", "embedding", "c", "dist"), F.struct("dist", "list_id")).alias("b")
    return pairs.groupBy("vec_id").agg(best).select("vec_id", "b.list_id", "b.embedding", "b.c", "b.dist")


def flat_l2_topk(spark, sf):
    return topk.exact_topk(emb(spark, sf), asked(spark, sf), K, id_col="vec_id")


def flat_l2_topk_sql(spark, sf):
    return topk.exact_topk_sql(emb(spark, sf), asked(spark, sf), K, id_col="vec_id")


def flat_cosine_topk(spark, sf):
    hits = topk.exact_topk(emb(spark, sf), asked(spark, sf), K, id_col="vec_id")
    return hits.select("qid", "rank", F.col("id").alias("token"), V.cosine_unit("dist").alias("score"))


def dot_topk(spark, sf):
    return topk.exact_topk(emb(spark, sf), asked(spark, sf), K, id_col="vec_id", product=True, value="score")


def vector_norm(spark, sf):
    return emb(spark, sf).select("vec_id", V.norm("embedding").alias("norm"))


def normalize_scaled(spark, sf):
    scaled = emb(spark, sf).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * F.lit(3.0)).alias("v"))
    return scaled.select("vec_id", F.posexplode(V.normalize("v")).alias("j", "x"))


def baseline_subtract_search(spark, sf):
    """Queries minus half of row 0, to unit length, then exact search."""
    base = F.broadcast(emb(spark, sf).where("vec_id = 0").select(F.col("embedding").alias("b")))
    q = asked(spark, sf).where("qid > 0").join(base).select("qid", V.subtract_scaled("embedding", "b", 0.5).alias("v"))
    return topk.exact_topk(emb(spark, sf), q.select("qid", V.normalize("v").alias("embedding")), K, id_col="vec_id")


def filtered_topk(spark, sf):
    return topk.exact_topk(emb(spark, sf).where("label = 3"), asked(spark, sf), K, id_col="vec_id")


def brute_force_all(spark, sf):
    return topk.exact_topk(emb(spark, sf), asked(spark, sf, 1), K, id_col="vec_id")


def coarse_probe(spark, sf):
    c = centers(spark, sf).select("list_id", F.col("c").alias("embedding"))
    return topk.exact_topk(c, asked(spark, sf), NPROBE, id_col="list_id").select("qid", "rank", F.col("id").cast("int").alias("list_id"), "dist")


def assign_nearest(spark, sf):
    return assigned(spark, sf).select("vec_id", "list_id", "dist")


def kmeans_init(spark, sf):
    n = emb(spark, sf).count()
    rows = Q.initial_rows(n, LISTS, Streams(np.array([SEED ^ COARSE_SALT], np.uint64)))
    return spark.createDataFrame(list(enumerate(rows)), "cluster int, row_number long")


def kmeans_step(spark, sf):
    """One Lloyd step from the first rows, as a partial and final aggregation by cluster and dimension."""
    rows = assigned(spark, sf).select("list_id", F.posexplode("embedding").alias("j", "x"))
    return rows.groupBy("list_id", "j").agg(F.avg(F.col("x").cast("double")).cast("float").alias("x"), F.count(F.lit(1)).alias("n"))


def kmeans_fit(spark, sf):
    """Two steps over all rows of the table from its first rows."""
    c = Q.lloyd_on_all(emb(spark, sf), _head(spark, sf, LISTS), 2)
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(c) for j, v in enumerate(row)], "list_id int, j int, x float")


def list_sizes(spark, sf):
    return ivfpq.list_sizes(trained(spark, sf).codes, LISTS)


def residuals(spark, sf):
    return assigned(spark, sf).select("vec_id", "list_id", F.posexplode(V.residual("embedding", "c")).alias("j", "x"))


def pq_codebook(spark, sf):
    book = trained(spark, sf).book
    return spark.createDataFrame([(s, c, j, float(x)) for s, b in enumerate(book) for c, v in enumerate(b) for j, x in enumerate(v)], "s int, c int, j int, x float")


def pq_encode(spark, sf):
    return trained(spark, sf).codes.select("list_id", "id", F.hex("code").alias("code"))


def adc_lut(spark, sf):
    t = trained(spark, sf)
    rows = []
    for r in asked(spark, sf).orderBy("qid").collect():
        q = np.array(r.embedding, np.float32)
        c = int(Q.distances(q[None], t.centroids)[0].argmin())
        rows += [(r.qid, c, s, k, float(d)) for s, line in enumerate(Q.lookup_table(q - t.centroids[c], t.book)) for k, d in enumerate(line)]
    return spark.createDataFrame(rows, "qid long, list_id int, s int, c int, d double")


def ivfpq_search(spark, sf):
    return ivfpq.search(_index(spark, sf), asked(spark, sf), NPROBE, SHORT)


def ivfpq_rerank(spark, sf):
    return ivfpq.search_and_rerank(_index(spark, sf), emb(spark, sf), asked(spark, sf), NPROBE, K, SHORT, "vec_id")


def index_search(spark, sf):
    """An index of all rows, built, written, opened and asked: its training sample is bounded by ``n_train``. Its share of lists and SHORTLIST make its recall; a short
    list that grew with the rows would grow the pairs to rank with their square."""
    n = emb(spark, sf).count()
    lists = max(4, min(1024, int(n**0.5)))
    p = ivfpq.BuildParams(nlist=lists, m=32, ksub=min(256, max(4, n // 8)), coarse_iters=5, pq_iters=5)
    index = ivfpq.build(emb(spark, sf), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", p, "vec_id")
    return ivfpq.search_and_rerank(index, emb(spark, sf), asked(spark, sf), -(-3 * lists // 4), K, SHORTLIST, "vec_id")


def index_recall(spark, sf):
    return evaluate.recall_at_k(index_search(spark, sf), flat_l2_topk(spark, sf), asked(spark, sf), K)


def recall_at_k(spark, sf):
    return evaluate.recall_at_k(ivfpq_rerank(spark, sf), flat_l2_topk(spark, sf), asked(spark, sf), K)


def planted_recall(spark, sf):
    return evaluate.planted_recall(ivfpq_rerank(spark, sf), asked(spark, sf).withColumn("target_id", F.col("qid")))


def latency_percentiles(spark, sf):
    return evaluate.latency_report(spark.read.parquet(f"{sf}/events.parquet").where("value is not null"), "value", "event_type")


def topk_merge(spark, sf):
    """Top-k of parts, merged: equals the whole table's."""
    parts = [topk.exact_topk(emb(spark, sf).where(F.col("vec_id") % 3 == r), asked(spark, sf), K, id_col="vec_id") for r in range(3)]
    return topk.ranked(parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("rank"), K)


def trait_map(spark, sf):
    pair = F.struct(F.lit("k").alias("trait_type"), F.get_json_object("props", "$.k").alias("value"))
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", ingest.trait_map(F.array(F.struct(F.lit("k").alias("trait_type"), F.lit("old").alias("value")), pair)).alias("t"))
    return rows.select("event_id", F.col("t")["k"].alias("k"), F.size("t").alias("n"))


def trait_distribution(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.create_map(F.lit("Kind"), F.nullif(F.col("event_type"), F.lit("click"))).alias("t"))
    return ingest.trait_distribution(rows, "t", "Kind")


def token_parse(spark, sf):
    t = V.token_of_url("url")
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", t.alias("segment"), t.try_cast("bigint").alias("token"))


def gold_fraction(spark, sf):
    grid = spark.range(20 * 64 * 64).selectExpr("id div 4096 as token", "cast(id % 4096 div 64 as int) as y", "cast(id % 64 as int) as x")
    mix = lambda a, b, c: ((F.col("token") * a + F.col("y") * b + F.col("x") * c) % 256).cast("float")
    return ingest.gold_fraction(grid.select("token", "y", "x", (F.lit(150) + mix(3, 1, 1) / 3).cast("float").alias("r"), (F.lit(130) + mix(5, 1, 2) / 4).cast("float").alias("g"), mix(7, 2, 1).alias("b")))


def gold_tokens(spark, sf):
    return ingest.gold_list(gold_fraction(spark, sf), 6)


def contact_sheet(spark, sf):
    """The sixteen vectors with the greatest product with row 0, four to a line."""
    asks = emb(spark, sf).where("vec_id = 0").select(F.lit(0).cast("long").alias("qid"), "embedding")
    hits = topk.exact_topk(emb(spark, sf), asks, 16, id_col="vec_id", product=True, value="score")
    return ingest.contact_sheet(hits.select(F.col("id").alias("token"), "score"))


def normalize_sql(spark, sf):
    """Unit vectors of tripled ones through the SQL function."""
    V.register_sql_functions(spark)
    emb(spark, sf).createOrReplaceTempView("vexel_embeddings")
    unit = spark.sql("SELECT vec_id, normalize(transform(embedding, x -> CAST(x AS DOUBLE) * 3D)) AS u FROM vexel_embeddings")
    return unit.select("vec_id", F.posexplode("u").alias("j", "x"))


def index_stats(spark, sf):
    rows = emb(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"))
    return rows.select("n", "d", F.lit(LISTS).alias("nlist"), F.lit(M).alias("bytes_per_vec"), (F.col("n") * F.lit(M) / F.lit(1e9)).alias("code_gb"))


def synth_vectors(spark, sf):
    return synthetic.synthetic_vectors(spark, synthetic.DatasetSpec(d=16, num_centers=1000), 2000)


def planted_queries(spark, sf):
    return synthetic.planted_queries(spark, synthetic.DatasetSpec(d=16, num_centers=1000), 2000, 50)


def embed_stub(spark, sf):
    return ingest.embed(spark.read.parquet(f"{sf}/documents.parquet"), ingest.HashingEncoder(), "doc_id", "text")


def sql_functions(spark, sf):
    """Distances through the SQL functions."""
    V.register_sql_functions(spark)
    emb(spark, sf).createOrReplaceTempView("vexel_embeddings")
    return spark.sql("SELECT vec_id, l2_sq(embedding, lead) AS dist, dot(embedding, lead) AS product FROM vexel_embeddings, (SELECT embedding AS lead FROM vexel_embeddings WHERE vec_id = 1)")


QUERIES = {f.__name__: f for f in (
    flat_l2_topk, flat_l2_topk_sql, flat_cosine_topk, dot_topk, vector_norm, normalize_scaled, baseline_subtract_search, filtered_topk, brute_force_all,
    coarse_probe, assign_nearest, kmeans_init, kmeans_step, kmeans_fit, list_sizes, residuals, pq_codebook, pq_encode, adc_lut, ivfpq_search,
    ivfpq_rerank, index_search, index_recall, recall_at_k, planted_recall, latency_percentiles, topk_merge, trait_map, trait_distribution, token_parse, gold_fraction, gold_tokens, contact_sheet, normalize_sql, index_stats,
    synth_vectors, planted_queries, embed_stub, sql_functions,
)}


def _d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _top(pairs: str, k: int = K, value: str = "dist", order: str = "dist") -> str:
    """k best of a table (qid, id, value)."""
    return f"SELECT qid, rank, id, {value} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}, id)::INTEGER AS rank FROM ({pairs})) WHERE rank <= {k}"


_Q = f"(SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % {EVERY} = 0)"
_PAIRS = f"SELECT qid, vec_id AS id, {_d2('q', 'embedding')} AS dist FROM {_Q}, embeddings"
_CHAIN = f"""
WITH cent AS (SELECT vec_id::INTEGER AS list_id, embedding AS c FROM embeddings WHERE vec_id < {LISTS}),
pairs AS (SELECT vec_id, embedding, list_id, c, {_d2("embedding", "c")} AS dist FROM embeddings, cent),
own AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, list_id) = 1),
res AS (SELECT vec_id, list_id, list_transform(list_zip(embedding, c), lambda p: (p[1] - p[2])::FLOAT) AS r FROM own),
sub AS (SELECT vec_id, list_id, s::INTEGER AS s, r[s * 8 + 1 : s * 8 + 8] AS v FROM res, range({M}) t(s)),
book0 AS (SELECT s, vec_id::INTEGER - {LISTS} AS c, v FROM sub WHERE vec_id BETWEEN {LISTS} AND {LISTS + KSUB - 1}),
near0 AS (SELECT sub.s, sub.vec_id, sub.v, book0.c FROM sub JOIN book0 USING (s) WHERE sub.vec_id < 500
  QUALIFY row_number() OVER (PARTITION BY sub.s, sub.vec_id ORDER BY {_d2("sub.v", "book0.v")}, book0.c) = 1),
mean AS (SELECT s, c, j, avg(v[j]::DOUBLE)::FLOAT AS x FROM near0, range(1, 9) t(j) GROUP BY s, c, j),
book AS (SELECT s, c, list(x ORDER BY j) AS v FROM mean GROUP BY s, c),
code AS (SELECT sub.vec_id, sub.list_id, sub.s, book.c FROM sub JOIN book USING (s)
  QUALIFY row_number() OVER (PARTITION BY sub.vec_id, sub.s ORDER BY {_d2("sub.v", "book.v")}, book.c) = 1),
probe AS (SELECT qid, q, list_id, c, {_d2("q", "c")} AS dist FROM {_Q}, cent QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, list_id) <= {NPROBE}),
qres AS (SELECT qid, list_id, list_transform(list_zip(q, c), lambda p: (p[1] - p[2])::FLOAT) AS r FROM probe),
lut AS (SELECT qid, list_id, book.s, book.c, {_d2("qres.r[book.s * 8 + 1 : book.s * 8 + 8]", "book.v")} AS d FROM qres, book),
adc AS (SELECT lut.qid, code.vec_id AS id, list_sum(list(lut.d ORDER BY lut.s)) AS dist FROM code JOIN lut ON code.list_id = lut.list_id AND code.s = lut.s AND code.c = lut.c GROUP BY lut.qid, code.vec_id),
short AS ({_top("SELECT * FROM adc", SHORT)}),
ranked AS ({_top(f"SELECT short.qid, short.id, {_d2('q.q', 'e.embedding')} AS dist FROM short JOIN {_Q} q ON q.qid = short.qid JOIN embeddings e ON e.vec_id = short.id")}),
truth AS ({_top(_PAIRS)})
"""
_STEP = lambda cent, rows: f"SELECT list_id, j::INTEGER - 1 AS j, avg(embedding[j]::DOUBLE)::FLOAT AS x, count(*) AS n FROM ({rows}), range(1, 65) t(j) GROUP BY list_id, j"
_NORMED = lambda v: f"list_transform({v}, lambda x: x / sqrt({_dot(v, v)}))"
_URL = "list_last(string_split(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '/'))"
_NEAREST_RANK = lambda p: f"sorted[round({p / 100}::DOUBLE * (n - 1))::INTEGER + 1]"

ORACLE_SQL = {
    "flat_l2_topk": _top(_PAIRS),
    "flat_l2_topk_sql": _top(_PAIRS),
    "flat_cosine_topk": f"SELECT qid, rank, id AS token, 1.0::DOUBLE - dist / 2.0::DOUBLE AS score FROM ({_top(_PAIRS)})",
    "dot_topk": _top(f"SELECT qid, vec_id AS id, {_dot('q', 'embedding')} AS score FROM {_Q}, embeddings", value="score", order="score DESC"),
    "vector_norm": f"SELECT vec_id, sqrt({_dot('embedding', 'embedding')}) AS norm FROM embeddings",
    "normalize_scaled": f"SELECT vec_id, (j - 1)::INTEGER AS j, u[j] AS x FROM (SELECT vec_id, {_NORMED('v')} AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3.0::DOUBLE) AS v FROM embeddings)), range(1, 65) t(j)",
    "baseline_subtract_search": _top(
        f"SELECT qid, vec_id AS id, {_d2('u', 'embedding')} AS dist FROM (SELECT qid, {_NORMED('v')} AS u FROM (SELECT qid, list_transform(list_zip(q, b), lambda p: p[1]::DOUBLE - 0.5::DOUBLE * p[2]::DOUBLE) AS v FROM {_Q}, (SELECT embedding AS b FROM embeddings WHERE vec_id = 0) WHERE qid > 0)), embeddings"
    ),
    "filtered_topk": _top(_PAIRS + " WHERE label = 3"),
    "brute_force_all": _top(f"SELECT a.vec_id AS qid, b.vec_id AS id, {_d2('a.embedding', 'b.embedding')} AS dist FROM embeddings a, embeddings b"),
    "coarse_probe": _CHAIN + "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, list_id)::INTEGER AS rank, list_id, dist FROM probe",
    "assign_nearest": _CHAIN + "SELECT vec_id, list_id, dist FROM own",
    "kmeans_step": _CHAIN + _STEP("cent", "SELECT * FROM own"),
    "kmeans_fit": _CHAIN
    + f", one AS (SELECT list_id, list(x ORDER BY j) AS c FROM ({_STEP('cent', 'SELECT * FROM own')}) GROUP BY list_id), again AS (SELECT vec_id, embedding, one.list_id FROM embeddings, one QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {_d2('embedding', 'one.c')}, one.list_id) = 1) SELECT list_id, j, x FROM ({_STEP('one', 'SELECT * FROM again')})",
    "list_sizes": _CHAIN + f"SELECT list_id, size, coalesce(sum(size) OVER (ORDER BY list_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT l::INTEGER AS list_id, (SELECT count(*) FROM own WHERE own.list_id = l) AS size FROM range({LISTS}) t(l))",
    "residuals": _CHAIN + "SELECT vec_id, list_id, (j - 1)::INTEGER AS j, r[j] AS x FROM res, range(1, 65) t(j)",
    "pq_codebook": _CHAIN + "SELECT s, c, (j - 1)::INTEGER AS j, v[j] AS x FROM book, range(1, 9) t(j)",
    "pq_encode": _CHAIN + "SELECT list_id, vec_id AS id, string_agg(printf('%02X', c), '' ORDER BY s) AS code FROM code GROUP BY list_id, vec_id",
    "adc_lut": _CHAIN + "SELECT lut.qid, lut.list_id, s, lut.c, d FROM lut JOIN (SELECT qid, min_by(list_id, dist) AS list_id FROM probe GROUP BY qid) USING (qid, list_id)",
    "ivfpq_search": _CHAIN + "SELECT qid, rank, id, dist FROM short",
    "ivfpq_rerank": _CHAIN + "SELECT qid, rank, id, dist FROM ranked",
    "recall_at_k": _CHAIN + f"SELECT sum(hits)::DOUBLE / (count(*) * {K}.0::DOUBLE) AS recall FROM (SELECT q.qid, count(t.id) AS hits FROM {_Q} q LEFT JOIN ranked r ON r.qid = q.qid LEFT JOIN truth t ON t.qid = r.qid AND t.id = r.id GROUP BY q.qid)",
    "planted_recall": _CHAIN + f"SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM ranked r WHERE r.qid = q.qid AND r.id = q.qid) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS planted_recall FROM {_Q} q",
    "latency_percentiles": f"SELECT event_type, n, mean, {_NEAREST_RANK(50)} AS p50, {_NEAREST_RANK(90)} AS p90, {_NEAREST_RANK(99)} AS p99, max, 1000.0::DOUBLE / mean AS per_second FROM (SELECT event_type, count(value) AS n, avg(value) AS mean, max(value) AS max, list(value ORDER BY value) AS sorted FROM events WHERE value IS NOT NULL GROUP BY event_type)",
    "topk_merge": _top(_PAIRS),
    "trait_map": "SELECT event_id, props->>'$.k' AS k, 1 AS n FROM events",
    "trait_distribution": "SELECT CASE WHEN event_type IS NULL OR event_type = 'click' THEN '?' ELSE event_type END AS value, count(*) AS n FROM events GROUP BY 1",
    "token_parse": f"SELECT page_id, {_URL} AS segment, TRY_CAST({_URL} AS BIGINT) AS token FROM pages",
    "gold_fraction": """WITH g AS (SELECT t.i // 4096 AS token, t.i % 4096 // 64 AS y, t.i % 64 AS x FROM range(81920) t(i)),
      p AS (SELECT token, (150 + ((token * 3 + y + x) % 256)::FLOAT::DOUBLE / 3)::FLOAT AS r, (130 + ((token * 5 + y + x * 2) % 256)::FLOAT::DOUBLE / 4)::FLOAT AS g, ((token * 7 + y * 2 + x) % 256)::FLOAT AS b FROM g WHERE y BETWEEN 30 AND 51 AND x BETWEEN 24 AND 41)
      SELECT token, avg((r > 170 AND g > 140 AND b < 110 AND abs(r - g) < 45 AND g - b > 70)::INTEGER::DOUBLE) AS frac FROM p GROUP BY token""",
    "contact_sheet": f"SELECT ((r - 1) // 4)::INTEGER AS row, ((r - 1) % 4)::INTEGER AS col, token, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, token DESC) AS r FROM (SELECT b.vec_id AS token, {_dot('a.embedding', 'b.embedding')} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0)) WHERE r <= 16",
    "index_stats": f"SELECT count(*) AS n, max(len(embedding))::INTEGER AS d, {LISTS} AS nlist, {M} AS bytes_per_vec, count(*) * {M}::DOUBLE / 1e9::DOUBLE AS code_gb FROM embeddings",
    "sql_functions": f"SELECT vec_id, {_d2('embedding', 'l')} AS dist, {_dot('embedding', 'l')} AS product FROM embeddings, (SELECT embedding AS l FROM embeddings WHERE vec_id = 1)",
}
ORACLE_SQL["gold_tokens"] = f"SELECT * FROM ({ORACLE_SQL['gold_fraction']}) ORDER BY frac DESC, token DESC LIMIT 6"
ORACLE_SQL["normalize_sql"] = ORACLE_SQL["normalize_scaled"]
