import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.functions import rng, vectors
from vexel.operators import evaluate, ingest, ivfpq, quantize, topk
from vexel.plans import catalog
from vexel.sources import synthetic

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("embeddings", "events", "pages"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", ["flat_l2_topk", "dot_topk", "filtered_topk", "kmeans_fit", "list_sizes", "normalize_sql", "contact_sheet", "gold_tokens", "adc_lut", "brute_force_all", "ivfpq_search", "ivfpq_rerank", "recall_at_k", "latency_percentiles", "token_parse", "gold_fraction"])
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert got == sorted(want)


def test_generators():
    assert int(rng.mixed(rng.GOLDEN.reshape(1))[0]) == 0xE220A8397B1DCDAF
    s = rng.Streams(np.array([0], np.uint64))
    s.state = [np.array([k], np.uint64) for k in (1, 2, 3, 4)]
    assert [int(s.words()[0]) for _ in range(3)] == [41943041, 58720359, 3588806011781223]


def test_synthetic_data(spark):
    spec = synthetic.DatasetSpec(d=8)
    x, center = spec.vectors(np.array([0, 1, 999999]))
    assert center.tolist() == [84151, 68584, 87948]
    assert x[0, :2].tolist() == [1.2205501794815063, -0.8770880699157715]
    assert spec.queries(1_000_000, np.arange(5))[1].tolist() == [172009, 464816, 719528, 196988, 295440]
    assert synthetic.synthetic_vectors(spark, spec, 10).count() == 10


def test_initial_rows():
    assert quantize.initial_rows(500, 8, rng.Streams(np.array([catalog.SEED ^ rng.COARSE_SALT], np.uint64))) == [327, 99, 252, 463, 145, 437, 97, 374]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def test_topk_edges(spark):
    base = frame(spark, [(7, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [1.0, 0.0]), (8, None), (9, [1.0]), (10, [float("nan"), 0.0]), (11, [None, 1.0])])
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<float>")
    assert [r.id for r in topk.exact_topk(base, q, 10).orderBy("rank").collect()] == [3, 5, 7]
    assert topk.exact_topk(base, q, 0).count() == 0
    assert [r.id for r in topk.exact_topk_sql(base.where("id < 8"), q, 10).orderBy("rank").collect()] == [3, 5, 7]


def test_index_with_all_lists_is_exact(spark, tmp_path):
    v = catalog.emb(spark, SF)
    q = catalog.asked(spark, SF, 5)
    index = ivfpq.build(v, f"file://{tmp_path}/index", ivfpq.BuildParams(nlist=8, m=8, ksub=16, n_train=500, coarse_iters=2, pq_iters=1), "vec_id")
    got = ivfpq.search_and_rerank(index, v, q, 99, 10, 10_000, "vec_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, topk.exact_topk(v, q, 10, id_col="vec_id").collect()))
    assert ivfpq.list_sizes(index.codes, 8).agg({"size": "sum"}).first()[0] == 500
    assert ivfpq.search(index, q, 0, 10).count() == 0


def test_training_limits():
    with pytest.raises(ValueError):
        quantize.kmeans(np.zeros((3, 2), np.float32), 4, 1, 1)
    with pytest.raises(ValueError):
        quantize.train_codebook(np.zeros((400, 4), np.float32), 2, 300, 1, 1)
    with pytest.raises(ValueError):
        quantize.split(np.zeros((1, 5)), 2)
    x = np.ones((8, 2), np.float32)
    assert quantize.kmeans(x, 2, 3, 1).shape == (2, 2)  # the second cluster is empty and drawn again


def test_recall_divides_by_k(spark):
    hits = spark.createDataFrame([(0, i) for i in range(4)], "qid long, id long")
    assert evaluate.recall_at_k(hits, hits, hits.select("qid").distinct(), 10).first()[0] == 0.4


def test_traits_and_tokens(spark):
    rows = spark.createDataFrame([([("Fur", "Red"), ("Fur", "Blue")], "https://x/y/123/"), ([], "https://x/9?z=1")], "a array<struct<trait_type string, value string>>, u string")
    got = rows.select(ingest.trait_map(rows.a).alias("t"), vectors.token_of_url("u").alias("token")).collect()
    assert got[0].t == {"Fur": "Blue"} and [r.token for r in got] == ["123", "9"]
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(vectors.normalize("v").alias("u")).first().u
    assert zero == [None, None]


def test_service(spark):
    from vexel.serve import Service

    s = Service(catalog.emb(spark, SF), id_col="vec_id", encoder=ingest.HashingEncoder(64))
    assert s.handle("GET", "/api/info")[1]["n"] == 500
    assert s.handle("POST", "/api/search_vector", b'{"vector": [1]}')[0] == 400
    found = s.handle("GET", "/search?q=a&k=3")[1]
    assert found["n"] == 500 and [r["rank"] for r in found["results"]] == [1, 2, 3]
    v = catalog.emb(spark, SF).where("vec_id = 7").first().embedding
    first = s.handle("POST", "/api/search_vector", json.dumps({"vector": v, "k": 2}).encode())[1]["results"][0]
    assert (first["token"], first["score"]) == (7, 1.0)
    assert s.handle("GET", "/nope")[0] == 404


def test_stream(spark, tmp_path):
    from vexel.streaming.search import stream_search

    catalog.asked(spark, SF, 1).where("qid < 4").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("qid long, embedding array<float>").parquet(f"{tmp_path}/in")
    stream_search(source, lambda q: topk.exact_topk(catalog.emb(spark, SF), q, 3, id_col="vec_id"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 12


def test_queries_in_blocks(spark, monkeypatch):
    """More queries than one block: the same hits, and nothing but counts comes to the driver."""
    v, q = catalog.emb(spark, SF), catalog.asked(spark, SF, 3)
    want = {p: sorted(map(tuple, topk.exact_topk(v, q, 4, id_col="vec_id", product=p).collect())) for p in (False, True)}
    monkeypatch.setattr(topk, "BLOCK_BYTES", 64 * 8 * 40)
    monkeypatch.setattr(topk, "ROWS", 100)
    for p, rows in want.items():
        assert sorted(map(tuple, topk.exact_topk(v, q, 4, id_col="vec_id", product=p).collect())) == rows
    assert topk.exact_topk(v, q.where("qid < 0"), 4, id_col="vec_id").count() == 0


def test_nearest_equals_plain_sums():
    r = np.random.default_rng(1)
    for scale in (1, 1e-6, 1e4):
        x, c = (r.integers(-3, 4, (500, 6)) * scale).astype(np.float32), (r.integers(-3, 4, (40, 6)) * scale).astype(np.float32)  # many ties
        assert quantize.nearest(x, c, 64).tolist() == quantize.distances(x, c).argmin(1).tolist()


def test_lloyd_on_all_equals_driver(spark):
    v = catalog.emb(spark, SF)
    x = np.array([r[0] for r in v.orderBy("vec_id").select("embedding").collect()], np.float32)
    assert np.allclose(quantize.lloyd_on_all(v.repartition(7), x[:8], 3), quantize.lloyd(x, x[:8], 3), atol=1e-6)


def test_index_recall(spark):
    assert catalog.index_recall(spark, SF).first().recall >= 0.9


def test_service_with_index_and_baseline(spark, tmp_path):
    from functools import partial

    from vexel.serve import Service

    spec = synthetic.DatasetSpec(d=8, num_centers=200)
    v = synthetic.synthetic_vectors(spark, spec, 2000)
    index = ivfpq.build(v, f"file://{tmp_path}/index", ivfpq.BuildParams(nlist=16, m=4, ksub=16, n_train=1000, coarse_iters=2, pq_iters=2))
    queries = synthetic.planted_queries(spark, spec, 2000, 6)
    s = Service(v, index=index, queries=queries, vectors_of=partial(synthetic.vectors_of, spec=spec), nprobe=16, rerank=200)
    got = [s.handle("GET", f"/api/search?j={j}&k=3")[1] for j in range(6)]
    assert sum(g["hit"] for g in got) >= 5 and all(len(g["results"]) == 3 for g in got)
    assert [h.id for h in ivfpq.search_and_rerank(index, v, queries.where("qid = 2"), 16, 3, 200).orderBy("rank").collect()] == [r["id"] for r in got[2]["results"]]
    took = ivfpq.latencies(index, partial(synthetic.vectors_of, spec=spec), queries, 4, 3, 50, untimed=1)
    assert len(took) == 6 and min(took) > 0
    words = ["golden fur ape", "blue ape", "ape"]
    e = ingest.HashingEncoder(64)
    table = spark.createDataFrame([(i, (e([w])[0] / np.linalg.norm(e([w])[0])).tolist()) for i, w in enumerate(words)], "id long, embedding array<float>")
    plain, moved = (Service(table, encoder=e, baseline=b).search_text("golden fur ape", 3)["results"] for b in ("", "ape"))
    share = lambda found: next(r["score"] for r in found if r["token"] == 2)
    assert share(moved) < share(plain)


def test_flat_files_round_trip(spark, tmp_path):
    from vexel.sources import flat

    v = spark.createDataFrame([(5, [1.0, 2.0]), (3, [0.5, -1.0])], "token long, embedding array<float>")
    flat.write_flat(v, f"{tmp_path}/x", "m")
    back, meta = flat.open_flat(spark, f"{tmp_path}/x")
    assert meta == {"d": 2, "n": 2, "model": "m"} and sorted(map(tuple, back.collect())) == [(3, [0.5, -1.0]), (5, [1.0, 2.0])]
    with open(f"{tmp_path}/x/embeddings.f32", "ab") as f:
        f.write(b"\x00\x00\x80\x3f\x01")
    assert flat.read_floats(spark, f"{tmp_path}/x/embeddings.f32").tolist() == [0.5, -1.0, 1.0, 2.0, 1.0]
    with pytest.raises(ValueError):
        flat.open_flat(spark, f"{tmp_path}/x")


def test_embeddings_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "b b b")], "id long, text string")
    out = ingest.write_embeddings(rows, ingest.HashingEncoder(16), str(tmp_path), "id", "text", "hash")
    assert sorted(r.id for r in out.collect()) == [1, 2, 3]
    assert json.loads(spark.read.text(f"{tmp_path}/meta").first()[0]) == {"n": 3, "d": 16, "model": "hash"}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from vexel import cli

    monkeypatch.setattr(cli, "get_session", lambda: spark)
    data = ["--n", "600", "--dim", "8", "--centers", "50", "--dir", f"file://{tmp_path}/index"]
    cli.main(["build", "--nlist", "8", "--m", "4", "--ksub", "16", "--coarse-iters", "2", "--pq-iters", "2", *data])
    cli.main(["bench", "--nq", "3", "--nprobe", "8", "--k", "5", "--rerank", "50", *data])
    cli.main(["recall", "--nq", "3", "--nprobe", "8", "--k", "5", "--rerank", "600", *data])
    built, bench, recall = (json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{"))
    assert built["n"] == 600 and set(bench["single_query_ms"]) == {"mean", "p50", "p90", "p99", "max", "p99_under_100"}
    assert recall["recall"] == 1.0 and recall["planted_recall"] == 1.0


def test_shortlist_does_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """A tenth of the rows for each hundredth row is a square, which was sent through the driver."""
    v = catalog.emb(spark, SF)
    rolled = [v.withColumns({"vec_id": F.col("vec_id") + 500 * k, "embedding": F.concat(F.slice("embedding", k + 1, 64 - k), F.slice("embedding", 1, k))}) for k in range(1, 6)]
    for part in rolled:
        v = v.unionByName(part)
    v.write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, plain = [], ivfpq.rerank
    monkeypatch.setattr(ivfpq, "rerank", lambda vectors, queries, short, *more: (seen.append(short.groupBy("qid").count().agg(F.max("count")).first()[0]), plain(vectors, queries, short, *more))[1])
    assert catalog.index_recall(spark, str(tmp_path)).first().recall >= 0.9
    assert seen == [200]


def test_training_sample_is_bounded_and_leaves_out_what_has_no_rank(spark):
    v = catalog.emb(spark, SF).select(F.col("vec_id").alias("id"), "embedding")
    odd = spark.createDataFrame([(-1, None), (-2, [float("nan")] * 64), (-3, [1.0])], "id long, embedding array<float>")
    whole = np.array([r[0] for r in v.orderBy("id").select("embedding").collect()], np.float32)
    assert (ivfpq.sample(v.unionByName(odd), 500) == whole).all()
    some = ivfpq.sample(v.repartition(7), 100)
    assert len(some) == 100 and (some == ivfpq.sample(v, 100)).all() and {x.tobytes() for x in some} <= {x.tobytes() for x in whole}


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_search_equals_look_up_tables(spark, monkeypatch, held):
    """Candidates by matrix products and what a task keeps leave the table distances' order as it is, ties included."""
    monkeypatch.setattr(topk, "HELD", held)
    x = np.random.default_rng(5).integers(-2, 3, (400, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<float>").repartition(3)
    centroids, book = ivfpq.train(v, ivfpq.BuildParams(nlist=6, m=4, ksub=8, coarse_iters=2, pq_iters=2))
    codes = ivfpq.encode_vectors(v, centroids, book)
    odd = spark.createDataFrame([(900, None), (901, [float("nan")] * 8)], "qid long, embedding array<float>")
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding").unionByName(odd)
    got = ivfpq.search(ivfpq.IvfPq({"buckets": 1}, centroids, book, codes), q, 4, 7)
    own, want = codes.collect(), []
    for i in range(0, 400, 20):
        near = quantize.distances(x[i : i + 1], centroids)[0].argsort(kind="stable")[:4].tolist()
        hits = sorted((float(quantize.table_distance(quantize.lookup_table(x[i] - centroids[r.list_id], book), np.frombuffer(r.code, np.uint8)[None])[0]), r.id) for r in own if r.list_id in near)
        want += [(i, n + 1, h, dist) for n, (dist, h) in enumerate(hits[:7])]
    assert sorted(map(tuple, got.collect())) == want
