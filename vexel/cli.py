"""Command line: build, bench, recall, diag, serve, serve-flat."""

from __future__ import annotations

import argparse
import importlib
import json
import time
from dataclasses import replace
from functools import partial

import numpy as np
from pyspark.sql import functions as F

from .operators import evaluate, ivfpq, topk
from .session import get_session
from .sources import flat, synthetic


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("vexel")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, **numbers: int) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for flag, default in numbers.items():
            p.add_argument("--" + flag.replace("_", "-"), type=int, default=default)
        p.add_argument("--dir", default="data/index")
        return p

    data = {"dim": 128, "centers": 200_000, "seed": 88172645463325252}
    for p in (
        command("build", n=1_000_000, nlist=1024, m=8, ksub=256, ntrain=200_000, coarse_iters=10, pq_iters=10, **data),
        command("bench", n=1_000_000, nq=1000, nprobe=16, k=10, rerank=256, **data),
        command("recall", n=1_000_000, nq=1000, nprobe=16, k=10, rerank=256, **data),
        command("diag", n=4_000_000, nlist=1024, m=8, ksub=256, **data),
        command("serve", n=1_000_000, port=8080, nq=256, nprobe=16, k=10, rerank=16384, **data),
    ):
        p.add_argument("--center-scale", type=float, default=1.0)
        p.add_argument("--noise", type=float, default=0.2)
    sub.choices["bench"].add_argument("--warmup", choices=("true", "false"), default="true")
    p = command("serve-flat", port=8091)
    p.add_argument("--encoder", help="module:name of a function from texts to vectors")
    p.add_argument("--baseline", default="", help="a text whose vector is subtracted from each query's, times alpha")
    p.add_argument("--alpha", type=float, default=0.5)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = get_session()
    if a.command == "serve-flat":
        from .serve import Service, serve

        vectors, meta = flat.open_flat(spark, a.dir)
        module, _, name = (a.encoder or "").partition(":")
        encoder = getattr(importlib.import_module(module), name) if name else None
        serve(Service(vectors, id_col="token", model=meta["model"], encoder=encoder, baseline=a.baseline, alpha=a.alpha), a.port).serve_forever()
        return
    spec = synthetic.DatasetSpec(a.dim, a.centers, a.center_scale, a.noise, a.seed)
    vectors = synthetic.synthetic_vectors(spark, spec, a.n)
    out: dict = {"command": a.command, "n": a.n}
    if a.command == "build":
        began = time.perf_counter()
        index = ivfpq.build(vectors, a.dir, ivfpq.BuildParams(a.nlist, a.m, a.ksub, a.ntrain, a.coarse_iters, a.pq_iters, a.seed))
        out |= index.meta | {"seconds": round(time.perf_counter() - began, 3)}
    elif a.command == "diag":
        def timed(df):
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            return round(a.n / (time.perf_counter() - began))

        centroids, book = ivfpq.train(vectors, ivfpq.BuildParams(a.nlist, a.m, a.ksub, max(a.nlist, a.ksub) * 16, 2, 2, a.seed))
        out |= {"generate_per_s": timed(vectors), "generate_assign_encode_per_s": timed(ivfpq.encode_vectors(vectors, centroids, book))}
        out["hours_for_1e9"] = round(1e9 / out["generate_assign_encode_per_s"] / 3600, 2)
    else:
        index = ivfpq.open_index(spark, a.dir)
        queries = synthetic.planted_queries(spark, spec, a.n, a.nq).cache()
        made = partial(synthetic.vectors_of, spec=spec)  # only a short list's vectors are made anew
        if a.command == "serve":
            from .serve import Service, serve

            serve(Service(vectors, index=index, queries=queries, vectors_of=made, nprobe=a.nprobe, k=a.k, rerank=a.rerank), a.port).serve_forever()
            return
        began = time.perf_counter()
        found = ivfpq.search_and_rerank(index, made, queries, a.nprobe, a.k, a.rerank).cache()
        out |= {"hits": found.count(), "seconds": round(time.perf_counter() - began, 3)}
        out["queries_per_s"] = round(a.nq / out["seconds"], 1)
        out["planted_recall"] = evaluate.planted_recall(found, queries).first()[0]
        if a.command == "bench":
            if a.warmup == "true":
                index = replace(index, codes=index.codes.persist())
                index.codes.count()
            took = np.sort(ivfpq.latencies(index, made, queries, a.nprobe, a.k, a.rerank))
            rank = lambda p: round(float(took[int(p / 100 * (len(took) - 1) + 0.5)]), 3) if len(took) else 0.0
            out["single_query_ms"] = {"mean": round(float(took.mean()), 3), "p50": rank(50), "p90": rank(90), "p99": rank(99), "max": rank(100), "p99_under_100": rank(99) < 100}
        if a.command == "recall":
            out["recall"] = evaluate.recall_at_k(found, topk.exact_topk(vectors, queries, a.k), queries, a.k).first()[0]
    print(json.dumps(out))


if __name__ == "__main__":
    main()
