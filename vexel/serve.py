"""A thin HTTP face over a session: the vectors stay cached, each request is one small query set."""

from __future__ import annotations

import json
import time
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
from pyspark.sql import DataFrame

from .operators import ivfpq, topk

MOST = 1000


class Service:
    """Handles (method, path, body) and returns (status, object)."""

    def __init__(self, vectors: DataFrame, *, id_col: str = "id", model: str = "", index: ivfpq.IvfPq | None = None, queries: DataFrame | None = None, vectors_of=None, encoder=None, baseline: str = "", alpha: float = 0.5, nprobe: int = 16, k: int = 10, rerank: int = 16384):
        self.vectors, self.id_col, self.model, self.index, self.encoder = vectors.cache(), id_col, model, index, encoder
        self.queries = [] if queries is None else queries.orderBy("qid").collect()
        self.baseline, self.alpha, self.vectors_of = baseline, alpha, vectors_of
        self.nprobe, self.k, self.rerank = nprobe, k, rerank
        if index is not None:
            self.index = replace(index, codes=index.codes.persist())  # resident codes
            self.index.codes.count()
        self.n, self.d = vectors.count(), len(vectors.first()["embedding"])

    def info(self) -> dict:
        if self.index is None:
            return {"n": self.n, "d": self.d, "model": self.model}
        m = self.index.meta
        return {"n": self.n, "nlist": self.index.lists, "d": self.d, "m": m["m"], "ksub": m["ksub"], "bytes_per_vec": m["m"], "nq": len(self.queries), "nprobe": self.nprobe, "k": self.k, "rerank": self.rerank}

    def _query(self, vector) -> DataFrame:
        return self.vectors.sparkSession.createDataFrame([(0, [float(x) for x in vector])], "qid long, embedding array<float>")

    def search_vector(self, vector, k: int = 24) -> dict:
        began = time.perf_counter()
        hits = topk.exact_topk(self.vectors, self._query(vector), min(k, MOST), id_col=self.id_col).orderBy("rank").collect()
        return {"latency_ms": round((time.perf_counter() - began) * 1000, 3), "results": [{"rank": h.rank, "token": h.id, "score": round(1 - h.dist / 2, 4)} for h in hits]}

    def search_planted(self, j: int, nprobe: int, k: int) -> dict:
        q = self.queries[j % len(self.queries)]
        began = time.perf_counter()
        hits = ivfpq.search_and_rerank(self.index, self.vectors_of or self.vectors, self._query(q.embedding), nprobe, min(k, MOST), self.rerank, self.id_col).orderBy("rank").collect()
        rows = [{"rank": h.rank, "id": h.id, "dist": round(h.dist, 4), "is_target": h.id == q.target_id} for h in hits]
        return {"query_index": j % len(self.queries), "target_id": q.target_id, "latency_ms": round((time.perf_counter() - began) * 1000, 3), "nprobe": nprobe, "k": k, "hit": any(r["is_target"] for r in rows), "results": rows}

    def search_text(self, text: str, k: int = 24) -> dict:
        began = time.perf_counter()
        unit = lambda v: v / (float(np.linalg.norm(v)) + 1e-9)
        x, *rest = (unit(v) for v in np.asarray(self.encoder([text, self.baseline] if self.baseline else [text]), np.float32))
        if rest:  # what every text of the collection has in common counts less
            x = unit(x - self.alpha * rest[0])
        encoded = (time.perf_counter() - began) * 1000
        found = self.search_vector(x, k)
        return {"query": text, "encode_ms": round(encoded, 3), "search_ms": found["latency_ms"], "total_ms": round((time.perf_counter() - began) * 1000, 3), "n": self.n, "results": found["results"]}

    def handle(self, method: str, path: str, body: bytes = b"") -> tuple[int, dict]:
        url = urlparse(path)
        args = {k: v[-1] for k, v in parse_qs(url.query).items()}
        try:
            if url.path == "/health":
                return 200, {"ok": True}
            if url.path == "/api/info":
                return 200, self.info()
            if url.path == "/api/search" and self.index is not None and self.queries:
                return 200, self.search_planted(int(args.get("j", time.time_ns())), int(args.get("nprobe", self.nprobe)), int(args.get("k", self.k)))
            if url.path == "/api/search_vector" and method == "POST":
                asked = json.loads(body)
                vector = asked["vector"]
                if len(vector) != self.d or not all(isinstance(x, (int, float)) for x in vector):
                    return 400, {"error": f"vector must hold {self.d} numbers"}
                return 200, self.search_vector(vector, int(asked.get("k", 24)))
            if url.path == "/search":
                if self.encoder is None:
                    return 503, {"error": "no encoder"}
                return (200, self.search_text(args["q"], int(args.get("k", 24)))) if args.get("q") else (400, {"error": "q is empty"})
        except (ValueError, KeyError, TypeError) as e:
            return 400, {"error": str(e)}
        return 404, {"error": "not found"}


def serve(service: Service, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            status, out = service.handle(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer  # noqa: N815

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
