"""LM scoring: plain counts, a model that doesn't depend on the layout, held-out gain."""

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vexel.llm import op1_lm

SCHEMA = "doc_id long, text string"


def corpus(n, seed=1):
    """Texts of two sorts whose next word depends on the one before."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"{'ab'[i % 2]}{k}" for k in range(40)]
        at, text = r.randrange(40), []
        for _ in range(r.randint(0, 120)):
            at = (at + r.choice((1, 1, 1, 2, 7))) % 40
            text.append(words[at].upper() if r.random() < 0.1 else words[at])
        rows.append((i, r.choice((" ", "\n", "\t")).join(text)))
    return rows + [(n, None), (n + 1, ""), (None, "a1 a2"), (3, rows[3][1]), (n + 2, "never seen ß x")]


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus(600)
    return rows, op1_lm.lm_scores(spark.createDataFrame(rows, SCHEMA).repartition(1)).collect()


def test_base_score_is_a_plain_count(scored):
    rows, got = scored
    tokens = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x20\x09-\x0d]+", t or "")] + [""]
    out = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    count: dict[str, int] = {}
    for i, t in rows:
        if not out[i]:
            for w in tokens(t):
                count[w] = count.get(w, 0) + 1
    total, distinct = sum(count.values()), len(count)
    want = sorted((str(i), out[i], len(tokens(t)), sum(w in count for w in tokens(t)), round(sum(math.log10((count.get(w, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}


def test_layout_has_no_part_in_scores(spark, scored, monkeypatch):
    rows, got = scored
    again = op1_lm.lm_scores(spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(5)).repartition(16)).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.base_score, 6))
    for a, b in zip(sorted(got, key=key), sorted(again, key=key), strict=True):
        assert key(a) == key(b) and abs(a.score - b.score) < 1e-3 * max(1, a.n_tokens)


def test_held_out_texts_are_likelier_than_by_counts(scored):
    held = [r for r in scored[1] if r.held_out and r.doc_id is not None]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_without_training_texts(spark):
    got = op1_lm.lm_scores(spark.createDataFrame([(None, "a b"), (None, None)], SCHEMA)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
