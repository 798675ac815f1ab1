"""Toxicity: the lexicon counts every token, the scan uses every score, documents that are rejected go."""

import random

import numpy as np

from vexel.llm import common, op6_toxicity


def corpus(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(400)]
    bad = [f"vile{x}" for x in "abcdefgh"]
    rows, labels = [], []
    for i in range(n):
        text = r.choices(words, k=r.randint(0, 60))
        toxic = i % 4 == 0
        if toxic:
            at = r.randint(0, len(text))
            text[at:at] = r.choices(bad, k=3) + r.choices(words, k=2) + r.choices(bad, k=2)
        elif i % 40 == 1:
            text.append(r.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_train_counts_every_token(spark):
    rows, labels = corpus(600)
    model = op6_toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    from pyspark.sql import functions as F

    fold = spark.createDataFrame(rows, "doc_id long, text string").where(~common.held_out(op6_toxicity.HELD)).where(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) > 0)
    use, counts, size = {r.doc_id for r in fold.collect()}, {}, [0, 0]
    for (i, text), (_, y) in zip(rows, labels, strict=True):
        if i in use:
            size[1 - y] += 1
            for w in set(op6_toxicity.tokens(text)):
                counts.setdefault(w, [0, 0])[1 - y] += 1
    want = op6_toxicity.Lexicon.fit(sorted((w, *n) for w, n in counts.items()), *size)
    assert model.lexicon == want
    assert len({round(s, 9) for s in want.words.values()}) > 100  # scores of their own, also below zero


def test_clean_forms_of_a_prefix_count():
    hit, forms = (b"ababacus", 6, 3), [(f"abab{k}".encode(), 0, 1) for k in range(1500)]
    alone = op6_toxicity.Lexicon.fit([hit], 200, 1800).words[hit[0]]
    assert op6_toxicity.Lexicon.fit([hit, *forms], 200, 1800).words[hit[0]] < alone


def test_best_segment_equals_scan():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 40):
        for _ in range(50):
            s = np.round(r.normal(-0.2, 1, n), 3)
            brute = max([0.0] + [s[a:b].sum() for a in range(n) for b in range(a + 1, n + 1)])
            assert abs(op6_toxicity.best_segment(s) - brute) < 1e-9
            found = op6_toxicity.passages_of(s)
            assert abs(max([0.0] + [x for *_, x in found]) - brute) < 1e-9
            assert all(abs(x - s[a:b].sum()) < 1e-9 for a, b, x in found)
            assert all(p[1] <= q[0] for p, q in zip(found, found[1:], strict=False))


def test_toxic_documents_are_rejected_and_clean_ones_stay(spark):
    rows, labels = corpus(1200, seed=3)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, score string, best long")
    model = op6_toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    y = dict(labels)
    scores = {r.doc_id: r for r in op6_toxicity.toxicity_scores(docs, model).collect()}
    out = [i for i in y if scores[i].held_out]
    assert sum(scores[i].predicted for i in out if y[i]) >= 0.95 * sum(y[i] for i in out)
    assert sum(scores[i].predicted for i in out if not y[i]) <= 0.02 * len(out)
    stays = op6_toxicity.reject_toxic(docs, model)
    assert stays.columns == docs.columns
    assert {r.doc_id for r in stays.collect()} == {i for i in y if not scores[i].predicted}


def test_one_class_only(spark):
    rows, labels = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for y in (0, 1):
        model = op6_toxicity.train(docs, spark.createDataFrame([(i, y) for i, _ in labels], "doc_id long, toxic int"))
        got = op6_toxicity.toxicity_scores(docs, model).collect()
        assert len(got) == len(rows) and all(r.score < 1e-6 and not r.predicted and not r.passages for r in got)
