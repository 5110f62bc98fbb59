"""Factors against numpy's decomposition of the whole table; confidences against the minimax form of isotonic regression."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.models import hashing_embedder
from millrace.operators import calibration, factors
from millrace.sources.scratch import written


def test_factors_are_the_decomposition(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(words[i % 3 * 10 : i % 3 * 10 + 20]) for _ in range(r.randint(1, 30))) for i in range(90)] + [None, "", "..."] + ["w1 w2 w3"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    model = factors.fit(docs, rank=6, size=64, more=58)
    rows = [r.cells for r in docs.select(factors.cells(F.col("text"), 64).alias("cells")).collect() if r.cells]
    df = Counter(c for x in rows for c in set(x))
    table = np.zeros((len(rows), 64))
    for i, x in enumerate(rows):
        for c, tf in Counter(x).items():
            table[i, c] = (1 + math.log(tf)) * math.log(1 + len(rows) / df[c])
        table[i] /= np.linalg.norm(table[i])
    _, values, vectors = np.linalg.svd(table)
    assert np.allclose(model.values, values[:6], atol=1e-6)
    assert np.allclose(np.abs((model.basis * vectors[:6].T).sum(axis=0)), 1, atol=1e-4)
    got = {r.doc_id: r.e for r in docs.select("doc_id", factors.embedding(spark, model)(F.col("text")).alias("e")).collect()}
    assert all(len(e) == 6 for e in got.values()) and all(not any(got[i]) for i in (90, 91, 92))
    assert all(abs(sum(x * x for x in got[i]) - 1) < 1e-5 for i in range(90)) and got[93] == got[97]


def test_long_texts_are_cut_nowhere(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c d e " * (50 if i == 3 else 2)) for i in range(6)], "doc_id int, text string").coalesce(1)
    whole = factors.fit(docs, rank=3, size=32, more=29)
    sizes = np.array([0, 5, 7, 0, 1])
    monkeypatch.setattr(factors, "HELD", 6)
    parts = list(factors._parts(np.arange(13), sizes))
    assert [w for _, _, x in parts for w in x] == list(range(13)) and [(a, b) for a, b, _ in parts] == [(0, 2), (2, 3), (3, 5)]
    assert len(whole.values) == 1  # the rows are alike


def test_an_empty_corpus(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    model = factors.fit(docs, rank=4, size=16)
    assert len(model.values) == 0 and docs.select(factors.embedding(spark, model)(F.col("text")).alias("e")).first().e == []


def test_thinned_copies_are_nearer_than_by_hashed_words(spark):
    """Of every second word of a document, the document itself is the nearest more often than among hashed bags."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text").between(300, 5000)).dropDuplicates(["text"]).orderBy("doc_id").select("doc_id", "text")
    rows = docs.collect()
    thin = [" ".join(r.text.split()[::3]) for r in rows]
    run = factors.embedding(spark, factors.fit(docs))
    both = [np.array([r.e for r in spark.createDataFrame(list(enumerate(t)), "i int, text string").select("i", run(F.col("text")).alias("e")).orderBy("i").collect()]) for t in ([r.text for r in rows], thin)]
    embed = hashing_embedder(64)
    plain = [np.array(embed(t)) for t in ([r.text for r in rows], thin)]
    right = [((x[1] @ x[0].T).argmax(axis=1) == np.arange(len(rows))).mean() for x in (both, plain)]
    print("nearest is the document itself: factors, hashed words", right)
    assert right[0] > right[1]


def test_blocks_are_isotonic_regression():
    r = random.Random(9)
    for _ in range(300):
        counts = [(c, n, r.randint(0, n)) for c in sorted(r.sample(range(40), r.randint(0, 12))) for n in [r.randint(1, 6)]]
        blocks = calibration.pooled(counts)
        assert all(a[2] / a[1] < b[2] / b[1] for a, b in zip(blocks, blocks[1:]))
        for i, (cell, _, _) in enumerate(counts):
            share = lambda j, k: sum(x[2] for x in counts[j : k + 1]) / sum(x[1] for x in counts[j : k + 1])
            want = max(min(share(j, k) for k in range(i, len(counts))) for j in range(i + 1))
            got = [b for b in blocks if b[0] <= cell][-1]
            assert abs(got[2] / got[1] - want) < 1e-12


def test_confidences(spark):
    rows = spark.createDataFrame([(0.05, 0), (0.05, 1), (0.35, 0), (0.35, 0), (0.75, 1), (0.95, 1), (0.95, 0), (None, 1), (0.5, None), (0.5, 7), (float("nan"), 1)], "score double, label int")
    asked = rows.withColumn("cell", calibration.cell_of(F.col("score"), 10))
    blocks = calibration.learn(asked, cells=10)
    assert blocks == [(0, 4, 1), (7, 3, 2)]
    got = spark.createDataFrame([(-3.0,), (0.0,), (0.5,), (0.7,), (9.0,), (None,), (float("nan"),)], "score double").select(calibration.confidence(calibration.cell_of(F.col("score"), 10), blocks).alias("p")).collect()
    assert [r.p for r in got] == [0.25, 0.25, 0.25, 2 / 3, 2 / 3, None, None]
    assert calibration.learn(asked.limit(0)) == [] and asked.select(calibration.confidence(F.col("cell"), []).alias("p")).first().p is None
    assert calibration.error(asked.limit(0).withColumn("confidence", F.lit(0.5))).first().asDict() == {"n": 0, "calibration_error": None}


def test_held_out_calibration(spark):
    from millrace.plans.index_queries import diversity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = written(docs.select("doc_id", diversity(F.col("text")).alias("cell")).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id"), "cells")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    blocks = calibration.learn(rows.where(~out))
    said = rows.where(out).withColumn("confidence", calibration.confidence(F.col("cell"), blocks))
    r = calibration.error(said).first()
    raw = calibration.error(rows.where(out).withColumn("confidence", F.col("cell") / 1024)).first()
    print("calibration error: isotonic, raw", r.calibration_error, raw.calibration_error, r.n)
    assert r.n > 100 and r.calibration_error < 0.1 and r.calibration_error < raw.calibration_error
