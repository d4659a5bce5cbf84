"""Scores against explicit pairs, and accuracy on labels that were held out."""

import zlib

import numpy as np
import pyarrow as pa

from editpulse.llm import quality_classifier as qc
from editpulse.llm import words as w


def test_score_equals_explicit_pairs():
    rng = np.random.default_rng(0)
    machine = qc.Machine(0.3, rng.normal(size=qc.N_FEATURES), rng.normal(size=(qc.N_FEATURES, 3)) / 10)
    texts = [None, "", "a b a c", "x " * 40, "Ü!! ###"]
    index, value, bounds = qc.features(w.text_bytes(pa.array(texts)), np.array([-1, 0, 7, 80, 10**9]))
    got = machine.score(index, value, bounds)
    for k in range(len(texts)):
        i, x = index[bounds[k] : bounds[k + 1]], value[bounds[k] : bounds[k + 1]]
        assert len(set(i.tolist())) == len(i)
        margin = machine.intercept + (machine.linear[i] * x).sum()
        margin += sum(machine.factors[i[a]] @ machine.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(got[k], 1 / (1 + np.exp(-margin)))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("quality", qc.F.when(qc.held_out(), 1 - qc.F.col("quality")).otherwise(qc.F.col("quality")))
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    scores = {r.row.doc_id: r.score for r in qc.score_quality(docs, flipped, ["doc_id"]).collect()}  # held-out labels can't leak in
    good = [scores[d] for d, q in truth.items() if q == 1]
    bad = [scores[d] for d, q in truth.items() if q == 0]
    assert len(good) + len(bad) > 50
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean(np.array(good) >= qc.THRESHOLD) > 0.95 and np.mean(np.array(bad) < qc.THRESHOLD) > 0.7


def test_odd_rows(spark):
    rows = [(1, None, None, 9), (None, "", 5, 9), (3, "a b", -4, 9), (3, "a b", -4, 9), (4, "x " * 3000, 1 << 60, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score int")
    labels = spark.createDataFrame([(3, 1, None), (None, 0, None), (9, None, None)], "doc_id long, quality int, toxic int")
    assert sorted(r.score for r in qc.score_quality(docs, labels).collect()) == [0.5] * 5
    both = spark.createDataFrame([(d, d % 2, 0) for d in range(5)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    scores = [r.score for r in qc.score_quality(docs.drop("n_chars"), both).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert qc.score_quality(docs.limit(0), labels.limit(0)).collect() == []
