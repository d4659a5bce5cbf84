"""Factorisation machine for text quality: hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editpulse.llm import words as w
from editpulse.llm.frames import row_of
from editpulse.llm.quality_rules import text_statistics
from editpulse.sources.staging import stage

WORD_BITS = 11
FACTORS = 4
ITERATIONS = 80
#: Bound on the labelled rows that the model is fitted on; more labels are thinned by a hash of their id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
HELD_OUT_PART = 5
N_WORD_FEATURES = 1 << WORD_BITS
LENGTH_CLASSES = 24
STRUCTURE = ["symbols", "capitals", "repeats", "dup_lines", "marks", "word_length", "variety", "doubled", "length", "empty"]
N_FEATURES = N_WORD_FEATURES + len(STRUCTURE) + LENGTH_CLASSES


class Machine(NamedTuple):
    """Intercept, linear weights and factor rows of a fitted model."""

    intercept: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of (index, value) features between the bounds.

        All pairwise interactions cost one pass: the sum over pairs of <v_i, v_j> x_i x_j is half
        the square of the sum of v_i x_i less the sum of their squares, summed over factors.
        """
        terms = self.factors[index] * value[:, None]
        first = bounds[:-1]
        total = np.add.reduceat(terms, first)
        squares = np.add.reduceat(terms * terms, first)
        margin = self.intercept + np.add.reduceat(self.linear[index] * value, first) + 0.5 * (total * total - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def features(texts: w.Texts, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of every text: indices, values and bounds. ``n_chars`` is -1 where unknown.

    Every text has all structure features and one class of its stated length, so no row is empty.
    """
    found = w.words(texts, w.NOT_SPACE, lower=True)
    rows = w.rows(found, len(texts))
    bucket = (found.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    stats = text_statistics(texts)
    same = np.zeros(len(found.hash), bool)
    same[1:] = (found.hash[1:] == found.hash[:-1]) & (found.text[1:] == found.text[:-1])
    n = stats["n_words"]
    stats["doubled"] = np.sqrt(np.diff(np.concatenate([[0], np.cumsum(same)])[rows]) / np.maximum(n, 1))
    stats["length"] = np.log1p(n) / 5
    stats["empty"] = (n == 0).astype(float)
    structure = np.stack([stats[c] for c in STRUCTURE], axis=1)
    known = np.clip(np.floor(np.log2(np.maximum(n_chars, 0) + 1)).astype(np.int64) + 1, 1, LENGTH_CLASSES - 1)
    length_class = np.where(n_chars < 0, 0, known)
    base = np.arange(N_WORD_FEATURES, N_WORD_FEATURES + len(STRUCTURE))
    index, value = [], []
    for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        words, count = np.unique(bucket[a:b], return_counts=True)
        weight = np.log1p(count)
        index += [words, base, [N_WORD_FEATURES + len(STRUCTURE) + int(length_class[i])]]
        value += [weight / max(1.0, float(np.sqrt((weight * weight).sum()))), structure[i], [1.0]]
    bounds = np.cumsum([0, *(sum(map(len, index[k : k + 3])) for k in range(0, len(index), 3))])
    return np.concatenate(index).astype(np.int64), np.concatenate(value).astype(np.float64), bounds


def _stated(part: pa.RecordBatch) -> np.ndarray:
    return np.array([-1 if x is None or x < 0 else x for x in part.column("n_chars").to_pylist()], np.int64)


def _with_length(documents: DataFrame, *columns) -> DataFrame:
    stated = F.col("n_chars").cast("long") if "n_chars" in documents.columns else F.lit(None).cast("long")
    return documents.select(*columns, "text", stated.alias("n_chars"))


def held_out():
    """Whether a row's label is never learned: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_PART == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine | None:
    """A machine fitted to ``labels`` (doc_id, quality) outside the held-out part; None without both classes.

    Labels beyond ``train_rows`` are thinned by a hash of the id. The sample is bounded, so it is
    broadcast to the documents; nothing else is collected or shuffled but gradients.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    total = known.count()
    part = 1 << 30
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) < round(part * min(1.0, train_rows / max(total, 1))))
    rows = _with_length(documents, "doc_id").join(F.broadcast(sample), "doc_id").select("label", "text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "text", 1 << 20):
            index, value, bounds = features(w.text_bytes(batch.column("text")), _stated(batch))
            offsets = pa.array(bounds.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(value))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *lists], names=["label", "i", "v"])

    # For the bounded sample only; explicit zeros are left out, as the gradient expects.
    sparse = F.udf(lambda i, v: Vectors.sparse(N_FEATURES, {a: b for a, b in zip(i, v, strict=True) if b}), VectorUDT())
    train = stage(rows.mapInArrow(run, "label double, i array<int>, v array<double>"), "train")
    if train.select("label").distinct().count() < 2:
        return None
    train = train.select("label", sparse("i", "v").alias("features")).coalesce(4).cache()
    model = FMClassifier(factorSize=FACTORS, maxIter=ITERATIONS, stepSize=0.05, regParam=1e-4, seed=7, initStd=0.05).fit(train)
    train.unpersist()
    return Machine(float(model.intercept), model.linear.toArray(), model.factors.toArray())


def score_quality(documents: DataFrame, labels: DataFrame, carry: Iterable[str] | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of ``documents`` (doc_id, text, n_chars): ``row`` (the columns ``carry``, all by
    default) and ``score``, the probability that ``labels`` (doc_id, quality) call it 1.

    Whole texts are scored, labelled or not. Inputs are hashed words, structure statistics and the
    stated length n_chars; doc_id only finds labels. Null and empty texts have structure features
    alone; a missing n_chars is a class of its own. Without labels of both classes every score is
    0.5. A document labelled twice counts as 1 if either label does. Repeated rows get equal scores.
    Empty tables give empty results. Other columns are not read unless carried.
    """
    machine = fit(documents, labels, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.slices(batches, "text", 1 << 20):
            if machine is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = machine.score(*features(w.text_bytes(batch.column("text")), _stated(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores)], names=["row", "score"])

    frame = _with_length(documents, row_of(documents, carry))
    kind = frame.schema["row"].dataType.simpleString()
    return frame.mapInArrow(run, f"row {kind}, score double")
