"""Personal data: base patterns, high-recall candidates and boosted trees that choose among them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editpulse.llm import words as w
from editpulse.llm.frames import row_of
from editpulse.llm.pii_spans import CANDIDATE, KINDS, base_spans, candidates
from editpulse.sources.staging import stage

#: Bound on the candidates that the trees are fitted on; more are thinned by a hash.
TRAIN_CANDIDATES = 20_000
TREES, DEPTH = 15, 3
MIN_PRECISION = 0.9
_SPANS = "array<struct<kind:string,start:int,end:int>>"
_CANDIDATES = "array<struct<kind:string,start:int,end:int,role:int,f:array<double>>>"


def scan(documents: DataFrame, carry: Iterable[str] | None = None) -> DataFrame:
    """``row``, a 64-bit ``key``, base spans and candidates of every row; one pass over the texts."""
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    candidate_type = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("role", pa.int32()), ("f", pa.list_(pa.float64()))])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in w.slices(batches, "text"):
            base, found = [], []
            for text in part.column("text").to_pylist():
                spans = base_spans(text or "")
                base.append([s._asdict() for s in spans])
                found.append(candidates(text or "", spans))
            columns = [part.column("row"), part.column("key"), pa.array(base, span_type), pa.array(found, candidate_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "base", "candidates"])

    frame = documents.select(row_of(documents, carry), F.xxhash64("doc_id", "text").alias("key"), "text")
    kind = frame.schema["row"].dataType.simpleString()
    return frame.mapInArrow(run, f"row {kind}, key long, base {_SPANS}, candidates {_CANDIDATES}")


def fit(examples: DataFrame, train_candidates: int = TRAIN_CANDIDATES) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """Boosted trees and a threshold per kind, from weakly labelled ``examples`` (key, kind, role, f).

    Base spans and variants are positive, other proposals negative. A fifth of all examples, by
    hash, calibrates and is never fitted on: a kind's threshold is the lowest at which
    ``MIN_PRECISION`` of what is above it is positive, and more than 1 where there is none. Of the
    rest a bounded sample is fitted. None without both classes.
    """
    part = 1 << 30
    known = examples.withColumn("label", (F.col("role") != CANDIDATE).cast("double"))
    total = known.count()
    rows = known.withColumn("draw", F.pmod(F.xxhash64("key", "kind", "f"), F.lit(part)))
    held_out = F.col("draw") % 5 == 0
    sample = rows.where(~held_out & (F.col("draw") < round(part * min(1.0, train_candidates / max(total, 1)))))
    sample = stage(sample.select("label", "f"), "examples").coalesce(4)
    sample = sample.select("label", array_to_vector("f").alias("features")).cache()
    if sample.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3, maxBins=16).fit(sample)
    scored = model.transform(rows.where(held_out).select("kind", "label", array_to_vector("f").alias("features")))
    scored = scored.select("kind", "label", F.round(vector_to_array("probability")[1], 6).alias("p")).where("p >= 0.5")
    levels = scored.groupBy("kind", "p").agg(F.sum("label").alias("hits"), F.count("*").alias("n")).collect()  # bounded by the rounding
    sample.unpersist()
    return model, {kind: _threshold([(r["p"], r["hits"], r["n"]) for r in levels if r["kind"] == kind]) for kind in KINDS}


def _threshold(levels: list[tuple[float, float, int]]) -> float:
    """The lowest observed level from one half on with enough precision; one half if no level lacks it."""
    best, hits, n, all_pass = 2.0, 0.0, 0, True
    for p, h, m in sorted((x for x in levels if x[0] >= 0.5), reverse=True):
        hits, n = hits + h, n + m
        all_pass = hits >= MIN_PRECISION * n
        best = p if all_pass else best
    return 0.5 if n and all_pass else best


def find_personal_data(documents: DataFrame, carry: Iterable[str] | None = None, train_candidates: int = TRAIN_CANDIDATES) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): ``row`` (the columns ``carry``, all by default),
    ``base`` (spans of the base patterns) and ``spans`` (these and the selected candidates).

    Offsets are code points, ends exclusive, in order of start and kind. Generators with high recall
    propose looser formats, among them spelled-out addresses and numbers without a plus; spans may
    overlap. Boosted trees score format and context; candidates above their kind's threshold join,
    the better of two that overlap. Base spans always stay.

    One pass over whole texts writes spans and features; the model is fitted on a bounded sample of
    them, calibrated on a fifth of all and scores all. Only candidates are shuffled, by row key, never a text.

    Null and empty texts have no spans. Repeated rows get equal results. Without examples of both
    classes the base spans are the result. Empty tables give empty results. Other columns are not
    read unless carried.
    """
    rows = stage(scan(documents, carry), "spans")
    each = rows.select("key", F.explode("candidates").alias("c")).select("key", "c.*").distinct()
    fitted = fit(each.select("key", "kind", "role", "f"), train_candidates)
    if fitted is None:
        return rows.select("row", "base", F.col("base").alias("spans"))
    model, limits = fitted
    scored = model.transform(each.where(F.col("role") == CANDIDATE).withColumn("features", array_to_vector("f")))
    p = F.round(vector_to_array("probability")[1], 6)
    limit = F.create_map(*(F.lit(x) for kind in KINDS for x in (kind, limits[kind])))[F.col("kind")]
    chosen = (
        scored.select("key", "kind", "start", "end", p.alias("p")).where(F.col("p") >= limit)
        .groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end", "p")).alias("chosen"))
    )

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            spans = []
            for base, more in zip(part.column("base").to_pylist(), part.column("chosen").to_pylist(), strict=True):
                kept: list[dict] = []
                for s in sorted(more or [], key=lambda s: (-s["p"], s["start"], -s["end"], s["kind"])):
                    if all(s["end"] <= t["start"] or t["end"] <= s["start"] for t in kept):
                        kept.append({k: s[k] for k in ("kind", "start", "end")})
                spans.append(sorted(base + kept, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            column = pa.array(spans, part.schema.field("base").type)
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("base"), column], names=["row", "base", "spans"])

    joined = rows.select("row", "key", "base").join(chosen, "key", "left").select("row", "base", "chosen")
    kind = rows.schema["row"].dataType.simpleString()
    return joined.mapInArrow(select, f"row {kind}, base {_SPANS}, spans {_SPANS}")
