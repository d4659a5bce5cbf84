"""Benchmark passages in documents, found by winnowed fingerprints and extended word by word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editpulse.llm import words as w
from editpulse.llm.frames import long_lists, row_key, row_of
from editpulse.sources.staging import stage

WINDOW_WORDS = 10
GRAM_WORDS = 5


def _grams_and_window(span: int) -> tuple[int, int]:
    """Words a gram and grams a window, so that every shared run of ``span`` words is found."""
    size = min(GRAM_WORDS, span)
    return size, span - size + 1


def winnowed(found: w.Words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest gram hash of every run of ``span`` words and the run's text, equal neighbours once.

    Two texts that share a run of ``span`` words share the smallest hash of that run.
    """
    size, window = _grams_and_window(span)
    hashes = w.grams(found.hash, size)
    count = len(found.hash) - span + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    least = hashes[:count].copy()
    for k in range(1, window):
        np.minimum(least, hashes[k : k + count], out=least)
    text = found.text[:count]
    keep = w.within(found, span)
    keep[1:] &= (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~keep[:-1]
    return least[keep], text[keep]


def _fingerprints(frame: DataFrame, spans: Iterable[int] | None, window: int) -> DataFrame:
    """``key`` and the list ``marks`` of every text; without ``spans`` each text has its own span."""
    spans = None if spans is None else sorted(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in w.slices(batches, "text"):
            texts = w.text_bytes(part.column("text"))
            found = w.words(texts, w.LETTERS_DIGITS, lower=True)
            lengths = np.diff(w.rows(found, len(texts)))
            own = np.minimum(lengths, window)
            marks, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for span in spans if spans is not None else [int(x) for x in np.unique(own) if x]:
                values, text = winnowed(found, span)
                use = slice(None) if spans is not None else own[text] == span
                marks.append(values[use])
                of.append(text[use])
            value, text = np.concatenate(marks), np.concatenate(of)
            if len(marks) > 2:
                order = np.argsort(text, kind="stable")
                value, text = value[order], text[order]
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            out = [part.column("key"), long_lists(value.view(np.int64), bounds), pa.array(own, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=["key", "marks", "span"])

    return frame.select("key", "text").mapInArrow(run, "key long, marks array<bigint>, span int")


def find_leaks(
    documents: DataFrame, benchmark: DataFrame, carry: Iterable[str] | None = None, window: int = WINDOW_WORDS
) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): ``row`` (the columns ``carry``, all by default),
    ``n_words``, ``n_hit`` (words inside any occurrence of a benchmark window) and ``items``
    (sorted distinct ids, as strings, of ``benchmark`` (item_id, text) rows with an occurrence).

    Words are runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. A window is
    ``window`` consecutive words of an item, or all words of a shorter item.

    Winnowing keeps the smallest hash of five-word grams in every run of a window's length, so any
    shared window has a fingerprint in common; shorter items have fingerprints for their own length.
    Documents joined to an item by a fingerprint carry its text, and every window of these items
    is looked up in the whole document. The benchmark's fingerprints are a written table, so Spark
    broadcasts them only while that is under the session's limit and shuffles both sides beyond it.

    Null and empty texts have no words and no windows. Rows without doc_id are searched like others;
    an item without item_id is reported as "null". Repeated rows are each reported, repeated items
    once. Empty tables give no rows, or rows without hits. Other columns are not read unless carried.
    """
    items = benchmark.select("item_id", "text").withColumn("key", F.xxhash64("item_id", "text"))
    known = stage(_fingerprints(items, None, window).select("span", F.col("key").alias("item"), F.explode("marks").alias("mark")).distinct(), "marks")
    spans = [r["span"] for r in known.select("span").distinct().collect()]  # at most `window` values
    keyed = documents.select(row_of(documents, carry), "text", row_key().alias("key"))
    marked = _fingerprints(keyed, spans, window).select("key", F.explode("marks").alias("mark"))
    pairs = marked.join(known.select("item", "mark"), "mark").select("key", "item").distinct()
    texts = items.select(F.col("key").alias("item"), F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), "text").distinct()
    candidates = pairs.join(texts, "item").groupBy("key").agg(F.collect_list(F.struct("id", "text")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in w.slices(batches, "text"):
            texts = w.text_bytes(part.column("text"))
            bounds = w.rows(w_found := w.words(texts, w.LETTERS_DIGITS, lower=True), len(texts)).tolist()
            lists = part.column("found").to_pylist()
            hits, ids = [], []
            for first, last, found in zip(bounds[:-1], bounds[1:], lists, strict=True):
                n, named = _extend(w_found.hash[first:last], found or [], window)
                hits.append(n)
                ids.append(named)
            columns = [part.column("row"), pa.array(np.diff(bounds), pa.int64()), pa.array(hits, pa.int64()), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "n_hit", "items"])

    joined = keyed.join(candidates, "key", "left").select("row", "text", "found")
    kind = keyed.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {kind}, n_words long, n_hit long, items array<string>")


def _extend(hashes: np.ndarray, found: list[dict], window: int) -> tuple[int, list[str]]:
    """Words of one document inside windows of its candidate items, and the items that occur."""
    if not found:
        return 0, []
    items = w.words(w.text_bytes(pa.array([x["text"] for x in found], pa.string())), w.LETTERS_DIGITS, lower=True)
    bounds = w.rows(items, len(found))
    edge = np.zeros(len(hashes) + 1, np.int64)
    named: set[str] = set()
    grams: dict[int, np.ndarray] = {}
    for x, first, last in zip(found, bounds[:-1], bounds[1:], strict=True):
        size = min(window, int(last - first))
        if not size or size > len(hashes):
            continue
        if size not in grams:
            grams[size] = w.grams(hashes, size)
        at = np.flatnonzero(np.isin(grams[size], w.grams(items.hash[first:last], size)))
        if len(at):
            named.add(x["id"])
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), sorted(named)
