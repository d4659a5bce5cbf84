"""Stupid-backoff language-model scores from n-gram counts of the whole corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editpulse.llm import words as w
from editpulse.llm.frames import row_of

ORDER = 3
BACKOFF = 0.4
#: Text of one block, and text whose n-grams fill one bucket of the count tables.
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 4 << 20


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; differences of sorted hashes have few distinct high bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of the sorted keys begins; buckets are equal ranges of hashes."""
    step = (1 << 64) // buckets
    edges = np.array([b * step for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their way to the blocks; a null is an empty text."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [pack((text or "").encode()) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("row"), pa.array(packed, pa.binary())], names=["block", "row", "text"])


def _spoken(texts: pa.ChunkedArray) -> tuple[w.Words, int]:
    unpack = zstandard.ZstdDecompressor().decompress
    whole = pa.array((unpack(text.as_py()) for text in texts), pa.large_binary(), size=len(texts)).cast(pa.large_string())
    return w.words(w.text_bytes(whole), w.NOT_SPACE, lower=True), len(whole)


def _grams(found: w.Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of an order that lie inside one text, and where they begin."""
    start = np.flatnonzero(w.within(found, order))
    return w.grams(found.hash, order)[start], start


def token_scores(found: w.Words, n_texts: int, order: int, counts_of: Callable[[int], np.ndarray], corpus_words: int) -> np.ndarray:
    """Natural logarithm of every word's score; ``counts_of`` gives the corpus counts of all distinct n-grams of an order, by hash.

    A text's own n-grams are taken out of all counts, so it is scored by the other texts. One order is held at a time.
    """
    size = len(found.hash)
    lengths = np.bincount(found.text, minlength=n_texts) if size else np.zeros(n_texts, np.int64)
    place = np.arange(size) - np.searchsorted(found.text, found.text)
    highest = np.minimum(order, place + 1).astype(np.int8)
    del place
    context = np.maximum(corpus_words - lengths[found.text], 1).astype(float)
    score = BACKOFF ** highest.astype(float) / context
    for n in range(1, order + 1):
        hashes, start = _grams(found, n)
        keys, slot = np.unique(hashes, return_inverse=True)
        left = np.zeros(size, np.int64)
        left[start] = counts_of(n)[slot]
        slot += found.text[start] * np.int64(max(len(keys), 1))
        del keys, hashes
        _, back, own = np.unique(slot, return_inverse=True, return_counts=True)
        left[start] -= own[back]
        del slot, back, own
        seen = start[left[start] > 0]
        word = seen + n - 1
        score[word] = BACKOFF ** (highest[word] - n).astype(float) * left[seen] / context[seen]
        context = left.astype(float)
    return np.log(score)


def score_texts(
    documents: DataFrame, carry: Iterable[str] | None = None, order: int = ORDER, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Per row of ``documents`` (text): ``row`` (the columns ``carry``, all by default), ``n_words``
    and ``log_score``, the summed natural logarithms of its words' stupid-backoff scores.

    A word after its context of n - 1 words scores count(n-gram) / count(context) for the longest n
    up to ``order`` with a positive count, times 0.4 for each step back; a word seen nowhere else
    steps back once more to one over the number of words. Counts cover all other rows of the table:
    a row's own n-grams don't vouch for it, and copies vouch for each other.

    Texts are dealt into blocks by hash. A block explodes its n-grams, combines equal ones and sends
    the distinct hashes with their counts to the buckets that partition the count tables by hash; a
    bucket joins them with the summed counts and answers each block in the same order, and blocks
    sum scores per text. Equal n-grams cross the network once a block, packed in sorted runs, so a
    frequent n-gram is no hot key. Blocks and buckets take in a fixed amount of text each, so their
    numbers follow the input and memory does not; a longer text is a block of its own size. Rows
    without doc_id are dealt by their place in the input, so copies without one do not meet in one block.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Null and empty texts have no
    words and score 0. Repeated rows count repeatedly. Empty tables give empty results. Other
    columns are not read unless carried.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_blocks, n_buckets = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    kind = documents.select(row_of(documents, carry)).schema["row"].dataType.simpleString()
    key = F.xxhash64(F.monotonically_increasing_id())
    if "doc_id" in documents.columns:
        key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(key)
    blocks = documents.select(F.pmod(key, F.lit(n_blocks)).cast("int").alias("block"), row_of(documents, carry), "text")
    blocks = blocks.mapInArrow(_packed_texts, f"block int, row {kind}, text binary")

    def ask(table: pa.Table) -> pa.Table:
        found, _ = _spoken(table.column("text"))
        block = table.column("block")[0].as_py()
        out: dict[str, list] = {c: [] for c in ("block", "bucket", "n", "n_words", "keys", "counts")}
        for n in range(1, order + 1):
            keys, counts = np.unique(_grams(found, n)[0], return_counts=True)
            bounds = _bucket_bounds(keys, n_buckets).tolist()
            for bucket, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if a < b or n == 1:  # every bucket learns the number of words of every block
                    cells = (block, bucket, n, len(found.hash) if n == 1 else 0, pack_sorted(keys[a:b]), _pack(counts[a:b].astype(np.uint32)))
                    for column, cell in zip(out.values(), cells, strict=True):
                        column.append(cell)
        return pa.table(out, schema=ASKED)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        total = sum(r["n_words"] for r in rows)
        out: dict[str, list] = {c: [] for c in ("block", "bucket", "n", "n_words", "keys", "counts")}
        for n in range(1, order + 1):
            asked = [r for r in rows if r["n"] == n]
            runs = [unpack_sorted(r["keys"]) for r in asked]
            if not runs:
                continue
            keys, back = np.unique(np.concatenate(runs), return_inverse=True)
            counts = np.bincount(back, np.concatenate([_unpack(r["counts"], np.uint32) for r in asked]), len(keys)).astype(np.int64)
            first = 0
            for r, run in zip(asked, runs, strict=True):
                here = counts[back[first : first + len(run)]]
                first += len(run)
                cells = (r["block"], r["bucket"], n, total, b"", _pack(here.astype(np.uint64)))
                for column, cell in zip(out.values(), cells, strict=True):
                    column.append(cell)
        return pa.table(out, schema=ASKED)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        found, n_texts = _spoken(table.column("text"))
        none = np.empty(0, np.int64)
        found = w.Words(none, none, found.text, found.hash)  # places of words are not needed any more
        by_order: dict[int, list[tuple[int, bytes]]] = {}
        for bucket, n, counts in zip(*(answers.column(c).to_pylist() for c in ("bucket", "n", "counts")), strict=True):
            by_order.setdefault(n, []).append((bucket, counts))

        def counts_of(n: int) -> np.ndarray:
            parts = [_unpack(x, np.uint64).astype(np.int64) for _, x in sorted(by_order.pop(n, []))]
            return np.concatenate(parts) if parts else none

        corpus = max(answers.column("n_words").to_pylist(), default=0)
        sums = np.bincount(found.text, token_scores(found, n_texts, order, counts_of, corpus), n_texts) if len(found.hash) else np.zeros(n_texts)
        sizes = np.bincount(found.text, minlength=n_texts) if len(found.hash) else np.zeros(n_texts, np.int64)
        return pa.table({"row": table.column("row"), "n_words": pa.array(sizes.astype(np.int64)), "log_score": pa.array(sums.astype(np.float64))})

    layout = "block int, bucket int, n int, n_words long, keys binary, counts binary"
    asked = blocks.groupBy("block").applyInArrow(ask, layout)
    answered = asked.groupBy("bucket").applyInArrow(answer, layout)
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, f"row {kind}, n_words long, log_score double")


ASKED = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("n_words", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
