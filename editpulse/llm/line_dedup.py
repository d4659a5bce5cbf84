"""Lines that many documents repeat, dropped everywhere but in one of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editpulse.llm import words as w
from editpulse.llm.frames import kind_of, row_key, row_of, salted_join

MIN_CODE_POINTS = 20
MIN_DOCUMENTS = 3


def line_key(line: bytes, least: int) -> bytes | None:
    """128-bit hash of a normalised line, or None if it is shorter than ``least`` code points."""
    key = line.strip(w.SPACES).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def _lines(texts: w.Texts) -> Iterator[list[bytes]]:
    for first, last in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True):
        yield texts.data[first:last].tobytes().split(b"\n")


def drop_common_lines(
    documents: DataFrame,
    carry: Iterable[str] | None = None,
    min_code_points: int = MIN_CODE_POINTS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): ``row`` (the columns ``carry``, all by default),
    ``kept_text``, ``n_lines`` before dropping and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at
    least ``min_code_points`` in at least ``min_documents`` documents lose their lines except in
    the largest doc_id that holds them. Lines keep their order.

    Distinct line hashes leave each document once; (hash, document) is aggregated before hash, so
    a line that a third of the corpus repeats is spread over tasks and counted map-side; it meets its
    documents again over salted keys. Documents then meet the list of their own dropped hashes, so
    only texts are shuffled, not lines.

    A null or empty text is one empty line. Rows without doc_id count as no document and lose
    every common line. Rows of one doc_id are one document; each keeps what that document keeps.
    Empty tables give empty results. Other columns are not read unless carried.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in w.slices(batches, "text"):
            found = [list({k for x in lines if (k := line_key(x, min_code_points))}) for lines in _lines(w.text_bytes(part.column("text")))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array(found, pa.list_(pa.binary()))], names=["doc_id", "key", "lines"]
            )

    kind = kind_of(documents, "doc_id")
    held = (
        documents.select("doc_id", row_key().alias("key"), "text")
        .mapInArrow(hashes, f"doc_id {kind}, key long, lines array<binary>")
        .select("doc_id", "key", F.explode("lines").alias("line"))
    )
    common = (
        held.where("doc_id IS NOT NULL").groupBy("line", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))
        .where(F.col("n") >= min_documents).select("line", "holder")
    )
    dropped = (
        salted_join(held, common, "line", "key").where("doc_id IS NULL OR doc_id < holder")
        .groupBy("key").agg(F.collect_set("line").alias("lines"))
    )

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in w.slices(batches, "text"):
            kept, before, gone = [], [], []
            for lines, drop in zip(_lines(w.text_bytes(part.column("text"))), part.column("lines").to_pylist(), strict=True):
                left = lines
                if drop:
                    drop = set(drop)
                    left = [x for x in lines if line_key(x, min_code_points) not in drop]
                kept.append(b"\n".join(left))
                before.append(len(lines))
                gone.append(len(lines) - len(left))
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            columns = [part.column("row"), texts, pa.array(np.array(before, np.int64)), pa.array(np.array(gone, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "kept_text", "n_lines", "n_dropped"])

    keyed = documents.select(row_of(documents, carry), "text", row_key().alias("key"))
    joined = keyed.join(dropped, "key", "left").select("row", "text", "lines")
    kind = keyed.schema["row"].dataType.simpleString()
    return joined.mapInArrow(reassemble, f"row {kind}, kept_text string, n_lines long, n_dropped long")
