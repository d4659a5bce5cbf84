"""Credentials in texts, told from copied examples by how many owners share them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editpulse.llm import words as w
from editpulse.llm.frames import row_of, salted_join
from editpulse.sources.staging import stage

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token")
#: A value in more owners or repositories than these is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
MIN_ENTROPY = 3.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_CUE = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_PLACEHOLDER = re.compile(r"example|sample|changeme|placeholder|dummy|your|xxxx|(.)\1{5}|0123456|1234567|abcdef", re.IGNORECASE)


class Secret(NamedTuple):
    kind: str
    start: int
    end: int
    value: str


def entropy(value: str) -> float:
    """Bits a character, from the value's own character counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    return entropy(value) >= MIN_ENTROPY and not _PLACEHOLDER.search(value)


def base_spans(text: str) -> list[Secret]:
    """Spans of the three base patterns with their secret values, by start and kind."""
    found = []
    if _CUE.search(text):
        found += [Secret("assign", m.start(), m.end(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [Secret("access", m.start(), m.end(), m.group()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    found += [Secret("hex", m.start(), m.end(), m.group()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def proposed_spans(text: str, base: list[Secret]) -> Iterator[Secret]:
    """Long mixed tokens of high entropy that overlap no base span."""
    k = 0
    ordered = sorted((s.start, s.end) for s in base)
    for m in _TOKEN.finditer(text):
        value = m.group()
        if value.isalpha() or not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value) or not looks_live(value):
            continue
        while k < len(ordered) and ordered[k][1] <= m.start():
            k += 1
        if all(a >= m.end() or b <= m.start() for a, b in ordered[k : k + 8]):
            yield Secret("token", m.start(), m.end(), value)


_SPAN = "struct<kind:string,start:int,end:int,hash:binary,live:boolean>"


def scan(documents: DataFrame, owner: Column, repository: Column, carry: Iterable[str] | None = None) -> DataFrame:
    """``row``, ``key``, ``owner``, ``repository`` and all spans of every row, with hashes of their values."""
    span_type = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary()), ("live", pa.bool_())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in w.slices(batches, "text"):
            spans = []
            for text in part.column("text").to_pylist():
                base = base_spans(text or "")
                spans.append(
                    [
                        {"kind": s.kind, "start": s.start, "end": s.end, "hash": xxhash.xxh3_128_digest(s.value.encode()), "live": looks_live(s.value)}
                        for s in (*base, *proposed_spans(text or "", base))
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("row", "key", "owner", "repository")] + [pa.array(spans, span_type)],
                names=["row", "key", "owner", "repository", "found"],
            )

    frame = documents.select(
        row_of(documents, carry), F.xxhash64("doc_id", "text").alias("key"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), "text"
    )
    kind = frame.schema["row"].dataType.simpleString()
    return frame.mapInArrow(run, f"row {kind}, key long, owner string, repository string, found array<{_SPAN}>")


def ownership(found: DataFrame) -> DataFrame:
    """``hash``, ``owners`` and ``repositories``: in how many distinct ones each value occurs.

    A repository belongs to its owner. Each level is combined map-side, so a value that a third of
    the corpus copies is one row a task and owner.
    """
    return (
        found.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner").agg(F.count("*").alias("n"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    )


def find_secrets(
    documents: DataFrame,
    owner: Column | None = None,
    repository: Column | None = None,
    carry: Iterable[str] | None = None,
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """Per row of ``documents`` (doc_id, text, lang, source): ``row`` (the columns ``carry``, all by
    default), ``base`` (spans of the base patterns), ``spans`` (these and selected candidates), each
    with a ``verdict``: "live", "example" or "weak".

    Offsets are code points, ends exclusive, by start and kind. Candidates are long mixed tokens of
    high entropy. Hashes of all values, base and candidate, are aggregated over the whole corpus by
    distinct owner (source by default) and repository (source and lang). A value in more than
    ``max_owners`` owners or ``max_repositories`` repositories is a widely copied example; one that
    few share is live if it looks random and like no placeholder, else weak. Base spans always stay;
    candidates join when live.

    Only spans are shuffled, never a text: values by hash, with the few example values joined back
    over salted keys, and verdicts by row key. A null owner or repository is one of its own. Null
    and empty texts have no spans. Repeated rows get equal results and count once. Empty tables
    give empty results. Other columns are not read unless carried.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if repository is None else repository
    rows = stage(scan(documents, owner, repository, carry), "secrets")
    each = rows.select("key", "owner", "repository", F.explode("found").alias("s")).select("key", "owner", "repository", "s.*")
    copied = F.col("owners") > max_owners
    examples = stage(ownership(each).where(copied | (F.col("repositories") > max_repositories)).select("hash"), "examples")
    hits = salted_join(each.select("key", "hash").distinct(), examples, "hash", "key")
    hashes = hits.groupBy("key").agg(F.collect_list("hash").alias("examples"))
    joined = rows.join(hashes, "key", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<binary>")))
    verdict = "CASE WHEN array_contains(examples, s.hash) THEN 'example' WHEN s.live THEN 'live' ELSE 'weak' END"
    named = F.expr(f"transform(found, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'verdict', {verdict}))")
    ordered = "array_sort(filter(judged, s -> s.kind != 'token' OR s.verdict = 'live'), (a, b) -> CASE WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 ELSE 0 END)"
    return joined.withColumn("judged", named).select(
        "row", F.expr("filter(judged, s -> s.kind != 'token')").alias("base"), F.expr(ordered).alias("spans")
    )
