"""Near duplicates by bottom-k sketches of shingle sets from one hash function."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editpulse.llm import words as w
from editpulse.llm.frames import kind_of
from editpulse.llm.graph import components
from editpulse.sources.staging import stage

SHINGLE_WORDS = 4
SKETCH = 64
SIMILARITY_PERCENT = 80
#: Retained values that two texts share at least when their similarity is 0.8. The number of shared
#: values among the 64 smallest of the union is hypergeometric with mean 51 or more; 27 or fewer
#: have a probability below 2e-9 for one pair at the very threshold, and less above it.
LEAST_SHARED = 28
LIST_BLOCK = 1024


def shingle_sets(texts: w.Texts, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased; fewer words are one shingle."""
    found = w.words(texts, w.NOT_SPACE, lower=True)
    bounds = w.rows(found, len(texts))
    hashes = w.grams(found.hash, size).view(np.int64)
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if last - first >= size:
            yield np.unique(hashes[first : last - size + 1])
        elif last > first:
            yield w.grams(found.hash[first:last], last - first).view(np.int64)
        else:
            yield np.empty(0, np.int64)


def sketches(documents: DataFrame, shingle: int = SHINGLE_WORDS, k: int = SKETCH, carry: Iterable[str] = ()) -> DataFrame:
    """``doc_id``, the columns ``carry``, ``n_shingles``, ``sig`` (128-bit hash of the whole set) and ``kept_values``, the k smallest."""
    own = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in w.slices(batches, "text"):
            counts, sigs, values = [], [], []
            for s in shingle_sets(w.text_bytes(part.column("text")), shingle):
                counts.append(len(s))
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                values.append(s[:k])
            offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in own),
                    pa.array(counts, pa.int64()),
                    pa.array(sigs, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values))),
                ],
                names=[*own, "n_shingles", "sig", "kept_values"],
            )

    kinds = ", ".join(f"{c} {kind_of(documents, c)}" for c in own)
    return documents.select(*own, "text").mapInArrow(run, f"{kinds}, n_shingles long, sig binary, kept_values array<bigint>")


def _least_shared(n: Column, k: int, percent: int, least: int) -> Column:
    """Values that a set of ``n`` shingles shares at least with any similar one.

    A set small enough that every similar set is retained whole has an exact bound.
    """
    whole = math.floor(k * percent / 100)
    return F.when(n <= whole, F.ceil(n * percent / 100)).otherwise(least)


def inverted_lists(classes: DataFrame, k: int, percent: int, least: int) -> DataFrame:
    """Entries (``value``, ``rep``, ``closeness``), of which any two similar sets share a value.

    Values are ordered by the number of sets that retain them, rarest first, so of two sets with t
    shared values one is among the first (all - t + 1) of either. Values in no other set need no
    list; a set that keeps fewer than t others' values is similar to none. ``closeness`` is the
    share of a set's retained values that other sets retain too.
    """
    rows = classes.where("rep IS NOT NULL").select("rep", "n_shingles", F.explode("kept_values").alias("value"))
    common = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    need = _least_shared(F.col("n_shingles"), k, percent, least)
    return (
        rows.join(common, "value")
        .groupBy("rep", "n_shingles")
        .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("shared"))
        .withColumn("need", need.cast("int"))
        .where("size(shared) >= need")
        .withColumn("closeness", F.size("shared") / F.least("n_shingles", F.lit(k)))
        .select("rep", "closeness", F.explode(F.expr("slice(shared, 1, size(shared) - need + 1)")).alias("s"))
        .select("rep", "closeness", F.col("s.value").alias("value"))
    )


def _may_be_similar(k: int, percent: int, least: int) -> Column:
    """Filter on the union sketch of two retained value lists ``x`` and ``y``; exact for whole sets."""
    union = F.array_union("x", "y")
    both = F.array_intersect("x", "y")
    whole = (F.col("nx") <= k) & (F.col("ny") <= k)
    lowest = F.slice(F.array_sort(union), 1, k)
    sketched = F.size(F.array_intersect(both, lowest)) * k >= least * F.size(lowest)
    return F.when(whole, F.size(both) * 100 >= F.size(union) * percent).otherwise(sketched)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (``u``, ``v``) whose full shingle sets are similar; ``texts`` holds rep and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(iter([batch]), "tu"):
                left = shingle_sets(w.text_bytes(part.column("tu")), shingle)
                right = shingle_sets(w.text_bytes(part.column("tv")), shingle)
                keep = []
                for a, b in zip(left, right, strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    kind = kind_of(texts, "rep")
    return (
        pairs.join(texts.select(F.col("rep").alias("u"), F.col("text").alias("tu")), "u")
        .join(texts.select(F.col("rep").alias("v"), F.col("text").alias("tv")), "v")
        .select("u", "v", "tu", "tv")
        .mapInArrow(run, f"u {kind}, v {kind}")
        .distinct()
    )


def _full_entries(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Rarest-first prefixes of full sets among ``texts`` (rep, text): value, rep, n, pos, leads.

    With N shingles in the smaller of two similar sets, at least 2p / (100 + p) * N are shared, and
    p / 100 of the larger set's. So their first common value, in rarest-first order, is among the
    first N - ceil(2p / (100 + p) * N) + 1 of the smaller set (``leads``) and, with N now the larger
    set's size, among the first N - ceil(p / 100 * N) + 1 of the larger one.
    """
    kind = kind_of(texts, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in w.slices(batches, "text", 1 << 20):
            sets = list(shingle_sets(w.text_bytes(part.column("text")), shingle))
            sizes = np.array([len(x) for x in sets])
            columns = [pa.array(np.concatenate(sets)), part.column("rep").take(pa.array(np.repeat(np.arange(len(sets)), sizes)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(sizes, sizes))], names=["value", "rep", "n"])

    rows = texts.select("rep", "text").mapInArrow(run, f"value long, rep {kind}, n long")
    common = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    n = F.col("n")
    most = (n - F.ceil(n * percent / 100) + 1).cast("int")
    leading = n - F.ceil(n * 2 * percent / (100 + percent)) + 1
    alone = n - F.size("shared")
    return (
        rows.join(common, "value")
        .groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("shared"))
        .where(alone < most)
        .select("rep", "n", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), (most - alone).cast("int"))).alias("k", "s"))
        .select(F.col("s.value").alias("value"), "rep", "n", (F.col("alone") + F.col("k")).alias("pos"))
        .withColumn("leads", F.col("pos") < leading)
    )


def _across_components(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (``u``, ``v``) from lists of several components ``c`` that sizes and positions allow.

    The members of a list's largest component meet only the others of that list. A list is dealt out
    over blocks of its members, so a long one is spread over tasks.
    """
    counts = entries.groupBy("value", "c").agg(F.count("*").alias("m")).groupBy("value").agg(
        F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("kinds"),
        F.ceil(F.sum("m") / LIST_BLOCK).cast("int").alias("blocks"),
    )
    placed = entries.join(counts.where("kinds > 1"), "value").withColumn("is_main", F.col("c") == F.col("main"))
    names = ["rep", "n", "pos", "leads", "c"]
    one = placed.where("NOT is_main").select("value", *(F.col(x).alias(f"{x}1") for x in names), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    two = placed.select("value", *(F.col(x).alias(f"{x}2") for x in names), "is_main", F.expr("cast(pmod(xxhash64(rep), blocks) as int)").alias("block"))
    first_is_smaller = F.struct("n1", "rep1") < F.struct("n2", "rep2")
    need = F.ceil((F.col("n1") + F.col("n2")) * percent / (100 + percent))
    return (
        one.join(two, ["value", "block"])
        .where((F.col("c1") != F.col("c2")) & (F.col("is_main") | (F.col("rep1") < F.col("rep2"))))
        .where(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent)
        .where(F.when(first_is_smaller, F.col("leads1")).otherwise(F.col("leads2")))
        .where(F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) >= need)
        .select(F.greatest("rep1", "rep2").alias("u"), F.least("rep1", "rep2").alias("v"))
        .distinct()
    )


def near_duplicates(
    documents: DataFrame,
    shingle: int = SHINGLE_WORDS,
    percent: int = SIMILARITY_PERCENT,
    k: int = SKETCH,
    least: int = LEAST_SHARED,
    carry: Iterable[str] = (),
) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    The columns ``carry`` follow, to tell the rows of one doc_id and those without any apart.

    Words are runs of anything but ASCII white space, A-Z lower-cased; two documents are linked
    when 100 * shared shingles >= ``percent`` * all shingles of both. ``component_id`` is the
    smallest doc_id reachable over links.

    1. Equal sets are one class, represented by its smallest doc_id, so copies never pair up.
    2. Inverted lists of retained values hold candidates only (see ``inverted_lists``).
    3. Each class is compared with one class of each of its lists, the one closest to the others,
       and of these the pair with the largest overlap is verified. A group of near copies fuses
       around its centre without pairing up.
    4. Lists that still hold more than one component name the classes left to compare. Among these,
       prefixes of the full sets, sizes and positions leave few pairs across components (see
       ``_full_entries``). The union sketch filters, full sets decide, and components are joined again.

    Null and empty texts have no shingles and are linked with nothing. Texts under one repeated
    doc_id count as one document. A row without doc_id takes the component of an equal set that has
    one, else it stays alone with a null component and is kept. An empty table has an empty result.
    Other columns are ignored.
    """
    carry = list(carry)
    each = stage(sketches(documents, shingle, k, carry), "sketches")
    full = each.where("n_shingles > 0")
    classes = stage(
        full.groupBy("sig").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("kept_values").alias("kept_values")
        ),
        "classes",
    )
    lists = stage(inverted_lists(classes, k, percent, least), "lists")
    kept = classes.where("rep IS NOT NULL").join(lists.select("rep").distinct(), "rep", "left_semi")
    kept = stage(kept.select("rep", "n_shingles", "kept_values"), "candidates")
    texts = documents.select(F.col("doc_id").alias("rep"), "text").join(kept.select("rep"), "rep", "left_semi")
    texts = stage(texts, "candidate-texts")
    left = kept.select(F.col("rep").alias("u"), F.col("kept_values").alias("x"), F.col("n_shingles").alias("nx"))
    right = kept.select(F.col("rep").alias("v"), F.col("kept_values").alias("y"), F.col("n_shingles").alias("ny"))
    similar = _may_be_similar(k, percent, least)

    centre = F.max_by("rep", F.struct("closeness", -F.col("rep")))
    hubs = lists.groupBy("value").agg(centre.alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = lists.join(hubs, "value").where("rep != v").select(F.col("rep").alias("u"), "v").distinct()
    overlap = F.size(F.array_intersect("x", "y")) / F.sqrt(F.col("nx") * F.col("ny").cast("double"))
    best = (
        stars.join(left, "u").join(right, "v").where(similar)
        .groupBy("u").agg(F.max_by("v", F.struct(overlap, -F.col("v"))).alias("v"))
    )
    first = stage(confirmed(best, texts, shingle, percent), "links")

    roots = stage(components(first), "roots")
    of_rep = roots.select(F.col("node").alias("rep"), "root")
    placed = lists.select("value", "rep").join(of_rep, "rep", "left").withColumn("c", F.coalesce("root", "rep"))
    mixed = placed.groupBy("value").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    open_reps = stage(lists.join(mixed, "value", "left_semi").select("rep").distinct(), "open")
    entries = _full_entries(texts.join(open_reps, "rep", "left_semi"), shingle, percent).join(of_rep, "rep", "left")
    entries = stage(entries.withColumn("c", F.coalesce("root", "rep")).drop("root"), "entries")
    rest = _across_components(entries, percent).join(left, "u").join(right, "v").where(similar).select("u", "v")
    second = confirmed(rest, texts, shingle, percent)
    roots = components(first.unionByName(second)).withColumnRenamed("node", "rep")
    by_class = classes.select("sig", "rep").join(roots, "rep", "left").select("sig", F.coalesce("root", "rep").alias("component"))
    return (
        each.select("doc_id", "n_shingles", "sig", *carry).join(by_class, "sig", "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *carry)
    )


def survivors(documents: DataFrame, shingle: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The rows of ``documents`` (doc_id, text) that stay: one of each group, that of the smallest doc_id.

    An id under several texts names several documents, each with a verdict of its own; of those in
    one group, the text with the smallest hash stays. Of rows that repeat id and text one stays, the
    one whose columns as JSON have the smallest hash. Rows without doc_id go where their words equal
    those of a document with one. Null and empty texts are no copies of anything but rows that
    repeat them under one id. All columns are kept; an empty table has an empty result.
    """
    keyed = documents.select(F.col("doc_id").alias("own_id"), "text", F.xxhash64("text").alias("text_key"))
    rows = stage(keyed.groupBy("own_id", "text_key").agg(F.count("*").alias("n")), "row-counts")
    own = F.col("own_id")
    if not rows.where("own_id IS NOT NULL").groupBy("own_id").count().where("count > 1").isEmpty():
        own = F.when(own.isNotNull(), F.xxhash64("own_id", "text"))
    judged = near_duplicates(keyed.select("*", own.alias("doc_id")), shingle, percent, carry=["own_id", "text_key"])
    alone = F.when(F.col("component_id").isNull(), F.col("text_key")).alias("alone")
    first = F.min(F.struct(F.col("own_id").isNull().alias("unnamed"), "own_id", "text_key")).alias("first")
    kept = judged.groupBy("component_id", alone).agg(first).select("first.own_id", "first.text_key")

    def of(frame: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        same = frame["doc_id"].eqNullSafe(keys["own_id"]) & (F.xxhash64(frame["text"]) == keys["text_key"])
        return frame.join(keys, same, how)

    out = of(documents, kept, "left_semi")
    repeats = rows.where("n > 1")
    if repeats.isEmpty():
        return out
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    single = of(out, repeats, "left_semi").groupBy("doc_id", "text").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row"))
    return of(out, repeats, "left_anti").unionByName(single.select("row.*"))
