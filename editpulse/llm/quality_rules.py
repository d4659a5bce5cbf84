"""Robust multivariate outliers among text statistics, per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editpulse.llm import words as w
from editpulse.llm.frames import row_of
from editpulse.sources.staging import stage

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MARKS = b".,;:!?"
#: Transformed statistics and the least standard deviation that an estimate may give each.
STATISTICS = {
    "word_length": 0.10, "symbols": 0.10, "capitals": 0.10, "dup_lines": 0.25, "repeats": 0.10, "variety": 0.05, "marks": 0.10,
}
SUBSET = 0.75
STEPS = 6
BINS_PER_OCTAVE = 8
REWEIGHT = 0.975
SHORT_TEXT_WORDS = 30
#: Squared distances above this quantile of a chi-squared distribution are rejected. The floors under
#: the deviations keep ordinary texts far below it.
CUTOFF = 0.99
#: Rows that a wider estimate counts for beside a cell's own; the widest has the least deviations.
PRIOR_ROWS = 200
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi2_quantile(q: float, p: int) -> float:
    """Chi-squared quantile by the Wilson-Hilferty approximation."""
    a = 2 / (9 * p)
    return p * (1 - a + NormalDist().inv_cdf(q) * math.sqrt(a)) ** 3


def chi2_share(x: float, p: int) -> float:
    a = 2 / (9 * p)
    return NormalDist().cdf(((x / p) ** (1 / 3) - 1 + a) / math.sqrt(a))


def consistency(share: float, p: int) -> float:
    """Factor that makes the covariance of the innermost ``share`` consistent for normal data."""
    if share >= 1:
        return 1.0
    return share / chi2_share(chi2_quantile(share, p), p + 2)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags between consecutive offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])[offsets])


def _member(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_SYMBOL, _MARK = _member(SYMBOLS), _member(MARKS)
_CAPITAL, _LETTER = _member(bytes(range(65, 91))), _member(bytes([*range(65, 91), *range(97, 123)]))


def _duplicate_lines(texts: w.Texts, starts: np.ndarray) -> np.ndarray:
    """Lines that hold a word and equal an earlier line of their text, counted per text."""
    out = np.zeros(len(texts), np.int64)
    bounds = np.searchsorted(starts, texts.offsets)
    breaks = np.searchsorted(np.flatnonzero(texts.data == 10), texts.offsets)
    for i in np.flatnonzero(np.diff(breaks)).tolist():
        if bounds[i] == bounds[i + 1]:
            continue
        lines = [x for x in texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().split(b"\n") if x.strip(w.SPACES)]
        out[i] = len(lines) - len(set(lines))
    return out


def _repeats_and_variety(hashes: np.ndarray) -> tuple[int, int]:
    """Words of one text inside repeated windows, and its distinct words."""
    n = len(hashes)
    distinct = len(np.unique(hashes))
    if n <= REPEAT_WINDOW:
        return 0, distinct
    grams = w.grams(hashes, REPEAT_WINDOW)
    _, back, count = np.unique(grams, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[back] > 1)
    if not len(again):
        return 0, distinct
    edge = np.zeros(n + 1, np.int64)
    edge[again] += 1
    edge[again + REPEAT_WINDOW] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum()), distinct


def text_statistics(texts: w.Texts) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` and the transformed ``STATISTICS`` of every text."""
    found = w.words(texts, w.NOT_SPACE)
    bounds = w.rows(found, len(texts))
    n = np.diff(bounds)
    inside = w.NOT_SPACE[texts.data]
    chars = _per_text(inside & w.code_points(texts.data), texts.offsets)
    symbols = _per_text(_SYMBOL[texts.data], texts.offsets)
    marks = _per_text(_MARK[texts.data], texts.offsets)
    capitals = _per_text(_CAPITAL[texts.data], texts.offsets)
    letters = _per_text(_LETTER[texts.data], texts.offsets)
    dup = _duplicate_lines(texts, found.start)
    lines = 1 + _per_text(texts.data == 10, texts.offsets)
    both = [_repeats_and_variety(found.hash[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    repeat, distinct = (np.array(x, np.int64) for x in zip(*both, strict=True)) if both else (np.zeros(0, np.int64),) * 2
    some = np.maximum(n, 1)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat,
        "word_length": np.log(np.maximum(chars, 1) / some),
        "symbols": np.sqrt(symbols / np.maximum(chars, 1)),
        "capitals": np.sqrt(capitals / np.maximum(letters, 1)),
        "dup_lines": np.sqrt(dup / lines),
        "repeats": np.sqrt(repeat / some),
        "variety": np.log(np.maximum(distinct, 1)) / np.log(np.maximum(n, 2)),
        "marks": np.sqrt(marks / np.maximum(chars, 1)),
    }


def measured(documents: DataFrame, carry: Iterable[str] | None = None) -> DataFrame:
    """``row``, ``lang``, ``source`` and the statistics of every row of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in w.slices(batches, "text", 1 << 20):
            stats = text_statistics(w.text_bytes(part.column("text")))
            columns = [part.column("row"), part.column("lang"), part.column("source")]
            columns += [pa.array(stats[c], pa.int64()) for c in COUNTS] + [pa.array(stats[c], pa.float64()) for c in STATISTICS]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "lang", "source", *COUNTS, *STATISTICS])

    frame = documents.select(row_of(documents, carry), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    kind = frame.schema["row"].dataType.simpleString()
    fields = [f"row {kind}", "lang string", "source string", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in STATISTICS)]
    return frame.mapInArrow(run, ", ".join(fields))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


CELL = ["start", "level", "cell_lang", "cell_source"]


def _placed(stats: DataFrame, level: Column) -> DataFrame:
    """The rows with the columns ``CELL``: level 0 is a language's source, 1 a language, 2 all texts."""
    named = lambda name, most: F.when(F.col("level") <= most, F.coalesce(F.concat(F.lit("="), name), F.lit(""))).otherwise("")
    placed = stats.withColumn("level", level)
    return placed.withColumn("cell_lang", named("lang", 1)).withColumn("cell_source", named("source", 0)).drop("lang", "source")


def _start(stats: DataFrame) -> DataFrame:
    """Per cell a centre and diagonal spread from counts of fine bins: medians and quartile ranges."""
    bins_per_unit = 256
    fine = stats.select(
        "lang", "source", F.posexplode(F.array(*[F.floor(F.col(c) * bins_per_unit) for c in STATISTICS])).alias("stat", "bin")
    ).groupBy("lang", "source", "stat", "bin").agg(F.count("*").alias("n"))
    levels = _placed(fine.withColumn("start", F.lit(0)), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    binned = levels.groupBy(*CELL, "stat", "bin").agg(F.sum("n").alias("n"))
    key = [*CELL, "stat"]
    running = Window.partitionBy(*key).orderBy("bin")
    total = Window.partitionBy(*key)
    ranked = binned.withColumn("upto", F.sum("n").over(running)).withColumn("all", F.sum("n").over(total))
    quartile = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) + 0.5) / bins_per_unit
    each = ranked.groupBy(*key).agg(quartile(0.25).alias("q1"), quartile(0.5).alias("q2"), quartile(0.75).alias("q3"), F.max("all").alias("total"))
    return each.groupBy(*CELL).agg(
        F.array_sort(F.collect_list(F.struct("stat", "q1", "q2", "q3"))).alias("quartiles"), F.max("total").alias("total")
    )


def _packed(stats: DataFrame) -> DataFrame:
    """Rows of one cell and batch as one row: ``cell_lang``, ``cell_source`` and ``values``, word
    number and statistics text after text. Nothing is shuffled for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pa.Table.from_batches([batch.select(["cell_lang", "cell_source"])]).to_pandas()
            groups = cells.groupby(["cell_lang", "cell_source"], sort=False).ngroup().to_numpy()
            values = np.column_stack([batch.column(c).to_numpy().astype(float) for c in ["n_words", *STATISTICS]])
            order = np.argsort(groups, kind="stable")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(groups))])
            first = pa.array(order[bounds[:-1]])
            lists = pa.ListArray.from_arrays(pa.array((bounds * values.shape[1]).astype(np.int32)), pa.array(values[order].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cell_lang").take(first), batch.column("cell_source").take(first), lists],
                names=["cell_lang", "cell_source", "values"],
            )

    placed = _placed(stats, F.lit(0)).select("cell_lang", "cell_source", "n_words", *STATISTICS)
    return stage(placed.mapInArrow(run, "cell_lang string, cell_source string, values array<double>"), "packed")


OWN = "start int, level int, cell_lang string, cell_source string, total long, centre array<double>, covariance array<double>, size double"
_LISTS = pa.list_(pa.float64())


def _floors() -> np.ndarray:
    return np.diag(np.array(list(STATISTICS.values())) ** 2)


def _own_rows(cells: pa.RecordBatch, centres: list[np.ndarray], covariances: list[np.ndarray]) -> pa.RecordBatch:
    """Estimates of cells by themselves; ``size`` is the logarithm of the determinant."""
    sizes = pa.array([float(np.linalg.slogdet(c + _floors())[1]) for c in covariances], pa.float64())
    lists = pa.array(centres, _LISTS), pa.array([c.ravel() for c in covariances], _LISTS)
    columns = [*(cells.column(c) for c in [*CELL, "total"]), *lists, sizes]
    return pa.RecordBatch.from_arrays(columns, names=[*CELL, "total", "centre", "covariance", "size"])


def _from_quartiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cells in batches:
        tables = [np.array([[q["q1"], q["q2"], q["q3"]] for q in x]) for x in cells.column("quartiles").to_pylist()]
        yield _own_rows(cells, [t[:, 1] for t in tables], [np.diag(((t[:, 2] - t[:, 0]) / 1.349) ** 2) for t in tables])


def _innermost(bins: pa.Table, subset: float, edge: int | None) -> pa.Table:
    """The estimate of one cell from its bins of distance, at most a few hundred rows: moments of the
    innermost bins that hold the share ``subset``, and of all bins up to ``edge``."""
    p = len(STATISTICS)
    upper = np.triu_indices(p)
    bins = bins.sort_by("bin")
    sums = np.array(bins.column("sums").to_pylist())
    upto, total = np.cumsum(sums[:, 0]), sums[:, 0].sum()
    inside = upto - sums[:, 0] < subset * total
    if edge is not None:
        inside |= bins.column("bin").to_numpy() <= edge
    moments = sums[inside].sum(axis=0)
    n = moments[0]
    centre = moments[1 : p + 1] / n
    second = np.zeros((p, p))
    second[upper] = moments[p + 1 :] / n
    second = second + np.triu(second, 1).T
    covariance = (second - np.outer(centre, centre)) * consistency(min(1.0, n / total), p)
    cell = bins.select(CELL).slice(0, 1).append_column("total", pa.array([int(total)], pa.int64()))
    return pa.Table.from_batches([_own_rows(cell.combine_chunks().to_batches()[0], [centre], [covariance])])


Estimate = tuple[np.ndarray, np.ndarray]


def towards(own: Estimate, rows: int, wider: Estimate) -> Estimate:
    """Centre and covariance of ``rows`` texts together with ``PRIOR_ROWS`` texts like the wider ones."""
    share = PRIOR_ROWS / (rows + PRIOR_ROWS)
    apart = own[0] - wider[0]
    covariance = (1 - share) * own[1] + share * wider[1] + share * (1 - share) * np.outer(apart, apart)
    return (1 - share) * own[0] + share * wider[0], covariance


def _family(row: dict) -> list[Estimate]:
    """Centres and inverse covariances of a cell, its language and all texts, each drawn to the wider one."""
    p = len(STATISTICS)
    estimate, found = (np.array(row["all_centre"]), _floors()), []
    for prefix in ("all_", "lang_", ""):
        own = np.array(row[f"{prefix}centre"]), np.array(row[f"{prefix}covariance"]).reshape(p, p)
        estimate = towards(own, row[f"{prefix}total"], estimate)
        found.append((np.round(estimate[0], 9), np.round(np.linalg.inv(estimate[1] + _floors()), 9)))
    return found[::-1]


def _families(own: DataFrame) -> DataFrame:
    """Per start and cell of level 0 its estimate beside its language's and that of all texts.

    Written, so that Spark sees its size and broadcasts a small one without shuffling packed texts.
    """
    values = ["total", "centre", "covariance"]
    langs = own.where("level = 1").select("start", "cell_lang", *(F.col(c).alias(f"lang_{c}") for c in values))
    every = own.where("level = 2").select("start", *(F.col(c).alias(f"all_{c}") for c in values))
    cells = own.where("level = 0").select("start", "cell_lang", "cell_source", *values)
    return stage(cells.join(langs, ["start", "cell_lang"]).join(every, "start"), "families")


def _models(own: DataFrame) -> DataFrame:
    """``CELL``, ``centre`` and ``inverse`` of every cell of level 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in batches:
            found = [_family(row)[0] for row in cells.to_pylist()]
            lists = pa.array([c for c, _ in found], _LISTS), pa.array([i.ravel() for _, i in found], _LISTS)
            names = ["start", "cell_lang", "cell_source"]
            level = pa.array(np.zeros(len(found), np.int32))
            yield pa.RecordBatch.from_arrays([*(cells.column(c) for c in names), level, *lists], names=[*names, "level", "centre", "inverse"])

    kinds = "start int, cell_lang string, cell_source string, level int, centre array<double>, inverse array<double>"
    return stage(_families(own).mapInArrow(run, kinds), "estimate")


def _with_distance(rows: DataFrame, model: DataFrame, how: str) -> DataFrame:
    """Squared Mahalanobis distance; less for short texts, whose statistics vary more."""
    names = list(STATISTICS)
    p = len(names)
    diff = [f"({c} - centre[{i}])" for i, c in enumerate(names)]
    terms = [f"{1 if i == j else 2} * inverse[{i * p + j}] * {diff[i]} * {diff[j]}" for i in range(p) for j in range(i, p)]
    shrink = f"(n_words / (n_words + {SHORT_TEXT_WORDS}D))"
    return rows.join(model, CELL, how).withColumn("distance", F.expr(f"if(centre IS NULL, NULL, {shrink} * greatest(0D, {' + '.join(terms)}))"))


BINNED = "start int, level int, cell_lang string, cell_source string, bin int, sums array<double>"
#: Binned moments that a task holds before it passes them on.
HELD_BINS = 20_000


def _binned_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and products of packed texts per cell of each level and bin of distance, added up
    within the task."""
    p = len(STATISTICS)
    upper = np.triu_indices(p)
    held: dict[tuple, np.ndarray] = {}

    def release() -> pa.RecordBatch:
        keys = list(zip(*held, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
        columns = [pa.array(key, kind) for key, kind in zip(keys, kinds, strict=True)]
        out = pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), _LISTS)], names=[*CELL, "bin", "sums"])
        held.clear()
        return out

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            values = row.column("values").flatten().to_numpy().reshape(-1, p + 1)
            family = row.drop_columns(["values"]).to_pylist()[0]
            words, x = values[:, 0], values[:, 1:]
            moments = np.column_stack([np.ones(len(x)), x, x[:, upper[0]] * x[:, upper[1]]])
            places = [(family["cell_lang"], family["cell_source"]), (family["cell_lang"], ""), ("", "")]
            for level, (place, (centre, inverse)) in enumerate(zip(places, _family(family), strict=True)):
                apart = x - centre
                distance = words / (words + SHORT_TEXT_WORDS) * np.maximum(((apart @ inverse) * apart).sum(axis=1), 0)
                bins = np.floor(np.log2(np.maximum(distance, 1e-6)) * BINS_PER_OCTAVE).astype(np.int32)
                order = np.argsort(bins, kind="stable")
                found, first = np.unique(bins[order], return_index=True)
                for k, sums in zip(found.tolist(), np.add.reduceat(moments[order], first), strict=True):
                    key = (family["start"], level, *place, k)
                    held[key] = held[key] + sums if key in held else sums
            if len(held) > HELD_BINS:
                yield release()
    if held:
        yield release()


def _step(packed: DataFrame, own: DataFrame, subset: float = SUBSET, reweight: bool = False) -> DataFrame:
    """One concentration step: moments of the share ``subset`` of rows nearest to the present estimate.

    Distances are counted in logarithmic bins, with moments per bin; the innermost bins that hold
    the subset give the next estimate, so one aggregation is a whole step for all starts and levels.
    """
    p = len(STATISTICS)
    size = 1 + p + p * (p + 1) // 2
    edge = math.floor(math.log2(chi2_quantile(REWEIGHT, p)) * BINS_PER_OCTAVE) if reweight else None
    near = packed.join(_families(own), ["cell_lang", "cell_source"]).mapInArrow(_binned_moments, BINNED)
    binned = near.groupBy(*CELL, "bin").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums"))
    return stage(binned.groupBy(*CELL).applyInArrow(lambda bins: _innermost(bins, subset, edge), OWN), "moments")


def estimates(passed: DataFrame) -> DataFrame:
    """The minimum-covariance-determinant estimate of every source of a language: ``CELL``, ``centre``, ``inverse``.

    Two starts, medians with quartile ranges and the moments of all rows, take ``STEPS`` steps each.
    Per cell the subset with the least determinant of all these is kept and reweighted.
    """
    packed = _packed(passed)
    quartiles = stage(_start(passed).mapInArrow(_from_quartiles, OWN), "moments")
    moments = _step(packed, quartiles, subset=1.0)
    own, seen = quartiles.unionByName(moments.withColumn("start", F.lit(1))), []
    for _ in range(STEPS):
        own = _step(packed, own)
        seen.append(own)
    best = F.min_by(F.struct("total", "centre", "covariance", "size"), "size").alias("best")
    least = reduce(DataFrame.unionByName, seen).groupBy(*CELL[1:]).agg(best)
    least = stage(least.select(F.lit(0).alias("start"), *CELL[1:], "best.*"), "moments")
    return _models(_step(packed, least, reweight=True))


def judge(documents: DataFrame, carry: Iterable[str] | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """Per row of ``documents`` (text, lang, source): ``row`` (the columns ``carry``, all by
    default), the counts of ``COUNTS``, ``base_failed``, ``distance`` and ``kept``.

    A text fails the base rules with fewer than ten words or with over a fifth of its words inside
    repeated five-word windows. The others are rejected when the squared Mahalanobis distance of
    their transformed statistics from the minimum-covariance-determinant estimate of their language
    and source exceeds a chi-squared quantile. Estimation uses every text that passes the base rules:
    concentration steps from two starts (each step one aggregation with map-side combining, so one
    source with a third of the rows is no bottleneck), the least determinant of all, and a reweighted
    step. A cell's estimate counts ``PRIOR_ROWS`` rows like its language's beside its own, the
    language's as many like those of all texts, and that of all texts as many of the least deviations:
    cells of all sizes are judged by one rule, and few texts reject hardly anything.

    Null and empty texts have no words and fail; their distance is null. A null language or source
    is a cell of its own. Repeated rows count repeatedly, and get equal verdicts, as do texts at
    equal distance; a distance at the quantile itself is kept. Empty tables give empty results. Very
    long texts are read whole. The columns lang and source choose a cell only; other columns are not
    read unless carried.
    """
    stats = stage(measured(documents, carry).withColumn("base_failed", base_failed()), "statistics")
    model = estimates(stats.where("NOT base_failed").select("lang", "source", "n_words", *STATISTICS))
    far = F.col("distance") > chi2_quantile(cutoff, len(STATISTICS))
    judged = _with_distance(_placed(stats, F.lit(0)).withColumn("start", F.lit(0)), model, "left")
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), F.col("distance")))
    return judged.select("row", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"))
