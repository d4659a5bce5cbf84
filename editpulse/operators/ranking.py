"""Exact ranks, running sums and quantiles without a single-task window.

A window over a whole column would put all rows into one task.  Here the values are
condensed to distinct ones, cut into slices of similar size by approximate quantiles,
and summed per slice; a running value is then the sum of all earlier slices plus a
window inside the own slice.  The cut points only balance the work: the result is exact
wherever they fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from editpulse.sources.staging import stage

SLICE_VALUES = 1_000_000


def running_sums(
    df: DataFrame, order: str, sums: dict[str, Column], series: str | None = None, slices: int | None = None
) -> DataFrame:
    """Running sums in ascending ``order``, one row per distinct value.

    ``sums`` maps names to row values.  Every name ``x`` yields ``x`` (sum at this value),
    ``x_upto`` (sum up to and including it) and ``x_all`` (overall sum).  With ``series`` each
    value of that column has its own sequence.  Rows with a NULL ``order`` are left out.
    """
    series_column = F.col(series) if series else F.lit(0)
    distinct = stage(
        df.where(F.col(order).isNotNull())
        .groupBy(series_column.alias("series"), order)
        .agg(*(F.sum(value).alias(name) for name, value in sums.items())),
        "distinct-values",
    )
    if slices is None:  # about SLICE_VALUES distinct values in each
        largest = distinct.groupBy("series").count().agg(F.max("count")).first()[0] or 0
        slices = max(64, -(-largest // SLICE_VALUES))
    shares = [place / slices for place in range(1, slices)]
    # Written once: both readers below must see the same cut points.
    cuts = stage(distinct.groupBy("series").agg(F.percentile_approx(order, shares, 1_000).alias("cuts")), "cut-points")
    sliced = distinct.join(cuts, "series").select(
        "series", order, *sums, F.expr(f"size(filter(cuts, cut -> cut < {order}))").alias("slice")
    )
    # at most ``slices`` rows per series from here to the join
    earlier = W.partitionBy("series").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("series")
    per_slice = sliced.groupBy("series", "slice").agg(*(F.sum(name).alias(name) for name in sums))
    offsets = per_slice.select(
        "series",
        "slice",
        *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_before") for name in sums),
        *(F.sum(name).over(every).alias(f"{name}_all") for name in sums),
    )
    inside = W.partitionBy("series", "slice").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    result = sliced.join(offsets, ["series", "slice"]).select(
        F.col("series").alias(series or "series"),
        order,
        *sums,
        *((F.sum(name).over(inside) + F.col(f"{name}_before")).alias(f"{name}_upto") for name in sums),
        *(f"{name}_all" for name in sums),
    )
    return result if series else result.drop("series")


def as_series(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """Long form of numeric columns: ``keep..., feature, value``."""
    doubles = df.select(*keep, *(F.col(name).cast("double") for name in columns))
    return doubles.unpivot(list(keep), list(columns), "feature", "value")


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Median of every column, NULLs left out; a column without values has none."""
    if not columns:
        return {}
    ranked = running_sums(as_series(df, columns), "value", {"n": F.lit(1)}, "feature")
    lower = F.floor((F.col("n_all") + 1) / 2)
    upper = F.floor(F.col("n_all") / 2) + 1
    rows = (
        ranked.groupBy("feature")
        .agg(
            F.min(F.when(F.col("n_upto") >= lower, F.col("value"))).alias("low"),
            F.min(F.when(F.col("n_upto") >= upper, F.col("value"))).alias("high"),
        )
        .collect()
    )  # one row per column
    return {row["feature"]: (row["low"] + row["high"]) / 2 for row in rows}
