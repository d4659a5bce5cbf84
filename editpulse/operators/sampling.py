"""Repeatable splits and samples by hashed row id.

The hash of an id does not depend on partitioning, file order or cluster size, so the
same rows are drawn on every run.  Cut-off hashes are found exactly: counts per hash
prefix locate the prefix that holds the cut, and only rows with that prefix are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from editpulse.sources.staging import stage

PREFIX_LENGTH = 3  # 4096 prefixes a step


def row_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def _cut_hashes(df: DataFrame, key: str, seed: int, wanted: Column, by: Column) -> DataFrame:
    """``class`` and ``cut``: the hash of the ``wanted``-th row of each class in hash order.

    ``wanted`` may use ``total``, the rows of the class.  Counts per prefix find the prefix that holds
    the row, counts per longer prefix narrow it down, and only rows of that one, about one in 16
    million of a class, are ranked; all classes go through together.
    """
    rows = df.select(by.alias("class"), row_hash(key, seed).alias("hash"))
    everywhere = W.partitionBy("class")
    places = None
    for step in (1, 2):
        prefix = F.substring("hash", 1, step * PREFIX_LENGTH)
        counts = (rows if places is None else _within(rows, places)).groupBy("class", prefix.alias("prefix"), *(["place"] if places is not None else []))
        counts = counts.agg(F.count(F.lit(1)).alias("n"))
        if places is None:
            counts = counts.withColumn("total", F.sum("n").over(everywhere)).withColumn("place", wanted).drop("total")
        upto = F.sum("n").over(everywhere.orderBy("prefix").rowsBetween(W.unboundedPreceding, W.currentRow))
        counts = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
        places = counts.select("class", "prefix", (F.col("place") - F.col("upto") + F.col("n")).alias("place"))
    candidates = _within(rows, places).groupBy("class", "place", "hash").agg(F.count(F.lit(1)).alias("n"))  # copies of an id collapse
    upto = F.sum("n").over(everywhere.orderBy("hash").rowsBetween(W.unboundedPreceding, W.currentRow))
    return candidates.withColumn("upto", upto).where(F.col("upto") >= F.col("place")).groupBy("class").agg(F.min("hash").alias("cut"))


def _within(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of each class whose hash begins with the located prefix."""
    located = places.withColumnRenamed("class", "located")
    return rows.join(located, F.col("class").eqNullSafe(F.col("located")) & F.col("hash").startswith(F.col("prefix"))).select("class", "hash", "place")


def stratified_split(df: DataFrame, target: str, share: float = 0.2, key: str = "user_id", seed: int = 42) -> DataFrame:
    """Add ``is_test``: the given share of every class, rounded to whole rows."""
    wanted = F.floor(F.col("total") * share + 0.5)
    cuts = stage(_cut_hashes(df, key, seed, wanted, F.col(target)), "cuts").withColumnsRenamed({"class": "split_class", "cut": "split_cut"})
    joined = df.join(cuts, F.col(target).eqNullSafe(F.col("split_class")), "left")
    is_test = F.coalesce(row_hash(key, seed) <= F.col("split_cut"), F.lit(False))
    return joined.withColumn("is_test", is_test).drop("split_class", "split_cut")


def stratified_folds(df: DataFrame, target: str, folds: int, key: str = "user_id", seed: int = 42) -> DataFrame:
    """Add ``fold``, 0 to ``folds - 1``: each class is cut into folds in hash order, whose sizes differ by at most one.

    The hashes at all cuts of all classes are located together, and rows only compare their hash with
    the cuts of their class.
    """
    rows = df.select(F.col(target).alias("class"), row_hash(key, seed + 1).alias("hash"))
    whole, rest = F.floor(F.col("total") / folds), F.col("total") % folds
    places = F.array(*(F.greatest(whole * k + F.least(rest, F.lit(k)), F.lit(0)) for k in range(1, folds)))
    cuts = _cuts_at(rows, places).groupBy("class").agg(F.sort_array(F.collect_list("cut")).alias("fold_cuts"))
    cuts = stage(cuts, "fold-cuts").withColumnRenamed("class", "fold_class")
    joined = df.join(cuts, F.col(target).eqNullSafe(F.col("fold_class")), "left").withColumn("fold_hash", row_hash(key, seed + 1))
    passed = F.expr("coalesce(size(filter(fold_cuts, c -> c < fold_hash)), 0)")
    empty = F.coalesce(F.lit(folds - 1) - F.size("fold_cuts"), F.lit(0))  # cuts before the first row of a small class
    return joined.withColumn("fold", (passed + F.greatest(empty, F.lit(0))).cast("int")).drop("fold_class", "fold_cuts", "fold_hash")


def _cuts_at(rows: DataFrame, places: Column) -> DataFrame:
    """``class``, ``number`` and ``cut``: the hash at each of the ``places`` (an array that may use ``total``) of every class.

    Works as ``_cut_hashes``, with every place followed on its own.
    """
    prefix = F.substring("hash", 1, PREFIX_LENGTH)
    counts = rows.groupBy("class", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("class").orderBy("prefix").rowsBetween(W.unboundedPreceding, W.currentRow))
    counts = counts.withColumn("total", F.sum("n").over(W.partitionBy("class"))).withColumn("upto", upto)
    found = counts.select("class", "prefix", "n", "upto", F.posexplode(places).alias("number", "place"))
    at = (F.col("place") > 0) & (F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place"))
    located = found.where(at).select(F.col("class").alias("of"), "number", "prefix", (F.col("place") - F.col("upto") + F.col("n")).alias("place"))
    inside = rows.groupBy("class", "hash").agg(F.count(F.lit(1)).alias("n")).join(
        located, F.col("class").eqNullSafe(F.col("of")) & (prefix == F.col("prefix"))
    )
    upto = F.sum("n").over(W.partitionBy("class", "number").orderBy("hash").rowsBetween(W.unboundedPreceding, W.currentRow))
    reached = inside.withColumn("upto", upto).where(F.col("upto") >= F.col("place"))
    return reached.groupBy("class", "number").agg(F.min("hash").alias("cut"))


def sample_rows(df: DataFrame, n: int, key: str = "user_id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows if there are fewer)."""
    cut = _cut_hashes(df, key, seed, F.lit(n), F.lit(0)).first()
    return df.where(row_hash(key, seed) <= cut["cut"]) if cut else df


def resample_rows(df: DataFrame, n: int, key: str = "user_id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` draws with replacement, the same on every run.

    Each of ``n`` draws picks a place in hash order; places come from the rows' own counts per prefix,
    so a row drawn m times appears m times.
    """
    total = df.count()
    if not total:
        return df
    draws = df.sparkSession.range(n).select((F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(total)) + 1).alias("place"))
    drawn = draws.groupBy("place").agg(F.count(F.lit(1)).alias("times"))
    placed = with_places(df, key, seed)
    names = [F.col(f"`{c}`") for c in df.columns]
    return placed.join(drawn, "place").withColumn("again", F.explode(F.expr("sequence(1L, times)"))).select(*names)


def with_places(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with ``place``, their number in hash order, counted per prefix and shifted by earlier ones."""
    hashed = df.withColumn("place_hash", row_hash(key, seed)).withColumn("place_prefix", F.substring("place_hash", 1, PREFIX_LENGTH))
    earlier = W.orderBy("place_prefix").rowsBetween(W.unboundedPreceding, -1)
    shifts = hashed.groupBy("place_prefix").agg(F.count(F.lit(1)).alias("n")).select("place_prefix", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    inside = F.row_number().over(W.partitionBy("place_prefix").orderBy("place_hash"))
    return hashed.join(F.broadcast(shifts), "place_prefix").withColumn("place", inside + F.col("shift")).drop("place_hash", "place_prefix", "shift")  # 4096 prefixes at most


def fold_number(folds: int, key: str = "user_id", seed: int = 42) -> Column:
    """Cross-validation fold of a row, 0 to ``folds - 1``."""
    digits = F.conv(F.substring(row_hash(key, seed + 1), 1, 8), 16, 10).cast("long")
    return F.pmod(digits, F.lit(folds)).cast("int")
