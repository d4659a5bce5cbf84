"""Quality measures for classifiers and groupings, as DataFrame aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from editpulse.operators.ranking import running_sums
from editpulse.operators.sampling import sample_rows
from editpulse.sources.staging import stage

#: Points of a block at least, blocks of a small table at most, and points of a block at most.
BLOCK_ROWS, PAIR_BLOCKS, BLOCK_LIMIT = 2_000, 24, 32_768
#: Points whose distances to as many others are held at once.
TILE = 512


# ------------------------------------------------------------------ classification
def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted mean.

    Undefined ratios count as 0.  Everything derives from the confusion counts, so the
    table is read once.
    """
    none = F.lit(0).cast("long")
    agreed = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(none)

    def side(label: str, support: Column, claimed: Column, hits: Column) -> Column:
        return F.struct(
            F.col(label).cast("string").alias("label"),
            support.alias("support"),
            claimed.alias("claimed"),
            hits.alias("hits"),
        )

    cells = confusion_matrix(df, truth, predicted).select(
        F.inline(F.array(side(truth, F.col("n"), none, agreed), side(predicted, none, F.col("n"), none)))
    )
    per_class = (
        cells.groupBy("label")
        .agg(*(F.sum(name).alias(name) for name in ("support", "claimed", "hits")))
        .withColumns(
            {
                "precision": F.coalesce(F.try_divide(F.col("hits"), F.col("claimed")), F.lit(0.0)),
                "recall": F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0)),
                "f1": F.coalesce(F.try_divide(2 * F.col("hits"), F.col("claimed") + F.col("support")), F.lit(0.0)),
            }
        )
    )
    scores = ("precision", "recall", "f1")
    rolled = per_class.rollup("label").agg(
        F.grouping("label").alias("is_total"),
        F.sum("support").alias("support"),
        F.sum("hits").alias("hits"),
        *(F.avg(score).alias(score) for score in scores),
        *((F.sum(F.col(score) * F.col("support")) / F.sum("support")).alias(f"weighted_{score}") for score in scores),
    )

    def row(label, values: Sequence[Column]) -> Column:
        named = [value.alias(score) for value, score in zip(values, scores)]
        return F.struct(label.alias("label"), *named, F.col("support").alias("support"))

    accuracy = F.col("hits") / F.col("support")
    means = [F.col(score) for score in scores]
    summary = F.array(
        row(F.lit("accuracy"), [accuracy] * 3),
        row(F.lit("macro avg"), means),
        row(F.lit("weighted avg"), [F.col(f"weighted_{score}") for score in scores]),
    )
    return rolled.select(
        F.inline(F.when(F.col("is_total") == 1, summary).otherwise(F.array(row(F.col("label"), means))))
    )


def with_threshold(df: DataFrame, probability: str, threshold: float = 0.25) -> DataFrame:
    """Add ``predicted``: TRUE where the probability reaches the threshold."""
    return df.withColumn("predicted", F.col(probability) >= threshold)


def threshold_curve(df: DataFrame, truth: Column, score: str, epsilon: float = 1e-8) -> DataFrame:
    """Precision, recall and F1 when everything scoring at least ``threshold`` is taken."""
    falling = df.withColumn("falling", -F.col(score))
    sums = running_sums(falling, "falling", {"n": F.lit(1), "hits": truth.cast("int")})
    precision = F.col("hits_upto") / F.col("n_upto")
    recall = F.try_divide(F.col("hits_upto"), F.col("hits_all"))
    return sums.select(
        (-F.col("falling")).alias("threshold"), precision.alias("precision"), recall.alias("recall")
    ).withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(epsilon))
    )


# ------------------------------------------------------------------ grouping quality
def grouped_points(df: DataFrame, features: Sequence[str], cluster: str, key: str) -> DataFrame:
    """``key, cluster, point`` with the features as one array."""
    return df.select(
        F.col(key).alias("key"),
        F.col(cluster).alias("cluster"),
        F.array(*(F.col(name).cast("double") for name in features)).alias("point"),
    )


def _squared_distance(left: str, right: str) -> str:
    return f"aggregate(zip_with({left}, {right}, (a, b) -> (a - b) * (a - b)), 0D, (total, step) -> total + step)"


def centroids(points: DataFrame, dimensions: int) -> DataFrame:
    """``cluster, n, center``: one row per cluster."""
    means = [F.avg(F.col("point")[place]) for place in range(dimensions)]
    return points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*means).alias("center"))


def _spreads(points: DataFrame, dimensions: int) -> DataFrame:
    """``cluster, n, center, mean_distance, squares`` per cluster."""
    centers = stage(centroids(points, dimensions), "centers")
    squared = points.join(centers, "cluster").withColumn(
        "squared", F.expr(_squared_distance("point", "center"))
    )
    return squared.groupBy("cluster").agg(
        F.first("n").alias("n"),
        F.first("center").alias("center"),
        F.avg(F.sqrt("squared")).alias("mean_distance"),
        F.sum("squared").alias("squares"),
    )


def davies_bouldin(points: DataFrame, dimensions: int) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / center distance.

    Compares cluster centers only, which one row holds as a list.
    """
    listed = _spreads(points, dimensions).agg(
        F.collect_list(F.struct("cluster", "mean_distance", "center")).alias("groups")
    )
    similarity = (
        "(g.mean_distance + other.mean_distance) / nullif(sqrt(" + _squared_distance("g.center", "other.center") + "), 0D)"
    )
    worst = (
        "transform(groups, g -> array_max(transform(filter(groups, other -> other.cluster <> g.cluster), "
        f"other -> {similarity})))"
    )
    return listed.select(F.explode(F.expr(worst)).alias("worst")).agg(F.avg("worst").alias("davies_bouldin"))


def inertia(points: DataFrame, dimensions: int) -> DataFrame:
    return _spreads(points, dimensions).agg(F.sum("squares").alias("inertia"))


def calinski_harabasz(points: DataFrame, dimensions: int) -> DataFrame:
    """Between-cluster over within-cluster dispersion."""
    n = F.col("n")
    weighted = [F.sum(n * F.col("center")[place]) for place in range(dimensions)]
    squared = [F.sum(n * F.pow(F.col("center")[place], F.lit(2))) for place in range(dimensions)]
    parts = _spreads(points, dimensions).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum("squares").alias("within"),
        F.array(*weighted).alias("weighted"),
        F.array(*squared).alias("squared"),
    )
    between = F.expr("aggregate(zip_with(squared, weighted, (s, w) -> s - w * w / n), 0D, (total, step) -> total + step)")
    return parts.select(
        ((between / (F.col("k") - 1)) / (F.col("within") / (n - F.col("k")))).alias("calinski_harabasz")
    )


def _sides(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, clusters (one column a grouping) and points of a block."""
    flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    rows = table.num_rows
    return table.column("key").to_numpy(), flat("clusters").reshape(rows, width), flat("point").reshape(rows, -1)


def _pair_sums(width: int):
    """Distances between two blocks, summed per point and cluster of the other block, for both blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("key", pa.int64()), ("grouping", pa.int32()), ("cluster", pa.int64()), ("other", pa.int64()), ("distance", pa.float64()), ("n", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        same = left.column("row_block")[0] == left.column("column_block")[0]
        (keys, labels, a), (other_keys, other_labels, b) = _sides(left, width), _sides(right, width)
        known = [[np.unique(side[:, g], return_inverse=True) for g in range(width)] for side in (labels, other_labels)]
        members = [np.concatenate([(place[:, None] == np.arange(len(names))).astype(float) for names, place in side], 1) for side in known]
        lengths = (b * b).sum(1)
        near, far = np.zeros((len(a), members[1].shape[1])), np.zeros((len(b), members[0].shape[1]))
        for row in range(0, len(a), TILE):
            x = a[row : row + TILE]
            for column in range(0, len(b), TILE):
                y = b[column : column + TILE]
                distance = (-2.0 * x) @ y.T
                distance += (x * x).sum(1)[:, None]
                distance += lengths[column : column + TILE]
                np.sqrt(np.maximum(distance, 0.0, out=distance), out=distance)
                if same:
                    distance[keys[row : row + TILE, None] == other_keys[None, column : column + TILE]] = 0.0
                near[row : row + TILE] += distance @ members[1][column : column + TILE]
                if not same:
                    far[column : column + TILE] += distance.T @ members[0][row : row + TILE]
        parts = []
        for ids, own, sums, facing in ((keys, labels, near, known[1]), (other_keys, other_labels, far, known[0]))[: 1 if same else 2]:
            first = 0
            for g, (names, place) in enumerate(facing):
                size, rows = len(names), len(ids)
                columns = (
                    np.repeat(ids, size), np.full(rows * size, g, np.int32), np.repeat(own[:, g], size), np.tile(names, rows),
                    sums[:, first : first + size].ravel(), np.tile(np.bincount(place), rows),
                )
                parts.append(pa.table([pa.array(c) for c in columns], schema=kinds))
                first += size
        return pa.concat_tables(parts)

    return run


def squared_silhouette(points: DataFrame) -> DataFrame:
    """Mean silhouette by squared Euclidean distance, over all points in linear time.

    Squared distances to a whole cluster follow from its size, sum and sum of squares, so no pairs
    are compared.
    """
    rows = points.select("key", F.col("cluster").cast("double"), array_to_vector("point").alias("features"))
    score = ClusteringEvaluator(predictionCol="cluster", featuresCol="features", metricName="silhouette").evaluate(rows)
    return points.sparkSession.createDataFrame([(float(score),)], "silhouette double")


def silhouette(points: DataFrame, sample_size: int | None, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean Euclidean silhouette over a hashed sample of ``sample_size`` points, or over all points for None.

    See ``silhouettes``, which this is for one grouping.
    """
    return silhouettes(points.withColumn("clusters", F.array(F.col("cluster").cast("long"))), 1, sample_size, seed, block_rows).select("silhouette")


def silhouettes(points: DataFrame, width: int, sample_size: int | None = None, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``grouping, silhouette`` for ``width`` groupings of the same points, by their place in ``clusters``.

    The measure needs every distance within the sample, so its cost grows with the square of the
    sample; for a full table of any size use ``squared_silhouette``.  The sample is cut into blocks
    by hashed key, and a task takes one unordered pair of blocks: every distance is computed once, for
    both points and all groupings, and only sums per point and cluster leave the task.  The number of
    blocks stays at ``PAIR_BLOCKS`` until a block has ``BLOCK_LIMIT`` rows, so what is shuffled grows
    with the points; beyond that the blocks keep their size and the memory of a task its bound.
    """
    sample = stage(points if sample_size is None else sample_rows(points, sample_size, "key", seed), "silhouette-sample")
    total = sample.count()
    blocks = max(1, min(PAIR_BLOCKS, -(-total // block_rows)), -(-total // BLOCK_LIMIT))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    values = [F.col("key").cast("long").alias("key"), F.col("clusters").cast("array<long>").alias("clusters"), F.col("point").cast("array<double>").alias("point")]
    lefts = sample.select(*values, block.alias("row_block")).withColumn("column_block", F.explode(F.sequence(F.col("row_block"), F.lit(blocks - 1))))
    rights = sample.select(*values, block.alias("column_block")).withColumn("row_block", F.explode(F.sequence(F.lit(0), F.col("column_block"))))
    partial = (
        lefts.groupBy("row_block", "column_block")
        .cogroup(rights.groupBy("row_block", "column_block"))
        .applyInArrow(_pair_sums(width), "key long, grouping int, cluster long, other long, distance double, n long")
    )
    own = F.col("other") == F.col("cluster")
    to_cluster = partial.groupBy("key", "grouping", "cluster", "other").agg(F.sum("distance").alias("distance"), F.sum("n").alias("n"))
    per_point = to_cluster.groupBy("key", "grouping").agg(
        F.max(F.when(own, F.col("n"))).alias("own_size"),
        F.max(F.when(own & (F.col("n") > 1), F.col("distance") / (F.col("n") - 1))).alias("inner"),
        F.min(F.when(~own, F.col("distance") / F.col("n"))).alias("outer"),
    )
    inner, outer = F.col("inner"), F.col("outer")
    score = F.when(F.col("own_size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(outer - inner, F.greatest(inner, outer)), F.lit(0.0))
    )
    scores = per_point.groupBy("grouping").agg(F.avg(score).alias("silhouette"))
    # one row for every grouping, also without points
    return points.sparkSession.range(width).select(F.col("id").cast("int").alias("grouping")).join(F.broadcast(scores), "grouping", "left")  # ``width`` rows


def cluster_means(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """Mean of every feature per cluster, one row per cluster and feature."""
    wide = df.groupBy(cluster).agg(*(F.avg(name).alias(name) for name in features))
    return wide.unpivot([cluster], list(features), "feature", "mean_value")


def cluster_profile(df: DataFrame, features: Sequence[str], cluster: str, top: int = 20) -> DataFrame:
    """Cluster means of the ``top`` features whose means differ most between clusters."""
    means = cluster_means(df, features, cluster)
    spread = means.groupBy("feature").agg(F.var_samp("mean_value").alias("spread"))
    chosen = spread.orderBy(F.desc("spread"), "feature").limit(top)
    return means.join(F.broadcast(chosen), "feature")  # ``top`` rows


# ------------------------------------------------------------------ model selection
def elbow_choice(metrics: DataFrame, k: str = "k", value: str = "inertia") -> DataFrame:
    """``k`` farthest from the chord between first and last point; the smallest on ties.

    ``metrics`` has one row per tried ``k``.
    """
    ends = metrics.agg(
        F.min(F.struct(k, value)).alias("first"), F.max(F.struct(k, value)).alias("last"), F.collect_list(F.struct(k, value)).alias("tried")
    )
    points = ends.select("first", "last", F.inline("tried"))
    width, height = F.col("last")[k] - F.col("first")[k], F.col("last")[value] - F.col("first")[value]
    off_chord = F.abs(height * (F.col(k) - F.col("first")[k]) - width * (F.col(value) - F.col("first")[value]))
    distance = off_chord / F.sqrt(height * height + width * width)
    return points.agg(F.min(F.struct((-distance).alias("rank"), F.col(k).alias("k")))["k"].alias("best_k"))


def best_by_score(metrics: DataFrame, k: str = "k", score: str = "silhouette") -> DataFrame:
    """``k`` with the highest score; the smallest on ties."""
    return metrics.agg(F.min(F.struct((-F.col(score)).alias("rank"), F.col(k).alias("k")))["k"].alias("best_k"))


def improvement_choice(metrics: DataFrame, n: str = "n_components", value: str = "bic", threshold: float = 0.015) -> DataFrame:
    """First ``n`` whose relative improvement to the next is at most ``threshold``, else the last.

    ``metrics`` has one row per tried ``n``.
    """
    following = F.lead(value).over(W.orderBy(n))
    improvement = (F.col(value) - following) / F.abs(F.col(value))
    judged = metrics.select(F.col(n).alias("n"), improvement.alias("improvement"))
    return judged.agg(
        F.coalesce(F.min(F.when(F.col("improvement") <= threshold, F.col("n"))), F.max("n")).alias("best_n")
    )


def information_criteria(log_likelihood: float, components: int, dimensions: int, rows: int) -> tuple[float, float]:
    """BIC and AIC of a full-covariance Gaussian mixture."""
    free = components * dimensions * (dimensions + 1) / 2 + components * dimensions + components - 1
    return float(-2 * log_likelihood + free * np.log(rows)), float(-2 * log_likelihood + 2 * free)
