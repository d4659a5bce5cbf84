"""K-means and Gaussian mixtures for many numbers of groups at once: one scan a step for all models.

A step reads the points once, whatever the number of models: a batch meets the stacked centres of all
models in one matrix product, and each map task returns one row of sums per model.  The driver
holds centres and moments only, which depend on models, groups and features and not on the points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editpulse.operators.scans import PARTIAL, added, partial_sums

# Limits of the published models
KMEANS_TOLERANCE, KMEANS_STEPS = 1e-4, 300
MIXTURE_TOLERANCE, MIXTURE_STEPS, RIDGE = 1e-3, 100, 1e-6

_CHUNK = 2048
#: Points that a kernel takes at once: what it holds of them for one model stays in a core's cache.
_CACHED = 512


class KMeansFit(NamedTuple):
    centers: np.ndarray
    inertia: float
    steps: int


class MixtureFit(NamedTuple):
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float
    steps: int


def points_of(rows: DataFrame, point: str, key: str = "user_id") -> DataFrame:
    """``h`` (a hash of the key, for draws that repeat) and ``x`` (the array column ``point``)."""
    return rows.select(F.xxhash64(key).alias("h"), F.col(point).alias("x"))


def packed(points: DataFrame) -> DataFrame:
    """The points of ``points_of`` in blocks, whose bytes a scan copies instead of converting every number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, x in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["h", "x"])

    return points.mapInArrow(run, "h binary, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if pa.types.is_binary(batch.schema.field("h").type):
            for keys, block in zip(batch.column("h"), batch.column("x"), strict=True):
                h = np.frombuffer(keys.as_buffer(), np.uint64)
                yield h, np.frombuffer(block.as_buffer(), float).reshape(len(h), -1)
            continue
        for first in range(0, batch.num_rows, _CHUNK):
            part = batch.slice(first, _CHUNK)
            yield part.column("h").to_numpy().view(np.uint64), _matrix(part.column("x"))


def _summed(points: DataFrame, size: int, task: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over all points of what ``task`` gives for each of ``size`` models; zeros of length 0 without points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for _, x in _chunks(batches):
            found = task(x)
            total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is not None:
            yield partial_sums(list(range(size)), total)

    found = added(points.mapInArrow(run, PARTIAL))
    return [found.get(m, np.empty(0)) for m in range(size)]


# ------------------------------------------------------------------ k-means
def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1] by key hash and seed (the splitmix finaliser)."""
    x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * x @ centers.T + (centers * centers).sum(1), 0.0)


def seed_centers(points: DataFrame, ks: Sequence[int], seeds: Sequence[int]) -> list[np.ndarray]:
    """First centres of every model by k-means++: each next one is drawn with a chance in proportion to its
    squared distance from those before.

    The draw is a race: the point with the smallest -log(u) / distance wins, with u from a hash of its
    key, so a scan yields the next centre of every model and the draw repeats on any cluster.
    """
    chosen: list[list[list[float]]] = [[] for _ in ks]
    for number in range(max(ks)):
        open_models = [m for m, k in enumerate(ks) if k > number]
        centers = np.array([chosen[m] for m in open_models])
        # per centre drawn before: (-2 center, center squared) of all models, one row a model
        tables = [np.column_stack([-2.0 * c, (c * c).sum(1)]) for c in centers.swapaxes(0, 1)] if number else []
        drawing = [seeds[m] for m in open_models]

        def run(batches: Iterator[pa.RecordBatch], open_models=open_models, tables=tables, drawing=drawing, number=number) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, np.ndarray]] = {}
            for keys, block in _chunks(batches):
                for first in range(0, len(block), _CACHED):
                    h, x = keys[first : first + _CACHED], block[first : first + _CACHED]
                    drawn = {seed: -np.log(_uniform(h, seed * 1009 + number)) for seed in set(drawing)}
                    race = np.stack([drawn[seed] for seed in drawing])
                    if number:
                        points = np.vstack([x.T, np.ones(len(x))])
                        far = tables[0] @ points
                        for table in tables[1:]:
                            np.minimum(far, table @ points, out=far)
                        far += (x * x).sum(1)
                        race /= np.maximum(far, 1e-300)
                    winners = race.argmin(1)
                    for m, own, place in zip(open_models, race, winners.tolist(), strict=True):
                        if m not in best or own[place] < best[m][0]:
                            best[m] = (float(own[place]), x[place])
            if best:
                columns = [pa.array(list(best), pa.int32()), pa.array([r for r, _ in best.values()]), pa.array([x for _, x in best.values()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["model", "race", "x"])

        winners = points.mapInArrow(run, "model int, race double, x array<double>").groupBy("model").agg(F.min_by("x", F.struct("race", "x")).alias("x"))
        for row in winners.collect():
            chosen[row["model"]].append(row["x"])
    return [np.array(c) for c in chosen]


def lloyd_step(points: DataFrame, centers: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per model: number and sum of the points nearest to each centre (the first of equally near ones), and the inertia."""
    alike: dict[int, list[int]] = {}
    for m, own in enumerate(centers):
        alike.setdefault(len(own), []).append(m)
    # per number of groups and group: (-2 center, center squared) of that group in all models, one row a model
    tables = {k: [np.column_stack([-2.0 * c, (c * c).sum(1)]) for c in np.stack([centers[m] for m in ms], 1)] for k, ms in alike.items()}

    def task(x: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(len(own) + 1 + own.size) for own in centers]
        for first in range(0, len(x), _CACHED):
            part = x[first : first + _CACHED]
            longer = np.column_stack([part, np.ones(len(part))])
            points = np.ascontiguousarray(longer.T)
            length = (part * part).sum(1)
            for k, ms in alike.items():
                least = tables[k][0] @ points  # models x points: every pass below runs along the points
                label = np.zeros(least.shape, np.int8 if k < 128 else np.int32)
                for c in range(1, k):
                    distance = tables[k][c] @ points
                    np.maximum(label, (distance < least).view(np.int8) * label.dtype.type(c), out=label)
                    np.minimum(least, distance, out=least)
                inertia = np.maximum(least + length, 0.0).sum(1)
                sums = np.stack([(label == c).astype(float) @ longer for c in range(k)], 1)
                for place, m in enumerate(ms):
                    out[m] += np.concatenate([sums[place, :, -1], [inertia[place]], sums[place, :, :-1].ravel()])
        return out

    found = []
    for own, s in zip(centers, _summed(points, len(centers), task), strict=True):
        k = len(own)
        s = s if len(s) else np.zeros(k + 1 + own.size)
        found.append((s[:k], s[k + 1 :].reshape(own.shape), float(s[k])))
    return found


def fit_kmeans(points: DataFrame, ks: Sequence[int], restarts: int, seed: int = 42, steps: int = KMEANS_STEPS, tolerance: float = KMEANS_TOLERANCE) -> dict[int, KMeansFit]:
    """The best of ``restarts`` runs by inertia for every number of groups; the earliest wins ties.

    All runs of all numbers share each scan. A run ends when its centres move by less than ``tolerance``
    times the mean variance of the features. A centre without points stays where it is.
    """
    models = [(k, seed + r) for k in ks for r in range(restarts)]
    spread = _summed(points, 1, lambda x: [np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])])[0]
    if not len(spread):
        return {}
    size = (len(spread) - 1) // 2
    variance = float((spread[1 + size :] / spread[0] - (spread[1 : 1 + size] / spread[0]) ** 2).mean())
    centers = seed_centers(points, [k for k, _ in models], [s for _, s in models])
    taken, active = np.zeros(len(models), int), list(range(len(models)))
    for _ in range(steps):
        moved = []
        for m, (n, total, _) in zip(active, lloyd_step(points, [centers[m] for m in active]), strict=True):
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1.0)[:, None], centers[m])
            if ((new - centers[m]) ** 2).sum() > tolerance * variance:
                moved.append(m)
            centers[m] = new
            taken[m] += 1
        active = moved
        if not active:
            break
    inertia = [found[2] for found in lloyd_step(points, centers)]
    best: dict[int, KMeansFit] = {}
    for m, (k, _) in enumerate(models):
        if k not in best or inertia[m] < best[k].inertia:
            best[k] = KMeansFit(centers[m], inertia[m], int(taken[m]))
    return best


# ------------------------------------------------------------------ Gaussian mixtures
def _whitened(fit: MixtureFit) -> tuple[np.ndarray, np.ndarray]:
    """Inverse Cholesky factors, and the constant of the log density, of every component."""
    factors = np.linalg.cholesky(fit.covariances)
    size = fit.means.shape[1]
    constant = np.log(np.maximum(fit.weights, 1e-300)) - 0.5 * size * np.log(2 * np.pi) - np.log(np.einsum("cjj->cj", factors)).sum(1)
    return np.linalg.inv(factors), constant


def _log_densities(x: np.ndarray, fit: MixtureFit, whitened: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Logarithm of weight times density of every point in every component, one row a component."""
    inverse, constant = whitened or _whitened(fit)
    groups, size = fit.means.shape
    scaled = inverse.reshape(-1, size) @ x.T  # all components in one product
    scaled -= np.einsum("cij,cj->ci", inverse, fit.means).reshape(-1, 1)
    scaled *= scaled
    return constant[:, None] - 0.5 * scaled.reshape(groups, size, -1).sum(1)


def responsibilities(x: np.ndarray, fit: MixtureFit, whitened: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Share of every component in every point, and the log density of the point."""
    each = _log_densities(x, fit, whitened)
    top = each.max(0)
    each -= top
    np.exp(each, out=each)
    total = each.sum(0)
    each /= total
    return each.T, top + np.log(total)


def _moments(points: DataFrame, shares: Sequence[Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]], sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Per model: weight, first and second moments of every component, and the log likelihood."""
    first = np.cumsum([0, *sizes]).tolist()

    def task(x: np.ndarray) -> list[np.ndarray]:
        left, right = np.triu_indices(x.shape[1])  # products of two features are summed once
        total = np.zeros((first[-1], 2 + x.shape[1] + len(left)))
        for begin in range(0, len(x), _CACHED):
            part = x[begin : begin + _CACHED]
            found = [share(part) for share in shares]
            powers = np.column_stack([np.ones(len(part)), part, part[:, left] * part[:, right]])
            densities = np.zeros(first[-1])
            densities[first[:-1]] = [density.sum() for _, density in found]
            total += np.column_stack([np.concatenate([r.T for r, _ in found]) @ powers, densities])
        return list(total)

    found = _summed(points, first[-1], task)
    size = int(round((-3 + np.sqrt(9 + 8 * (len(found[0]) - 2))) / 2))
    left, right = np.triu_indices(size)
    result = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        s = np.stack(found[a:b])
        second = np.empty((b - a, size, size))
        second[:, left, right] = second[:, right, left] = s[:, 1 + size : -1]
        result.append((s[:, 0], s[:, 1 : 1 + size], second, float(s[0, -1])))
    return result


def _maximised(weight: np.ndarray, first: np.ndarray, second: np.ndarray, log_likelihood: float, steps: int, ridge: float) -> MixtureFit:
    safe = np.maximum(weight, 10 * np.finfo(float).eps)
    means = first / safe[:, None]
    covariances = second / safe[:, None, None] - means[:, :, None] * means[:, None, :] + ridge * np.eye(means.shape[1])
    return MixtureFit(weight / weight.sum(), means, covariances, log_likelihood, steps)


def _shares(fits: Sequence[MixtureFit]) -> list[Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    return [lambda x, fit=fit, whitened=_whitened(fit): responsibilities(x, fit, whitened) for fit in fits]


def mixture_step(points: DataFrame, fits: Sequence[MixtureFit], ridge: float = RIDGE) -> list[MixtureFit]:
    """One step of expectation maximisation of every model; its likelihood is that of the model before."""
    shares = _shares(fits)
    return [_maximised(*m, fit.steps + 1, ridge) for m, fit in zip(_moments(points, shares, [len(f.weights) for f in fits]), fits, strict=True)]


def fit_mixtures(points: DataFrame, counts: Sequence[int], seed: int = 42, steps: int = MIXTURE_STEPS, tolerance: float = MIXTURE_TOLERANCE, ridge: float = RIDGE) -> dict[int, MixtureFit]:
    """Full-covariance mixtures with every number of components, begun from k-means groups.

    All models share each scan. A model is done when the mean log likelihood of a point gains less than ``tolerance``.
    """
    begun = fit_kmeans(points, counts, 1, seed)
    if not begun:
        return {}
    total = _summed(points, 1, lambda x: [np.array([float(len(x))])])[0][0]

    def nearest(centers: np.ndarray):
        return lambda x: ((_distances(x, centers).argmin(1)[:, None] == np.arange(len(centers))).astype(float), np.zeros(len(x)))

    moments = _moments(points, [nearest(begun[n].centers) for n in counts], list(counts))
    fits = [_maximised(*m, 0, ridge) for m in moments]
    last, active = np.full(len(fits), -np.inf), list(range(len(fits)))
    for _ in range(steps):
        open_models = []
        for m, new in zip(active, mixture_step(points, [fits[m] for m in active], ridge), strict=True):
            gain = (new.log_likelihood - last[m]) / total
            last[m] = new.log_likelihood
            fits[m] = new
            if not gain < tolerance:
                open_models.append(m)
        active = open_models
        if not active:
            break
    final = [m[3] for m in _moments(points, _shares(fits), list(counts))]
    return {n: fit._replace(log_likelihood=value) for n, fit, value in zip(counts, fits, final, strict=True)}


# ------------------------------------------------------------------ labels
def label_rows(rows: DataFrame, fit: KMeansFit | MixtureFit, column: str, point: str, key: str = "user_id") -> DataFrame:
    """``key`` and the number of the nearest centre, or of the component with the largest share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(first, _CHUNK)
                x = _matrix(part.column("x"))
                label = _distances(x, fit.centers).argmin(1) if isinstance(fit, KMeansFit) else _log_densities(x, fit).argmax(0)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(label.astype(np.int32))], names=[key, column])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(point).alias("x")).mapInArrow(run, f"{key} {kind}, {column} int")


def label_points(rows: DataFrame, fits: Sequence[KMeansFit], point: str, key: str = "user_id") -> DataFrame:
    """``key``, ``clusters`` (the nearest centre of every fit, in one array) and ``point``, from one scan and without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(first, _CHUNK)
                x = _matrix(part.column("point"))
                labels = np.column_stack([_distances(x, fit.centers).argmin(1) for fit in fits]).astype(np.int32)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(fits))
                clusters = pa.ListArray.from_arrays(ends, pa.array(labels.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("key"), clusters, part.column("point")], names=["key", "clusters", "point"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(point).alias("point")).mapInArrow(run, f"key {kind}, clusters array<int>, point array<double>")
