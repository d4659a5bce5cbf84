"""Batched k-means and mixtures against plain programs."""

import numpy as np
import pytest

from editpulse.plans import clustering as C


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    centers = np.array([[-4.0, 0, 1], [4, 0, 0], [0, 6, -1], [0, -5, 3]])
    return np.array([rng.normal(size=3) * [1.0, 0.5, 0.8] + centers[i % 4] for i in range(400)])


@pytest.fixture(scope="module")
def rows(spark, cloud):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(cloud)], "user_id long, p array<double>").repartition(3).cache()


def plain_lloyd(x, centers, steps=500):
    for _ in range(steps):
        label = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
        new = np.array([x[label == k].mean(0) if (label == k).any() else centers[k] for k in range(len(centers))])
        if np.array_equal(new, centers):
            break
        centers = new
    return centers, ((x[:, None] - centers) ** 2).sum(2).min(1).sum()


def plain_em(x, fit, ridge=C.RIDGE):
    dense = []
    for w, m, s in zip(fit.weights, fit.means, fit.covariances, strict=True):
        d = x - m
        dense.append(w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d)) / np.sqrt(np.linalg.det(2 * np.pi * s)))
    dense = np.array(dense).T
    r = dense / dense.sum(1, keepdims=True)
    n = r.sum(0)
    means = r.T @ x / n[:, None]
    cov = [(r[:, k, None] * (x - means[k])).T @ (x - means[k]) / n[k] + ridge * np.eye(x.shape[1]) for k in range(len(n))]
    return n / len(x), means, np.array(cov), np.log(dense.sum(1)).sum()


def test_all_models_equal_separate_runs(rows, cloud):
    points = C.points_of(rows, "p")
    ks, seeds = [2, 2, 4, 5], [1, 2, 1, 9]
    seeded = C.seed_centers(points, ks, seeds)
    assert [len(s) for s in seeded] == ks
    known = {tuple(p) for p in cloud.tolist()}
    assert all(tuple(c) in known for s in seeded for c in s.tolist()) and all(len({tuple(c) for c in s.tolist()}) == len(s) for s in seeded)
    fits = C.fit_kmeans(points, [2, 4, 6], 3, seed=1, tolerance=0.0)
    for k, fit in fits.items():
        runs = [plain_lloyd(cloud, s) for s in C.seed_centers(points, [k] * 3, [1, 2, 3])]
        best = min(runs, key=lambda run: run[1])
        assert np.isclose(fit.inertia, best[1]) and np.allclose(fit.centers, best[0])
    labels = C.label_rows(rows, fits[4], "g", "p").groupBy("g").count().collect()
    assert sorted(r["count"] for r in labels) == [100] * 4


def test_seeds_do_not_depend_on_partitions(rows):
    a = C.seed_centers(C.points_of(rows, "p"), [3, 5], [1, 2])
    b = C.seed_centers(C.points_of(rows.repartition(7), "p"), [3, 5], [1, 2])
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_mixture_steps_equal_plain_ones(rows, cloud):
    points = C.points_of(rows, "p")
    fits = [C.MixtureFit(np.full(n, 1 / n), cloud[:n] * 1.0, np.array([np.eye(3) * 2.0] * n), 0.0, 0) for n in (1, 3)]
    for _ in range(3):
        stepped = C.mixture_step(points, fits)
        for old, new in zip(fits, stepped, strict=True):
            w, m, s, likelihood = plain_em(cloud, old)
            assert np.allclose(new.weights, w) and np.allclose(new.means, m) and np.allclose(new.covariances, s)
            assert np.isclose(new.log_likelihood, likelihood)
        fits = stepped


def test_one_component_has_its_closed_form(rows, cloud):
    fit = C.fit_mixtures(C.points_of(rows, "p"), [1, 4])
    cov = np.cov(cloud.T, bias=True) + C.RIDGE * np.eye(3)
    d = cloud - cloud.mean(0)
    likelihood = -0.5 * (np.einsum("ni,ij,nj->", d, np.linalg.inv(cov), d) + 400 * np.log(np.linalg.det(2 * np.pi * cov)))
    assert np.allclose(fit[1].means[0], cloud.mean(0)) and np.isclose(fit[1].log_likelihood, likelihood)
    assert fit[4].log_likelihood > fit[1].log_likelihood + 300
    labels = C.label_rows(rows, fit[4], "g", "p").groupBy("g").count().collect()
    assert sorted(r["count"] for r in labels) == [100] * 4


def test_no_points(spark):
    empty = C.points_of(spark.createDataFrame([], "user_id long, p array<double>"), "p")
    assert C.fit_kmeans(empty, [2], 2) == {} and C.fit_mixtures(empty, [2]) == {}


def test_repeated_points_and_empty_groups(spark):
    same = C.points_of(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "user_id long, p array<double>"), "p")
    fit = C.fit_kmeans(same, [3], 2)[3]
    assert fit.inertia == 0.0 and np.allclose(fit.centers, [1.0, 2.0])


def test_blocks_hold_all_points_and_give_the_same_steps(rows, cloud):
    points = C.points_of(rows, "p")
    blocks = C.packed(points)
    assert blocks.count() <= 3  # one a partition of this table, not one a point
    begun = [cloud[:k] for k in (2, 5, 5, 3)]
    for (n, total, inertia), (other_n, other_total, other_inertia) in zip(C.lloyd_step(blocks, begun), C.lloyd_step(points, begun), strict=True):
        assert n.sum() == len(cloud) and (n == other_n).all()
        np.testing.assert_allclose(total, other_total, rtol=1e-12)
        assert inertia == pytest.approx(other_inertia, rel=1e-12)
    for centers, (n, total, inertia) in zip(begun, C.lloyd_step(blocks, begun), strict=True):
        squares = ((cloud[:, None] - centers) ** 2).sum(2)
        assert (n == np.bincount(squares.argmin(1), minlength=len(centers))).all()
        assert inertia == pytest.approx(squares.min(1).sum(), rel=1e-12)


def test_all_labels_come_from_one_scan_without_a_join(spark):
    draw = np.random.default_rng(3)
    cloud = draw.normal(size=(700, 3))
    rows = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(cloud)], "user_id long, p array<double>")
    fits = [C.KMeansFit(draw.normal(size=(k, 3)), 0.0, 1) for k in (2, 5)]
    found = C.label_points(rows, fits, "p")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    for row in found.collect():
        nearest = [int(((cloud[row["key"]] - fit.centers) ** 2).sum(1).argmin()) for fit in fits]
        assert row["clusters"] == nearest and row["point"] == cloud[row["key"]].tolist()


def test_moments_take_every_product_once(spark, monkeypatch):
    """A step over several blocks against weighted moments computed directly."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(1300, 4))
    widths = []
    monkeypatch.setattr(C, "_summed", lambda points, size, task: widths.append(len(task(points)[0])) or task(points))
    fit = C.MixtureFit(np.array([0.3, 0.7]), draw.normal(size=(2, 4)), np.array([np.eye(4), 2 * np.eye(4)]), 0.0, 0)
    (moved,) = C.mixture_step(x, [fit])
    density = np.stack([w * np.exp(-0.5 * ((x - m) ** 2).sum(1) / s) / (2 * np.pi * s) ** 2 for w, m, s in zip(fit.weights, fit.means, (1, 2))], 1)
    share = density / density.sum(1, keepdims=True)
    assert widths == [1 + 4 + 10 + 1]  # weight, means, ten products, likelihood
    assert moved.log_likelihood == pytest.approx(np.log(density.sum(1)).sum())
    for c in range(2):
        mean = share[:, c] @ x / share[:, c].sum()
        assert moved.means[c] == pytest.approx(mean)
        assert moved.covariances[c] == pytest.approx((share[:, c, None] * x).T @ x / share[:, c].sum() - np.outer(mean, mean) + C.RIDGE * np.eye(4))
