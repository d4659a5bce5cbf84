import numpy as np
import pytest
from pyspark.sql import functions as F

from editpulse.operators import evaluate as Q

# --------------------------------------------------------------------------
# Published metric tables (k, silhouette, inertia) and (n, BIC, AIC)
# --------------------------------------------------------------------------
K_METRICS = [
    (2, 0.13992314226241662, 14056495.304532921), (3, 0.1441279978629463, 12626363.1000475),
    (4, 0.14981326211311494, 11431020.042701151), (5, 0.16459944652117514, 10684952.80767885),
    (6, 0.15210351263025237, 10168590.361132389), (7, 0.15283587480218436, 9775617.525225349),
    (8, 0.1471964397844475, 9459897.529706327), (9, 0.1485456076015015, 9169887.681819938),
    (10, 0.1520855608476395, 8937169.296237564), (11, 0.1387122937820933, 8712666.935989892),
    (12, 0.1327347595176679, 8508151.786269518), (13, 0.13619498754262954, 8294716.144477195),
    (14, 0.12729825923623184, 8123278.0208237115), (15, 0.1268544709904891, 7954564.525611552),
]
MIXTURE_METRICS = [
    (2, 23286466.029420707, 23280956.76975786), (3, 21776021.248475775, 21767751.90426897),
    (4, 20497518.955627773, 20486489.526877005), (5, 19710293.523071244, 19696504.009776514),
    (6, 19052948.87877686, 19036399.28093817), (7, 18702464.291289248, 18683154.608906597),
    (8, 18207308.44928938, 18185238.68236277), (9, 17697850.984451357, 17673021.132980786),
    (10, 17394790.472965855, 17367200.536951322), (11, 17192952.534329962, 17162602.513771467),
    (12, 16950271.912642557, 16917161.807540104), (13, 16696128.566678282, 16660258.377031866),
    (14, 16612808.748461472, 16574178.474271094), (15, 16387511.063903874, 16346120.705169536),
    (16, 16097681.34098683, 16053530.897708531), (17, 15993038.862833101, 15946128.335010841),
    (18, 15920988.149644574, 15871317.537278354), (19, 15796514.526975164, 15744083.830064984),
]


def test_published_k_choices(spark):
    metrics = spark.createDataFrame(K_METRICS, "k int, silhouette double, inertia double")
    assert Q.elbow_choice(metrics).first()["best_k"] == 6
    assert Q.best_by_score(metrics).first()["best_k"] == 5


def test_published_mixture_choices(spark):
    metrics = spark.createDataFrame(MIXTURE_METRICS, "n_components int, bic double, aic double")
    assert Q.improvement_choice(metrics, value="bic").first()["best_n"] == 10
    assert Q.improvement_choice(metrics, value="aic").first()["best_n"] == 10
    assert Q.improvement_choice(metrics, value="aic", threshold=-1.0).first()["best_n"] == 19


@pytest.mark.parametrize("n, bic, aic", [MIXTURE_METRICS[0], MIXTURE_METRICS[1], MIXTURE_METRICS[-1]])
def test_information_criteria(n, bic, aic):
    free = n * 21 * 22 / 2 + n * 21 + n - 1
    likelihood = (2 * free - aic) / 2
    got = Q.information_criteria(likelihood, n, 21, 404_103)
    assert got == (pytest.approx(bic, abs=0.1), pytest.approx(aic, abs=1e-6))


@pytest.fixture()
def decisions(spark):
    rng = np.random.default_rng(3)
    truth = rng.random(200) < 0.3
    score = np.round(rng.random(200), 2)
    return [(bool(t), float(s), bool(s > 0.6)) for t, s in zip(truth, score)]


def test_classification_report(spark, decisions):
    df = spark.createDataFrame(decisions, "y boolean, score double, p boolean")
    report = {r["label"]: r for r in Q.classification_report(df, "y", "p").collect()}
    for label, value in (("true", True), ("false", False)):
        hits = sum(t == value and p == value for t, _, p in decisions)
        claimed, support = sum(p == value for *_, p in decisions), sum(t == value for t, *_ in decisions)
        assert report[label]["precision"] == pytest.approx(hits / claimed)
        assert report[label]["recall"] == pytest.approx(hits / support) and report[label]["support"] == support
    assert report["accuracy"]["f1"] == pytest.approx(sum(t == p for t, _, p in decisions) / 200)
    assert report["macro avg"]["f1"] == pytest.approx((report["true"]["f1"] + report["false"]["f1"]) / 2)


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(True, False), (False, False)], "y boolean, p boolean")
    report = {r["label"]: r for r in Q.classification_report(df, "y", "p").collect()}
    assert report["true"]["precision"] == 0.0 and report["true"]["f1"] == 0.0


def test_threshold_curve(spark, decisions):
    df = spark.createDataFrame(decisions, "y boolean, score double, p boolean")
    curve = Q.threshold_curve(df, F.col("y"), "score").collect()
    assert len(curve) == len({s for _, s, _ in decisions})
    for row in curve:
        taken = [t for t, s, _ in decisions if s >= row["threshold"]]
        assert row["precision"] == pytest.approx(sum(taken) / len(taken))
        assert row["recall"] == pytest.approx(sum(taken) / sum(t for t, *_ in decisions))


@pytest.fixture()
def cloud():
    rng = np.random.default_rng(7)
    labels = rng.integers(0, 3, 120)
    return labels, rng.normal(size=(120, 4)) + labels[:, None]


def points(spark, labels, values):
    rows = [(i, int(c), [float(x) for x in v]) for i, (c, v) in enumerate(zip(labels, values))]
    return spark.createDataFrame(rows, "key bigint, cluster int, point array<double>")


def brute_silhouette(labels, values):
    distances = np.linalg.norm(values[:, None] - values[None], axis=2)
    scores = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(labels)) != i)
        if not same.any():
            scores.append(0.0)
            continue
        a = distances[i][same].mean()
        b = min(distances[i][labels == c].mean() for c in set(labels) if c != own)
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def test_silhouette_does_not_depend_on_blocks(spark, cloud):
    labels, values = cloud
    labels = labels.copy()
    labels[0] = 9  # a cluster of one
    expected = brute_silhouette(labels, values)
    for block_rows in (17, 1000):
        got = Q.silhouette(points(spark, labels, values), None, block_rows=block_rows).first()[0]
        assert got == pytest.approx(expected, abs=1e-9)


def test_center_based_measures(spark, cloud):
    labels, values = cloud
    centers = np.array([values[labels == c].mean(axis=0) for c in range(3)])
    sizes = np.array([(labels == c).sum() for c in range(3)])
    within = sum(((values[labels == c] - centers[c]) ** 2).sum() for c in range(3))
    between = (sizes[:, None] * (centers - values.mean(axis=0)) ** 2).sum()
    spread = np.array([np.linalg.norm(values[labels == c] - centers[c], axis=1).mean() for c in range(3)])
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(centers[i] - centers[j]) for j in range(3) if j != i) for i in range(3)]
    df = points(spark, labels, values)
    assert Q.inertia(df, 4).first()[0] == pytest.approx(within)
    assert Q.calinski_harabasz(df, 4).first()[0] == pytest.approx((between / 2) / (within / 117))
    assert Q.davies_bouldin(df, 4).first()[0] == pytest.approx(np.mean(worst))


def test_silhouettes_of_several_groupings_share_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    values = rng.normal(size=(90, 3))
    labels = np.stack([np.arange(90) % 2, np.arange(90) % 5, np.where(np.arange(90) == 7, 9, 0)], 1)
    rows = [(k, [int(v) for v in g], [float(v) for v in p]) for k, (g, p) in enumerate(zip(labels, values))]
    table = spark.createDataFrame(rows, "key long, clusters array<long>, point array<double>")
    for limit in (1000, 11):  # one block; blocks of at most about 11 points
        monkeypatch.setattr(Q, "BLOCK_LIMIT", limit)
        monkeypatch.setattr(Q, "TILE", 8)
        got = {r["grouping"]: r["silhouette"] for r in Q.silhouettes(table, 3).collect()}
        assert set(got) == {0, 1, 2}
        for g in range(3):
            assert got[g] == pytest.approx(brute_silhouette(labels[:, g], values), abs=1e-9)
