"""Small hand-made tables with results that are worked out apart from the library."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import detectors, evaluation, neighbours, prep, schedule, selection

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(30, 3))
    x[:, 2] += 0.8 * x[:, 0]
    return np.round(x, 4)


@pytest.fixture(scope="module")
def far():
    return np.array([[6.0, -5.0, 0.0], [0.1, 0.2, 9.0], [0.0, 0.1, 0.05], [-7.0, 7.0, 7.0]])


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows.tolist(), "a double, b double, c double").cache()


def values(spark, x, score):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(x.tolist())], "i int, a double, b double, c double")
    out = df.withColumn("s", score) if not callable(score) else detectors.scored(df, FEATURES, score, "s")
    return [r.s for r in out.orderBy("i").collect()]


def distance(p, x):
    d = p - x.mean(axis=0)
    return math.sqrt(d @ np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(3)) @ d)


def density_factor(p, x, k):
    """Local outlier factor of a new point, neighbour by neighbour."""
    dist = lambda a, b: math.sqrt(sum((u - v) ** 2 for u, v in zip(a, b, strict=True)))
    near = {i: sorted((dist(x[i], x[j]), j) for j in range(len(x)) if j != i)[:k] for i in range(len(x))}
    reach = lambda d, j: max(d, near[j][-1][0])
    density = {i: 1 / (sum(reach(d, j) for d, j in near[i]) / k + 1e-10) for i in near}
    own = sorted((dist(p, x[j]), j) for j in range(len(x)))[:k]
    return sum(density[j] for _, j in own) / k * (sum(reach(d, j) for d, j in own) / k + 1e-10)


def test_mahalanobis(spark, table, rows, far):
    assert np.allclose(values(spark, far, detectors.fit_mahalanobis(table, FEATURES).column()), [distance(p, rows) for p in far])
    left_out = [distance(rows[i], np.delete(rows, i, axis=0)) for i in range(30)]
    threshold, folds = detectors.leave_one_out(table, FEATURES, "mahalanobis")
    assert np.allclose(sorted(r.score for r in folds.collect()), sorted(left_out)) and abs(threshold - np.quantile(left_out, 0.99)) < 1e-9


def test_local_outlier_factor(spark, table, rows, far):
    model = detectors.LocalOutlierFactor.of(detectors.sampled(table, FEATURES))
    assert model.k == 20 and np.allclose(values(spark, far, model.score), [density_factor(p, rows, 20) for p in far])
    threshold, _ = detectors.leave_one_out(table, FEATURES, "lof")
    assert abs(threshold - np.quantile([density_factor(rows[i], np.delete(rows, i, axis=0), 20) for i in range(30)], 0.99)) < 1e-9


def test_left_out_factors_equal_refits(spark):
    x = np.random.default_rng(8).normal(size=(150, 3))
    folds = neighbours.left_out_factors(spark.createDataFrame(x.tolist(), "a double, b double, c double").repartition(5), FEATURES, 7)
    want = [detectors.LocalOutlierFactor.of(np.delete(x, i, axis=0), 7).score(x[i : i + 1])[0] for i in range(150)]
    assert np.allclose(sorted(r.score for r in folds.collect()), sorted(want))
    assert neighbours.left_out_factors(spark.createDataFrame(x[:2].tolist(), "a double, b double, c double"), FEATURES).collect() == []


def test_one_class_svm_meets_its_conditions(rows, far):
    model = detectors.OneClassSvm.of(rows, nu=0.2)
    gamma = 1 / (3 * rows.var())
    kernel = lambda a, b: np.exp(-gamma * ((a - b) ** 2).sum())
    assert abs(model.weights.sum() - 0.2 * 30) < 1e-9 and (model.weights > 0).all() and (model.weights <= 1 + 1e-12).all()
    scores = model.score(rows)
    assert np.allclose(scores, [-sum(w * kernel(p, r) for w, r in zip(model.weights, model.rows, strict=True)) for p in rows])
    # support vectors inside the bounds lie on one level, those at 1 above it, all others below
    weight = {tuple(r): w for r, w in zip(model.rows, model.weights, strict=True)}
    inner = [s for s, r in zip(scores, rows, strict=True) if 1e-6 < weight.get(tuple(r), 0) < 1 - 1e-6]
    assert inner and max(inner) - min(inner) < 1e-4
    assert all(s >= min(inner) - 1e-4 for s, r in zip(scores, rows, strict=True) if weight.get(tuple(r), 0) >= 1 - 1e-6)
    assert all(s <= max(inner) + 1e-4 for s, r in zip(scores, rows, strict=True) if tuple(r) not in weight)
    assert (model.score(far[[0, 1, 3]]) > max(scores)).all()


def test_robust_covariance_is_not_drawn_by_outliers(spark, rows, far):
    dirty = np.concatenate([rows, np.full((3, 3), 40.0)])
    model = detectors.fit_robust(spark.createDataFrame(dirty.tolist(), "a double, b double, c double"), FEATURES)
    assert np.abs(model.mean - rows.mean(axis=0)).max() < 0.5
    got = values(spark, np.array([[40.0, 40.0, 40.0], rows.mean(axis=0)]), model.column())
    assert got[0] > 500 and got[1] < 2


def test_isolation_forest(spark, table, rows, far):
    model = detectors.fit_forest(table, FEATURES, 60)
    scores = model.score(np.concatenate([rows, far]))
    assert min(scores[[30, 33]]) > max(scores[:30]) and scores[31] > np.median(scores[:30]) and (scores > 0).all() and (scores < 1).all()
    threshold, folds = detectors.leave_one_out(table, FEATURES, "isoforest", trees=15)
    assert folds.count() == 30 and 0.4 < threshold < 0.9
    one = detectors.IsolationForest.of(np.delete(detectors.sampled(table, FEATURES), 4, axis=0), 15).score(detectors.sampled(table, FEATURES)[4:5])[0]
    assert abs({r.fold: r.score for r in folds.collect()}[4] - one) < 1e-12


def test_trees_draw_from_every_row_however_they_are_dealt(spark):
    x = np.random.default_rng(2).normal(size=(30_000, 2))
    x[20_000:] = x[0]  # a third are equal rows
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    one, two = (detectors.fit_forest(d, ["a", "b"], 20, 64) for d in (df, df.repartition(7)))
    assert all((a == b).all() for s, t in zip(one.trees, two.trees, strict=True) for a, b in zip(s, t, strict=True))
    assert one.sample == 64 and all(t[3][0] == 64 for t in one.trees) and len({t[1][0] for t in one.trees}) > 15
    hashes = detectors.draws(np.arange(2000), 5, 42) / (1 << 53)
    assert abs(hashes.mean() - 0.5) < 0.02 and abs(np.corrcoef(hashes.T)[0, 1]) < 0.1


def test_principal_components(spark, table, rows, far):
    _, s, axes = np.linalg.svd(rows - rows.mean(axis=0))
    k = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.8)) + 1
    want = [(((p - rows.mean(axis=0)) - axes[:k].T @ (axes[:k] @ (p - rows.mean(axis=0)))) ** 2).sum() for p in far]
    assert np.allclose(values(spark, far, detectors.fit_components(table, FEATURES, 0.8).column()), want)

    def left_out(i, x):
        others = np.delete(x, i, axis=0)
        _, s, axes = np.linalg.svd(others - others.mean(axis=0))
        k = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.95)) + 1
        d = x[i] - others.mean(axis=0)
        return ((d - axes[:k].T @ (axes[:k] @ d)) ** 2).sum()

    many = np.random.default_rng(3).normal(size=(500, 5)) * [3, 2, 1, 0.5, 0.2] + 7
    df = spark.createDataFrame(many.tolist(), "a double, b double, c double, d double, e double")
    threshold, folds = detectors.leave_one_out(df, list("abcde"), "pca")
    want = [left_out(i, many) for i in range(500)]
    assert np.allclose(sorted(r.score for r in folds.collect()), sorted(want)) and abs(threshold - np.quantile(want, 0.99)) < 1e-9


def test_left_out_tail_scores_are_those_of_all_rows(table, rows):
    threshold, folds = detectors.leave_one_out(table, FEATURES, "ecod", 0.9)
    tails = [[(-math.log(np.mean(v <= p)), -math.log(np.mean(v >= p)), ((v - v.mean()) ** 3).mean()) for v, p in zip(rows.T, r, strict=True)] for r in rows]
    want = [max(sum(t[0] for t in ts), sum(t[1] for t in ts), sum(t[0] if t[2] < 0 else t[1] for t in ts)) for ts in tails]
    assert np.allclose(sorted(r.score for r in folds.collect()), sorted(want)) and abs(threshold - np.quantile(want, 0.9)) < 1e-9


def test_pruning_clipping_and_scaling(spark):
    n = 40
    data = [(f"f{i}", float(i), 5.0, 1.0 if i else 2.0, float(i * i % 17)) for i in range(n)]
    df = spark.createDataFrame(data, "file string, a double, flat double, mostly double, c double")
    assert prep.pruned(df, ["a", "flat", "mostly", "c"]) == ["a", "c"]
    assert [r.feature for r in prep.zero_variance(df, ["a", "flat"]).where("dropped").collect()] == ["flat"]
    lo, hi = prep.fit_bounds(df, ["a"])["a"]
    assert abs(lo - 0.39) < 1e-12 and abs(hi - 38.61) < 1e-12
    params = prep.fit(df, ["a"])
    assert params["a"][2:] == (19.5, 19.5)
    assert [r.a for r in prep.transform(df, params).where("file in ('f0', 'f39', 'f20')").orderBy("a").collect()] == pytest.approx([(0.39 - 19.5) / 19.5, 0.5 / 19.5, (38.61 - 19.5) / 19.5])


def test_importance_equals_shuffles_by_hand(spark):
    for n in (1, 2, 5, 16, 17, 1000):
        for key in (0, 7):
            assert sorted(selection.shuffled(np.arange(n), n, key, 42).tolist()) == list(range(n))
    assert (selection.shuffled(np.arange(1000), 1000, 0, 42) != selection.shuffled(np.arange(1000), 1000, 1, 42)).sum() > 900
    x = np.random.default_rng(6).normal(size=(83, 2))
    df = spark.createDataFrame(x.tolist(), "a double, b double").repartition(4)
    n, numbered = selection.numbered_rows(df, ["a", "b"])
    order = np.array([r.x for r in numbered.orderBy("number").collect()])
    assert n == 83 and [r.number for r in numbered.orderBy("number").collect()] == list(range(83))
    assert sorted(map(tuple, order)) == sorted(map(tuple, x))
    got = {r.feature: r.importance for r in selection.permutation_importance(df, ["a", "b"], lambda x: x[:, 0] * x[:, 1], 5).collect()}
    # the rows may be numbered otherwise in another run: each feature's mean lies near that of all shuffles
    for f, j in (("a", 0), ("b", 1)):
        want = np.mean([np.abs(x[i, j] - x[k, j]) * abs(x[i, 1 - j]) for i in range(83) for k in range(83)])
        assert abs(got[f] - want) < 0.25 * want


def test_permutation_importance_and_pairs(spark, rows):
    df = spark.createDataFrame([(*r, r[0] * 2 + 1) for r in rows.tolist()], "a double, b double, c double, d double")
    got = {r.feature: r for r in selection.permutation_importance(df, ["a", "b"], lambda x: 3 * x[:, 0], repeats=20).collect()}
    assert got["b"].importance == 0 and got["b"].spread == 0
    expected = 3 * np.abs(rows[:, 0][:, None] - rows[:, 0]).mean()
    assert abs(got["a"].importance - expected) < 0.2 * expected
    near = {(r.a, r.b) for r in selection.correlations(df, ["a", "b", "c", "d"]).where("abs(r) >= 0.95").collect()}
    assert near == {("a", "d")}
    with pytest.raises(ValueError, match="2"):
        selection.enough(["a", "b"])


def test_schedule_by_hand(spark):
    day = lambda d, *times: [dt.datetime(2024, 5, d, h, m) for h, m in times]
    at = day(1, (6, 0), (10, 0), (14, 0)) + day(2, (6, 30), (10, 0), (14, 30)) + day(3, (7, 0))
    df = spark.createDataFrame([(1, i, t, 40.0 + i) for i, t in enumerate(at)], "machine int, id int, ts timestamp, duration double")
    own = schedule.fit(df, "intra_day").first()
    # the third day has one of three activations and is left out
    assert (own.n_training_days, own.n_training_cycles, own.expected_cycles_per_day) == (2, 6, 3)
    gaps = [4.0, 4.0, 3.5, 4.5]
    assert own.interval_mean == 3600 * 4 and own.interval_std == round(3600 * float(np.std(gaps, ddof=1)), 3)
    assert own.expected_hours == [6.25, 10.0, 14.25] and own.duration_mean == 42.5
    # nights count and a day's first gap does not: 14:00 after 10:00, 10:00 after 14:00 of the day before, 14:30 after 10:00
    assert schedule.fit(df, "reference").first().interval_mean == round(3600 * (4 + 20 + 4.5) / 3, 3)


def test_votes_thresholds_and_areas(spark):
    df = spark.createDataFrame([("n1", "normal", 0.1, 0), ("n2", "normal", 0.6, 1), ("n3", "normal", 0.2, 0), ("x1", "anomalous", 0.9, 1), ("x2", "anomalous", 0.6, 1), ("x3", "anomalous", 0.15, 0)], "file string, label string, score_m double, flag_m int")
    got = evaluation.metrics(evaluation.long_scores(df, ["m"])).first().asDict()
    assert got == {"model": "m", "n_normal": 3, "false_positives": 1, "n_anomalous": 3, "tp": 2, "false_positive_rate": 0.3333, "detection_rate": 0.6667, "precision": 0.6667, "recall": 0.6667, "f1": 0.6667}
    pairs = list(itertools.product([0.9, 0.6, 0.15], [0.1, 0.6, 0.2]))
    assert abs(evaluation.auc(df, "score_m", F.col("label") == "anomalous").first().auc - sum((p > n) + (p == n) / 2 for p, n in pairs) / 9) < 1e-12
    assert evaluation.patch_threshold({"name": "m"}, df.where("label = 'normal'"), F.col("score_m"))["threshold"] == pytest.approx(np.quantile([0.1, 0.6, 0.2], 0.95))
    assert evaluation.detection_matrix(df, ["m"]).orderBy("clip").first().asDict() == {"clip": "x1", "m": 1, "vote": 0}
