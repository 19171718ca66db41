"""Nearest rows and outlier factors over blocks against all distances at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import neighbours
from pulsegrid.operators.detectors import LocalOutlierFactor

FEATURES = ["a", "b", "c"]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 50)


def frame(spark, x):
    rows = pd.DataFrame(x, columns=FEATURES)
    return spark.createDataFrame(rows.assign(id=np.arange(len(x)), normal=np.arange(len(x)) % 4 != 0))


@pytest.mark.parametrize("equal", [0, 150])
def test_nearest_equal_all_distances(spark, small_blocks, equal):
    x = np.random.default_rng(1).normal(size=(450, 3))
    x[450 - equal :] = x[0]
    got = {r.key: [o.far for o in r.near] for r in neighbours.nearest(frame(spark, x), FEATURES, "id", F.col("normal"), 21).collect()}
    own = x[np.arange(450) % 4 != 0]
    want = np.sort(np.sqrt(((x[:, None] - own[None]) ** 2).sum(2)), axis=1)[:, :21]
    assert len(got) == 450
    assert np.allclose([got[i] for i in range(450)], want, atol=1e-12)


def test_factors_do_not_hang_on_blocks(spark, small_blocks):
    x = np.random.default_rng(2).normal(size=(400, 3))
    got = dict(map(tuple, neighbours.local_outlier_factors(frame(spark, x), FEATURES, "id", F.col("normal")).collect()))
    want = LocalOutlierFactor.of(x[np.arange(400) % 4 != 0], 20).score(x)
    assert np.allclose([got[i] for i in range(400)], want)


def test_factors_of_rows_on_a_grid(spark, small_blocks):
    # many rows are equally far, some are equal: which of them are taken as neighbours hangs on the boxes, factors hardly do
    x = np.random.default_rng(4).integers(0, 6, (600, 3)).astype(float)
    got = dict(map(tuple, neighbours.local_outlier_factors(frame(spark, x), FEATURES, "id", F.col("normal")).collect()))
    want = LocalOutlierFactor.of(x[np.arange(600) % 4 != 0], 20).score(x)
    assert np.allclose([got[i] for i in range(600)], want, rtol=0.02)


def test_boxes_hold_their_rows_and_rule_out_the_others():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(3000, 4)), np.repeat(rng.normal(size=(1, 4)), 500, axis=0)])
    boxes = neighbours.Boxes.of(x[::3], 64)
    place = boxes.place(x)
    assert 40 <= len(np.unique(place)) <= 64 and (boxes.feature[place] < 0).all()
    spans = {b: (x[place == b].min(axis=0), x[place == b].max(axis=0), 1) for b in np.unique(place).tolist()}
    reach = neighbours.Reach.of(boxes, 4, spans)
    asked = rng.normal(size=(200, 4)) * 1.5
    bounds = rng.uniform(0.1, 1.0, 200)
    row, box = reach.within(asked, bounds)
    want = {(i, b) for i in range(200) for b, (lo, hi, _) in spans.items() if np.sqrt((np.clip(np.maximum(lo - asked[i], asked[i] - hi), 0, None) ** 2).sum()) < bounds[i]}
    assert set(zip(row.tolist(), box.tolist(), strict=True)) == want and len(want) < 200 * len(spans) / 3
    assert sorted(reach.within(x[:1], np.array([np.inf]))[1].tolist()) == sorted(spans)
    assert neighbours.Boxes.of(np.zeros((0, 2)), 8).place(np.ones((3, 2))).tolist() == [1, 1, 1]


def test_missing_features_and_few_rows(spark):
    df = spark.createDataFrame([(1, 0.0, True), (2, None, True), (3, float("nan"), True), (4, 1.0, True), (5, 3.0, None), (6, 0.0, True)], "id long, a double, normal boolean")
    got = {r.key: [o.key for o in r.near] for r in neighbours.nearest(df, ["a"], "id", F.col("normal"), 2).collect()}
    assert got == {1: [1, 6], 4: [4, 1], 5: [4, 1], 6: [1, 6]}
    assert neighbours.local_outlier_factors(df, ["a"], "id", F.col("normal")).count() == 4
    assert neighbours.local_outlier_factors(df.where("id <= 3"), ["a"], "id", F.col("normal")).count() == 0
    assert neighbours.local_outlier_factors(df.limit(0), ["a"], "id", F.col("normal")).count() == 0
