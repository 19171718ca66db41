"""What the driver has to hold: broadcasts, plans, pieces of the texts that it fits on."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.texts import docs

from pulsegrid.llm import common, mil, mixing
from pulsegrid.llm.common import join_groups, written


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("given", [False, True])
def test_groups_are_broadcast_only_where_one_is_hot(spark, monkeypatch, given):
    rows = spark.range(2000).select(F.when(F.col("id") % 10 > 0, F.when(F.col("id") % 4 > 0, F.col("id") % 80)).alias("k"), "id")
    groups = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")), "groups")
    most = groups.where("k is not null").agg(F.max("n")).first()[0] if given else None
    want = sorted(map(tuple, rows.join(groups, "k").collect()))
    assert max(r[2] for r in want) == most if given else want
    plain = join_groups(rows, groups, "k", "n", 2000, most)
    assert "strategy=broadcast" not in plan_of(plain) and sorted(map(tuple, plain.collect())) == want
    monkeypatch.setattr(common, "FEW_ROWS", 10)
    hot = join_groups(rows, groups, "k", "n", 2000, most)
    assert plan_of(hot).count("strategy=broadcast") == 2 and sorted(map(tuple, hot.select(plain.columns).collect())) == want


def test_a_mix_is_planned_in_steps(spark, monkeypatch):
    plans = {}

    def noting(df, name):
        plans[name] = plan_of(df)
        return written(df, name)

    monkeypatch.setattr(mixing, "written", noting)
    mixing.mixed(docs(spark)).collect()
    reads = [line for line in plans["mix-edges"].splitlines() if "Relation [" in line]
    # the documents' places are read once, and apportionment reads its parties twice
    assert sum("_place" in line for line in reads) == 1 and len(reads) <= 5


def test_passages_in_small_pieces():
    rng = np.random.default_rng(3)
    sizes = np.append(rng.integers(0, 4000, 2000), (0, 300_000, 1))
    raw, offsets = rng.choice(np.frombuffer(b"abc de. F\n1\xc3\xa4", np.uint8), int(sizes.sum())), np.append(0, np.cumsum(sizes))

    def measured(*more):
        tracemalloc.start()
        out = mil.passages(raw, offsets, *more)
        peak = tracemalloc.get_traced_memory()[1] - out[0].nbytes
        tracemalloc.stop()
        return out, peak

    measured()  # the tables of powers
    (a, n), whole = measured()
    (b, m), pieces = measured(1 << 16)
    assert (a == b).all() and (n == m).all() and pieces < 0.6 * whole
