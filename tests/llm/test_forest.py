import numpy as np
import pytest

from pulsegrid.llm import common, rpforest
from pulsegrid.llm.components import components
from pulsegrid.llm.rpforest import Forest, NearVectors, links_of_cell

SCHEMA = "vec_id long, embedding array<float>, label int, key string, node long"


def table_of(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, 0, "k", 1) for i, v in rows], SCHEMA).repartition(partitions)


def brute(rows, least=0.95):
    """The rows of components() from all pairs."""
    vectors = [np.zeros(0) if v is None or any(x is None or not np.isfinite(x) for x in v) else np.array(v, np.float32).astype(np.float64) for _, v in rows]
    able = [len(v) > 0 and bool(v.any()) for v in vectors]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = vectors[a], vectors[b]
            if able[a] and able[b] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a], links[b] = links[a] + 1, links[b] + 1
                parent[root(a)] = root(b)
    least_id = {}
    for k, (i, _) in enumerate(rows):
        least_id.setdefault(root(k), []).append(i)
    least_id = {r: min((i for i in ids if i is not None), default=None) for r, ids in least_id.items()}
    return sorted(((rows[k][0], links[k], least_id[root(k)], rows[k][0] == least_id[root(k)]) for k in range(len(rows))), key=str)


def collected(near):
    return sorted((tuple(r) for r in near.components().collect()), key=str)


def families(n=500, size=16, seed=3):
    """Random vectors, and groups around some that are about 0.95 alike; one group is large."""
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(size) for _ in range(n)]
    for k, count in enumerate([90, 12, 5, 3, 2, 2, 2, 2, 1, 1]):
        out += [out[k] + rng.standard_normal(size) * (0.12 + 0.02 * (k % 4)) for _ in range(count)]
    order = rng.permutation(len(out))
    return [(int(i) * 3, [float(np.float32(x)) for x in out[i]]) for i in order]


def test_links_and_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "SAMPLE", 200)
    monkeypatch.setattr(rpforest, "DEPTH", 3)  # several rounds
    monkeypatch.setattr(rpforest, "PART", 40)  # large leaves in several cells
    rows = families()
    want = brute(rows)
    got = collected(NearVectors(table_of(spark, rows), forest=Forest(leaf=30, trees=8, spill=1.0)))
    links = sum(r[1] for r in want)
    assert links > 3000 and sum(r[1] for r in got) >= 0.99 * links
    of = {r[0]: r[1] for r in want}
    assert all(r[1] <= of[r[0]] for r in got) and len(got) == len(want)


def test_cuts_met_in_a_shuffle_give_the_same_rows(spark, monkeypatch):
    rows, forest = families(200), Forest(leaf=30, trees=3)
    hot = collected(NearVectors(table_of(spark, rows), forest=forest))
    monkeypatch.setattr(rpforest, "HOT", 2)  # no node is hot
    assert collected(NearVectors(table_of(spark, rows, 5), forest=forest)) == hot


def test_awkward_rows(spark):
    a, b = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5]
    rows = [(1, a), (2, a), (2, a), (5, [2.0, 4.0, 6.0]), (4, [1.0, 2.0, 3.4]), (9, b), (None, b), (None, [5.0, 5.0, -5.0]), (None, [5.1, 5.0, -5.0]), (11, None), (None, None), (12, []), (13, [0.0, 0.0, 0.0]), (14, [-0.0, 0.0, 0.0])]
    rows += [(15, [1.0, None, 3.0]), (16, [float("nan"), 2.0, 3.0]), (17, [float("inf"), 2.0, 3.0]), (18, [1.0, 2.0]), (3, [1.0, 2.0]), (20, [1e-30, 2e-30, 3e-30]), (21, [1e30, 2e30, 3e30]), (22, [-1.0, -2.0, -3.0])]
    got = collected(NearVectors(table_of(spark, rows)))
    want = sorted([(i, n, c, True if i is None and c is None else bool(i == c)) for i, n, c, _ in brute(rows)], key=str)
    assert got == want and len(got) == len(rows)
    assert next(r for r in got if r[0] == 5)[1] == 6 and next(r for r in got if r[0] == 3) == (3, 1, 3, True)


def test_empty_table_and_doubles(spark):
    assert collected(NearVectors(table_of(spark, []))) == []
    rows = [(k, [1.0, 1e-9 * k, 0.0]) for k in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert collected(NearVectors(table)) == [(k, 4, 0, k == 0) for k in range(5)]


def test_many_copies_count_without_being_compared(spark):
    rng = np.random.default_rng(1)
    base = [float(np.float32(x)) for x in rng.standard_normal(8)]
    near = [float(np.float32(x)) for x in np.array(base) * 1.0 + 0.01]
    rows = [(k, base) for k in range(3000)] + [(10_000, near)] + [(20_000 + k, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for k in range(50)]
    near_vectors = NearVectors(table_of(spark, rows))
    got = {r[0]: r for r in collected(near_vectors)}
    assert got[0][1:] == (3000, 0, True) and got[2999][1:] == (3000, 0, False) and got[10_000][1:] == (3000, 0, False)
    assert near_vectors.vectors.count() == 52


@pytest.mark.parametrize("spill", [0.0, 0.6])
def test_a_row_reaches_each_side_that_it_is_near(spill):
    rng = np.random.default_rng(0)
    forest = Forest(spill=spill, leaf=50)
    x = rpforest.units(rng.standard_normal((2000, 24)))
    cuts = forest.cuts(x, len(x), 0, 0)
    row, leaf = forest.sent(x, cuts, 0, 0)
    assert set(row.tolist()) == set(range(2000)) and (len(row) == 2000) == (spill == 0)
    assert max(np.unique(leaf, return_counts=True)[1]) <= 60 and not np.isnan(cuts[1])
    dense = rpforest.units(np.ones(24) + 0.01 * rng.standard_normal((500, 24)))
    assert np.isnan(Forest(leaf=50).cuts(dense, len(dense), 0, 0)).all()


def test_a_pair_counts_in_its_first_leaf_alone():
    v = rpforest.units(np.array([[1.0, 0.0], [1.0, 0.1], [1.0, 0.2], [0.0, 1.0]]))
    leaves = [np.array(x, np.int64) for x in ([1, 5], [1, 5], [5, 9], [5])]
    all_ = np.arange(4)
    of = lambda leaf: [x.tolist() for x in links_of_cell(v, 0.95, leaf, leaves, np.array([1, 2, 3, 1]), all_, all_)]
    assert of(5) == [[0, 1, 2], [3, 3, 3], [0, 0, 0]]  # 0 with 2, 1 with 2
    assert links_of_cell(v[:2], 0.95, 1, leaves[:2], np.array([1, 2]), np.arange(2), np.arange(2))[1].tolist() == [2, 1]


def test_components_of_a_hub_and_of_a_long_path(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 1 / 20)
    hub = spark.range(1, 100_001).selectExpr("7000000 as a", "id * 10 as b")
    path = spark.range(0, 300).selectExpr("8000000 + id as a", "8000001 + id as b")
    got = components(hub.union(path)).groupBy("label").count().collect()
    assert sorted((r.label, r["count"]) for r in got) == [(10, 100_001), (8_000_000, 301)]
    assert components(hub.where("false")).collect() == []


def test_components_of_random_links(spark):
    rng = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 500, (330, 2))] + [(-5, -5), (3, 3), (1, 2), (2, 1)]
    label = {k: k for pair in links for k in pair if pair[0] != pair[1]}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == label and len(set(got.values())) > 20
