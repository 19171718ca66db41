"""One-class detectors: higher scores are more anomalous, and a row is flagged above a threshold.

Moments are aggregates over all rows; what comes to the driver is a row of p (p + 3) / 2 numbers.
An isolation forest's trees draw their rows from all rows. Other detectors that keep rows (LOF, one-class
SVM) are fitted on a sample of a stated bound, are broadcast, and score Arrow batches; `neighbours` has
factors against all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.config import LOO_PERCENTILE
from pulsegrid.functions.quantiles import exact_quantiles, range_of
from pulsegrid.functions.tables import pinned

#: Rows that a detector which keeps rows may be fitted on (a documented bound: at 14 features 2 MB).
MOST_ROWS = 20_000
#: A value with more than one row in HOT is looked up without a shuffle.
HOT = 2000


def moments(df: DataFrame, features: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means and sample covariance, in one pass."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    row = df.agg(F.count(F.lit(1)), *[F.avg(f) for f in features], *[F.covar_samp(features[i], features[j]) for i, j in pairs]).first()
    p = len(features)
    cov = np.zeros((p, p))
    for (i, j), v in zip(pairs, row[1 + p :], strict=True):
        cov[i, j] = cov[j, i] = v if v is not None and v == v else 0.0
    return row[0], np.array([v or 0.0 for v in row[1 : 1 + p]]), cov


def sampled(df: DataFrame, features: Sequence[str], most: int = MOST_ROWS, seed: int = 42) -> np.ndarray:
    """The feature rows of df if there are no more than `most`, else about that many, chosen by a hash of their values and, of equal rows, their number."""
    n = df.count()
    df = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    if n > most:
        # equal rows are alike, so which of them is the i-th does not matter
        copies = df.groupBy(*features).agg(F.count(F.lit(1)).alias("_n"))
        runs = copies.select(*features, "_n", F.explode(F.expr("sequence(0L, _n - 1, 4096L)")).alias("_from"))
        copies = runs.select(*features, F.explode(F.expr("sequence(_from, least(_from + 4095, _n - 1))")).alias("_i"))
        df = copies.where(F.pmod(F.xxhash64(*features, "_i", F.lit(seed)), F.lit(1 << 50)) < int(most / n * (1 << 50))).select(*features)
    rows = df.collect()
    return np.array(sorted(map(tuple, rows)), float).reshape(-1, len(features))


def scored(df: DataFrame, features: Sequence[str], score: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """df with the column `name`, computed from Arrow batches of the features in place."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(columns.index(f)).to_numpy(zero_copy_only=False) for f in features]).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(x), pa.float64())], [*columns, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


@dataclass(frozen=True)
class Ellipsoid:
    """Distance from a mean under an inverse covariance; squared or not."""

    features: tuple[str, ...]
    mean: np.ndarray
    inverse: np.ndarray
    squared: bool = False

    def column(self) -> Column:
        """As one expression, inside whole-stage code."""
        d = [F.col(f) - F.lit(float(m)) for f, m in zip(self.features, self.mean, strict=True)]
        total = F.lit(0.0)
        for i in range(len(d)):
            inner = sum((F.lit(float(self.inverse[i, j] * (1 if i == j else 2))) * d[j] for j in range(i, len(d))), F.lit(0.0))
            total = total + d[i] * inner
        return total if self.squared else F.sqrt(F.greatest(total, F.lit(0.0)))


def fit_mahalanobis(df: DataFrame, features: Sequence[str], ridge: float = 1e-6) -> Ellipsoid:
    _, mean, cov = moments(df, features)
    return Ellipsoid(tuple(features), mean, np.linalg.pinv(cov + ridge * np.eye(len(features))))


@dataclass(frozen=True)
class LocalOutlierFactor:
    """Of new points: the mean density of their k nearest reference rows over their own."""

    rows: np.ndarray
    k: int
    kdist: np.ndarray
    density: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, k: int | None = None) -> LocalOutlierFactor:
        k = min(len(rows) - 1, max(20, math.isqrt(len(rows))) if k is None else k)
        kdist, near, far = np.empty(len(rows)), np.empty((len(rows), k), int), np.empty((len(rows), k))
        for at in range(0, len(rows), 512):
            d = cls._distances(rows[at : at + 512], rows)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + 512] = np.argsort(d, axis=1, kind="stable")[:, :k]
            far[at : at + 512] = np.take_along_axis(d, near[at : at + 512], axis=1)
        kdist = far[:, -1]
        return cls(rows, k, kdist, 1 / (np.maximum(kdist[near], far).mean(axis=1) + 1e-10))

    @staticmethod
    def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)) if a.shape[1] < 32 else np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), 512):
            d = self._distances(x[at : at + 512], self.rows)
            near = np.argsort(d, axis=1, kind="stable")[:, : self.k]
            reach = np.maximum(self.kdist[near], np.take_along_axis(d, near, axis=1))
            own = 1 / (reach.mean(axis=1) + 1e-10)
            out[at : at + 512] = self.density[near].mean(axis=1) / own
        return out


def _unsuccessful(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n keys."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class IsolationForest:
    """Trees as arrays: feature (-1: leaf), cut, left child (the right one follows), size."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sample: int

    @classmethod
    def of(cls, rows: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 42) -> IsolationForest:
        take = min(sample, len(rows))
        drawn = lambda k: rows[np.random.default_rng((seed, k, 1)).choice(len(rows), take, replace=False)]
        return cls([tuple(map(np.array, grown(drawn(k), k, seed))) for k in range(trees)], take)

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for feature, cut, left, size in self.trees:
            node, steps, live = np.zeros(len(x), int), np.zeros(len(x)), np.ones(len(x), bool)
            while live.any():
                f = feature[node]
                live = f >= 0
                rows = np.flatnonzero(live)
                node[rows] = left[node[rows]] + (x[rows, f[rows]] > cut[node[rows]])
                steps[rows] += 1
            depth += steps + _unsuccessful(size[node])
        return 2 ** (-depth / len(self.trees) / max(float(_unsuccessful(self.sample)), 1e-12))


def grown(x: np.ndarray, k: int, seed: int) -> tuple[list, list, list, list]:
    """The k-th tree, of the rows x: random cuts of random features that still vary, to a depth of log2 of their number."""
    rng, take = np.random.default_rng((seed, k)), len(x)
    feature, cut, left, size = [-1], [0.0], [0], [take]
    todo = [(0, np.arange(take), 0)]
    while todo:
        node, own, depth = todo.pop()
        lo, hi = x[own].min(axis=0), x[own].max(axis=0)
        able = np.flatnonzero(hi > lo)
        if len(own) < 2 or depth >= math.ceil(math.log2(max(take, 2))) or not len(able):
            continue
        f = int(rng.choice(able))
        at = float(rng.uniform(lo[f], hi[f]))
        right = x[own, f] > at
        feature[node], cut[node], left[node] = f, at, len(feature)
        for side in (own[~right], own[right]):
            todo.append((len(feature), side, depth + 1))
            feature.append(-1)
            cut.append(0.0)
            left.append(0)
            size.append(len(side))
    return feature, cut, left, size


def draws(rows: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """A hash of each row number (64 bits) and tree as 53-bit integers, a row for each row and a column for each tree."""
    x = rows.astype(np.uint64)[:, None] + np.random.default_rng(seed).integers(0, 1 << 63, trees, dtype=np.uint64)[None, :] * np.uint64(2)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11)


def fit_forest(df: DataFrame, features: Sequence[str], trees: int = 200, sample: int = 256, seed: int = 42) -> IsolationForest:
    """Each tree draws its rows from all rows: those of the least hashes of their values, their number among equal rows and the tree.

    Hashes below a threshold pass, a few more than are drawn, so a tree's draw is a bounded group, and it is the
    same however the rows are dealt. Trees grow in tasks of their own; their nodes come to the driver.
    """
    p = len(features)
    values = F.array(*[F.col(f).cast("double") for f in features])
    copies = df.select(values.alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    if not total:
        return IsolationForest([(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1))], 1)
    take = min(sample, total)
    limit = int(min(1.0, (take + 8 * math.sqrt(take) + 20) / total) * (1 << 53))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, counts = batch.column(2).to_numpy().astype(np.uint64), batch.column(1).to_numpy()
            starts = np.append(0, np.cumsum(counts))
            for at in range(0, int(starts[-1]), 4096):
                nth = np.arange(at, min(at + 4096, int(starts[-1])))
                row = np.searchsorted(starts, nth, side="right") - 1
                hashes = draws(base[row] + (nth - starts[row]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), trees, seed)
                i, tree = np.nonzero(hashes < limit)
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(hashes[i, tree].astype(np.int64)), batch.column(0).take(pa.array(row[i]))], ["tree", "hash", "x"])

    def grow(own: pd.DataFrame) -> pd.DataFrame:
        k, order = int(own["tree"].iloc[0]), own["hash"].argsort(kind="stable").to_numpy()
        x = np.stack(own["x"].to_numpy()).astype(float).reshape(-1, p)
        chosen = x[order[:take]]
        return pd.DataFrame([(k, *map(np.array, grown(chosen[np.lexsort(chosen.T)], k, seed)))], columns=["tree", "feature", "cut", "left", "size"])

    drawn = copies.select("x", "n", F.xxhash64("x", F.lit(seed)).alias("base")).mapInArrow(draw, "tree long, hash long, x array<double>")
    got = drawn.groupBy("tree").applyInPandas(grow, "tree long, feature array<int>, cut array<double>, left array<int>, size array<int>").collect()
    return IsolationForest([(np.array(r.feature), np.array(r.cut), np.array(r.left), np.array(r.size)) for r in sorted(got)], take)


def _gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    for n in range(1, 2000):
        term *= x / (a + n)
        total += term
        if term < total * 1e-15:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, degrees: int) -> float:
    lo, hi = 0.0, degrees + 40 * math.sqrt(2 * degrees) + 40
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_share(degrees / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def fit_robust(df: DataFrame, features: Sequence[str], support: float = 0.9, starts: int = 30, seed: int = 42, steps: int = 30) -> Ellipsoid:
    """Minimum covariance determinant, reweighted; scores are squared distances.

    Random starts are concentrated on a bounded sample; from the best of them, steps over all rows
    follow, each a quantile of the distances and the moments of the rows within it.
    """
    p, rows = len(features), sampled(df, features, 4096)
    n = df.count()
    rng = np.random.default_rng(seed)

    def concentrate(mean: np.ndarray, inverse: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        d = np.einsum("ij,jk,ik->i", rows - mean, inverse, rows - mean)
        own = rows[np.argsort(d, kind="stable")[: max(p + 1, int(support * len(rows)))]]
        cov = np.cov(own.T, ddof=0).reshape(p, p)
        return float(np.linalg.slogdet(cov + 1e-12 * np.eye(p))[1]), own.mean(axis=0), np.linalg.pinv(cov)

    best = None
    for _ in range(starts):
        own = rows[rng.choice(len(rows), min(len(rows), p + 1), replace=False)]
        found = (0.0, own.mean(axis=0), np.linalg.pinv(np.cov(own.T, ddof=0).reshape(p, p)))
        for _ in range(steps):
            again = concentrate(found[1], found[2])
            done, found = abs(again[0] - found[0]) < 1e-12, again
            if done:
                break
        best = found if best is None or found[0] < best[0] else best
    shape = Ellipsoid(tuple(features), best[1], best[2], True)
    if n > len(rows):
        last = math.inf
        for _ in range(steps):
            limit = exact_quantiles(df.select(shape.column().alias("d")), ["d"], [support])["d"][0]
            _, mean, cov = moments(df.where(shape.column() <= limit), features)
            shape, det = Ellipsoid(shape.features, mean, np.linalg.pinv(cov), True), np.linalg.slogdet(cov + 1e-12 * np.eye(p))[1]
            if last - det < 1e-9:
                break
            last = det
    middle = exact_quantiles(df.select(shape.column().alias("d")), ["d"], [0.5])["d"][0]
    scale = middle / chi2_quantile(0.5, p)
    inside = df.where(shape.column() / F.lit(scale) < chi2_quantile(0.975, p))
    m, mean, cov = moments(inside, features)
    return Ellipsoid(tuple(features), mean, np.linalg.pinv(cov * (m - 1) / max(m, 1)), True)


@dataclass(frozen=True)
class OneClassSvm:
    """Score: minus the sum of the support vectors' kernels."""

    rows: np.ndarray
    weights: np.ndarray
    gamma: float

    @classmethod
    def of(cls, x: np.ndarray, nu: float = 0.01, tolerance: float = 1e-6, most_steps: int = 200_000) -> OneClassSvm:
        """Pairwise ascent: of weights within [0, 1] that sum to nu n, the most violating two exchange weight until none gains."""
        n = len(x)
        gamma = 1 / (x.shape[1] * x.var()) if x.var() else 1.0
        sq = (x * x).sum(axis=1)
        k = np.exp(-gamma * np.maximum(sq[:, None] + sq - 2 * x @ x.T, 0))
        a, left = np.zeros(n), nu * n
        for i in range(n):
            a[i], left = min(1.0, left), max(0.0, left - 1.0)
        g = k @ a
        for _ in range(most_steps):
            up, down = np.where(a < 1, g, np.inf).argmin(), np.where(a > 0, g, -np.inf).argmax()
            if g[down] - g[up] < tolerance:
                break
            move = min((g[down] - g[up]) / max(k[up, up] + k[down, down] - 2 * k[up, down], 1e-12), 1 - a[up], a[down])
            a[up] += move
            a[down] -= move
            g += move * (k[up] - k[down])
        own = a > 0
        return cls(x[own], a[own], gamma)

    def score(self, x: np.ndarray) -> np.ndarray:
        d = ((x[:, None, :] - self.rows[None]) ** 2).sum(axis=2)
        return -(np.exp(-self.gamma * d) @ self.weights)


@dataclass(frozen=True)
class Components:
    """Principal components of the covariance; the score is the squared distance from the space they span."""

    features: tuple[str, ...]
    mean: np.ndarray
    axes: np.ndarray

    def projection(self, k: int) -> Column:
        return sum((F.lit(float(v)) * (F.col(f) - F.lit(float(m))) for f, m, v in zip(self.features, self.mean, self.axes[:, k], strict=True)), F.lit(0.0))

    def column(self) -> Column:
        total = sum(((F.col(f) - F.lit(float(m))) ** 2 for f, m in zip(self.features, self.mean, strict=True)), F.lit(0.0))
        return F.greatest(total - sum((self.projection(k) ** 2 for k in range(self.axes.shape[1])), F.lit(0.0)), F.lit(0.0))


def fit_components(df: DataFrame, features: Sequence[str], keep: float | int = 0.95) -> Components:
    """keep: share of the variance, or the number of components."""
    _, mean, cov = moments(df, features)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    k = keep if isinstance(keep, int) else int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), keep)) + 1
    return Components(tuple(features), mean, vectors[:, : min(k, len(features))])


def ecod(df: DataFrame, features: Sequence[str], key: str, name: str = "score") -> DataFrame:
    """Empirical tail probabilities: the largest of the sums of -ln of left, right and (by skewness) chosen tails.

    Values are laid out one a row, (row, feature, value), so all features are ranked at once and only these slim
    rows are shuffled; ranks come from counts of distinct values (see `feature_ranks`). Values of more than 1
    row in HOT of a feature, HOT at most, are looked up by broadcast.
    """
    columns = df.columns
    skews = df.agg(*[F.skewness(F.col(f).cast("double")).alias(f) for f in features]).first()
    rows = pinned(df.withColumn("_row", F.monotonically_increasing_id()), "tails")
    n = rows.count()
    values = rows.select("_row", F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("feature", "v"))
    ranks = pinned(feature_ranks(values), "tail-ranks")
    hot = F.broadcast(ranks.where(F.col("n") > n / HOT).select(F.col("feature").alias("_f"), F.col("v").alias("_v"), "up_to", "from"))
    same = (F.col("feature") == F.col("_f")) & F.col("v").eqNullSafe(F.col("_v"))
    rest = ranks.where(F.col("n") <= n / HOT).select(F.col("feature").alias("_f"), F.col("v").alias("_v"), "up_to", "from")
    known = values.join(hot, same).unionByName(values.join(hot.drop("up_to", "from"), same, "left_anti").join(rest, same))
    left, right = -F.log(F.col("up_to") / n), -F.log(F.col("from") / n)
    falls = F.array(*[F.lit(skews[f] is not None and skews[f] < 0) for f in features])
    chosen = F.when(F.get(falls, F.col("feature")), left).otherwise(right)
    scores = known.groupBy("_row").agg(F.greatest(F.sum(left), F.sum(right), F.sum(chosen)).alias(name))
    return rows.join(scores, "_row").select(*columns, name)


def feature_ranks(values: DataFrame, ranges: int = 256) -> DataFrame:
    """values (feature, v): per feature and distinct value, how many rows have it, how many have no larger one (`up_to`) and how many no smaller one (`from`); null is the least, NaN the largest.

    Counts are dealt by ranges of the feature's values, `ranges` at most; the ranges' totals, one row each, are summed first.
    """
    counts = values.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy("feature").agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 10_000).alias("ends"))
    part = F.when(F.col("v").isNull(), -1).otherwise(F.size(F.filter(F.coalesce("ends", F.array().cast("array<double>")), lambda e: e < F.col("v"))))
    dealt = counts.join(F.broadcast(ends), "feature").select("feature", "v", "n", part.alias("part"))
    totals = dealt.groupBy("feature", "part").agg(F.sum("n").alias("here"))
    of = Window.partitionBy("feature")
    starts = totals.select("feature", "part", (F.sum("here").over(of.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(of).alias("total"))
    ranked = dealt.join(starts, ["feature", "part"]).withColumn("up_to", F.col("before") + F.sum("n").over(Window.partitionBy("feature", "part").orderBy("v")))
    return ranked.select("feature", "v", "n", "up_to", (F.col("total") - F.col("up_to") + F.col("n")).alias("from"))


def value_ranks(values: DataFrame, column: str) -> DataFrame:
    """Per distinct value: how many rows have it, how many have no larger one (`up_to`) and how many no smaller one (`from`).

    Counts are dealt by range of the value; totals of the ranges, one row each, are summed first.
    """
    counts = values.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    dealt = counts.select(column, "n", range_of(values, column).alias("_part"))
    totals = dealt.groupBy("_part").agg(F.sum("n").alias("_all"))
    upward = Window.orderBy("_part")
    starts = totals.select("_part", (F.sum("_all").over(upward) - F.col("_all")).alias("_before"), F.sum("_all").over(Window.partitionBy(F.lit(0))).alias("_total"))
    inside = Window.partitionBy("_part").orderBy(column)
    ranked = dealt.join(starts, "_part").withColumn("up_to", F.col("_before") + F.sum("n").over(inside))
    return ranked.select(column, "n", "up_to", (F.col("_total") - F.col("up_to") + F.col("n")).alias("from"))


def _loo_one(rows: np.ndarray, i: int, model: str, trees: int = 200) -> float:
    others, own = np.delete(rows, i, axis=0), rows[i : i + 1]
    if model == "mahalanobis":
        d = own[0] - others.mean(axis=0)
        return float(np.sqrt(d @ np.linalg.pinv(np.cov(others.T).reshape(len(d), -1) + 1e-6 * np.eye(len(d))) @ d))
    if model == "lof":
        return float(LocalOutlierFactor.of(others).score(own)[0])
    if model == "ocsvm":
        return float(OneClassSvm.of(others).score(own)[0])
    if model == "isoforest":
        return float(IsolationForest.of(others, trees).score(own)[0])
    raise ValueError(f"no leave-one-out for {model}")


def _left_out_components(df: DataFrame, features: Sequence[str], keep: float = 0.95) -> DataFrame:
    """Each row's `score`: its squared distance from the components of the others.

    Their covariance is that of all rows, less a multiple of the row's own products; batches of them are
    decomposed at once, p * p numbers for each row.
    """
    n, mean, cov = moments(df, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - mean
            scores = []
            for at in range(0, len(x), 1024):
                own = x[at : at + 1024]
                others = cov * ((n - 1) / (n - 2)) - own[:, :, None] * own[:, None, :] * (n / (n - 1) / (n - 2))
                values, axes = np.linalg.eigh(others)
                values, axes = np.maximum(values[:, ::-1], 0), axes[:, :, ::-1]
                share = np.cumsum(values, axis=1) / np.maximum(values.sum(axis=1, keepdims=True), 1e-300)
                kept = np.arange(x.shape[1]) <= (share < keep).sum(axis=1, keepdims=True)
                d = own * (n / (n - 1))
                along = np.einsum("ij,ijk->ik", d, axes) * kept
                scores.append(((d - np.einsum("ik,ijk->ij", along, axes)) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["score"])

    if n < 3:
        return df.select(F.lit(0.0).alias("score"))
    return df.select(*[F.col(f).cast("double") for f in features]).mapInArrow(run, "score double")


def leave_one_out(df: DataFrame, features: Sequence[str], model: str, share: float = LOO_PERCENTILE, trees: int = 200) -> tuple[float, DataFrame]:
    """The threshold at `share` of the left-out scores, and the scores (fold, score).

    Mahalanobis and PCA scores are those of all rows, from the moments without the row (a rank-one downdate). ECOD
    ranks a new row among the known ones and itself, so its left-out scores are those of all rows. Local outlier
    factors are those of all rows too (see `neighbours.left_out_factors`). Of isolation forests and one-class SVMs
    every fold is a row of a job over the broadcast (bounded) rows.
    """
    spark = df.sparkSession
    if model == "ecod":
        keyed = df.select(F.monotonically_increasing_id().alias("fold"), *features)
        folds = ecod(keyed, features, "fold").select("fold", "score")
        return exact_quantiles(folds, ["score"], [share])["score"][0], folds
    if model == "mahalanobis":
        n, mean, cov = moments(df, features)
        if n > 2:
            own = Ellipsoid(tuple(features), mean, np.linalg.pinv(cov * (n - 1) / (n - 2) + 1e-6 * np.eye(len(features))), True).column()
            left_out = F.sqrt(F.greatest(own / (1 - own * (n / (n - 1) / (n - 2))), F.lit(0.0))) * (n / (n - 1))
            folds = df.select(F.monotonically_increasing_id().alias("fold"), left_out.alias("score"))
            return exact_quantiles(folds, ["score"], [share])["score"][0], folds
    if model == "pca":
        folds = _left_out_components(df, features).select(F.monotonically_increasing_id().alias("fold"), "score")
        return exact_quantiles(folds, ["score"], [share])["score"][0], folds
    if model == "lof":
        from pulsegrid.operators.neighbours import left_out_factors

        folds = left_out_factors(df, features)
        return exact_quantiles(folds, ["score"], [share])["score"][0], folds
    rows = sampled(df, features)
    shared = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [_loo_one(shared.value, i, model, trees) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["fold", "score"])

    folds = spark.range(len(rows), numPartitions=max(1, min(64, len(rows) // 4))).select(F.col("id").alias("fold")).mapInArrow(run, "fold long, score double")
    return exact_quantiles(folds, ["score"], [share])["score"][0], folds
