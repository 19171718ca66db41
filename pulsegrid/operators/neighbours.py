"""Nearest rows and local outlier factors against all reference rows, as joins of boxes.

Reference rows are dealt to boxes by a k-d partition: a node is cut at the median of the feature that varies
most in it, found from a bounded sample, and a box that still holds more than PART rows has several parts. A row
is compared with its own part first. How far its k-th neighbour is there tells which boxes can hold a nearer
one; they are found from the root of the partition down, as no row of a node is nearer than the smallest box
around its rows. Only those are asked, so rows of several independent features meet few boxes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.functions.quantiles import RANGE_ROWS
from pulsegrid.functions.tables import pinned

#: Reference rows of a part, about, and rows that are compared with a part at once.
PART, TILE = RANGE_ROWS, 32
MOST_TASKS = 4096
#: Boxes at most, a table of which (two numbers for each feature) goes through the driver, and sampled rows for each that cuts are found from.
MOST_BOXES, PER_BOX = 1 << 14, 16
CELL = ["box", "part", "lane"]


@dataclass(frozen=True)
class Boxes:
    """Nodes by number as in a heap: 1 is the root, 2 k and 2 k + 1 are below k. feature: which one is cut (-1: a box), at `cut`."""

    feature: np.ndarray
    cut: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, boxes: int) -> Boxes:
        depth = max(0, math.ceil(math.log2(max(boxes, 1))))
        feature, cut = np.full(2 << depth, -1), np.zeros(2 << depth)
        todo = [(1, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if node >= 1 << depth or len(own) < 2:
                continue
            x = rows[own]
            f = int(x.var(axis=0).argmax())
            at = np.partition(x[:, f], (len(own) - 1) // 2)[(len(own) - 1) // 2]
            right = x[:, f] > at
            if not right.any():  # the larger half is equal: what is below it is cut off, if anything
                below = x[:, f][x[:, f] < at]
                if not len(below):
                    continue
                at = below.max()
                right = x[:, f] > at
            feature[node], cut[node] = f, at
            todo += [(2 * node, own[~right]), (2 * node + 1, own[right])]
        return cls(feature, cut)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The box of each row."""
        node = np.ones(len(x), np.int64)
        while (live := np.flatnonzero(self.feature[node] >= 0)).size:
            at = node[live]
            node[live] = 2 * at + (x[live, self.feature[at]] > self.cut[at])
        return node


@dataclass(frozen=True)
class Reach:
    """The smallest boxes around the reference rows of all nodes (lo above hi: it has none), and the parts of the boxes."""

    boxes: Boxes
    lo: np.ndarray
    hi: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, boxes: Boxes, p: int, rows: dict[int, tuple[np.ndarray, np.ndarray, int]]) -> Reach:
        """rows: of each box with reference rows its lowest and highest values and its parts."""
        n = len(boxes.feature)
        lo, hi, parts = np.full((n, p), np.inf), np.full((n, p), -np.inf), np.zeros(n, np.int64)
        for node, (low, high, count) in rows.items():
            lo[node], hi[node], parts[node] = low, high, count
        for node in range(n // 2 - 1, 0, -1):
            if boxes.feature[node] >= 0:
                lo[node], hi[node] = np.minimum(lo[2 * node], lo[2 * node + 1]), np.maximum(hi[2 * node], hi[2 * node + 1])
        return cls(boxes, lo, hi, parts)

    def within(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and boxes that hold a reference row which may be nearer than the row's bound."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        rows, found = [], []
        while len(row):
            gap = np.maximum(np.maximum(self.lo[node] - x[row], x[row] - self.hi[node]), 0)
            near = np.sqrt((gap * gap).sum(axis=1)) < bounds[row] * (1 + 1e-12)
            row, node = row[near], node[near]
            ends = self.boxes.feature[node] < 0
            rows.append(row[ends])
            found.append(node[ends])
            row, node = np.repeat(row[~ends], 2), (2 * node[~ends][:, None] + np.arange(2)).reshape(-1)
        return np.concatenate(rows), np.concatenate(found)


def least_of(x: np.ndarray, rows: np.ndarray, k: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of x its k nearest of rows that are nearer than its bound, of equally far ones the first: how many, which, and how far."""
    sizes, places, far = [], [], []
    for at in range(0, len(x), TILE):
        some = x[at : at + TILE]
        d = np.zeros((len(some), len(rows)))
        for f in range(x.shape[1]):
            d += (some[:, f, None] - rows[None, :, f]) ** 2
        bound = bounds[at : at + TILE]
        # few rows are within a known bound, so that nothing has to be sorted for it
        most = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(rows) and np.isinf(bound).any() else np.inf
        row, place = np.nonzero(d <= np.minimum(most, bound * bound * (1 + 1e-12))[:, None])
        found = np.sqrt(d[row, place])
        near = found < bound[row]
        row, place, found = row[near], place[near], found[near]
        order = np.lexsort((place, found, row))
        row, place, found = row[order], place[order], found[order]
        counts = np.bincount(row, minlength=len(some))
        first = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) < k
        sizes.append(np.minimum(counts, k))
        places.append(place[first])
        far.append(found[first])
    return np.concatenate(sizes), np.concatenate(places), np.concatenate(far)


def _answered(told: DataFrame, asks: DataFrame, k: int, tasks: int) -> DataFrame:
    """asks with `far` and `near`: of those rows of told that are in their cell. Rows of box -1 stay as they are."""
    kind = asks.schema
    rows = told.select(*[F.col(c) if c in told.columns else F.lit(None).cast(kind[c].dataType).alias(c) for c in asks.columns], F.lit(False).alias("asking"))
    both = rows.unionByName(asks.withColumn("asking", F.lit(True)))
    # a stated number, as few bytes can be much to compare
    both = both.repartition(tasks, *CELL).sortWithinPartitions(*CELL, "asking", "key")
    schema, at = to_arrow_schema(kind), {c: i for i, c in enumerate(asks.columns)}

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(at["x"]).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, xs, keys = None, [], []
        for batch in batches:
            places = np.stack([batch.column(at[c]).to_numpy().astype(np.int64) for c in CELL] + [batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            starts = np.append(0, np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1) if len(places) else []
            for lo, hi in zip(starts, np.append(starts[1:], len(places)).astype(int), strict=True):
                part, place = batch.slice(lo, hi - lo), tuple(places[lo, :3])
                if place != cell:
                    cell, xs, keys = place, [], []
                if not places[lo, 3]:
                    xs.append(matrix(part))
                    keys.append(part.column(at["key"]))
                    continue
                columns = part.columns[: len(at)]
                if place[0] >= 0:
                    if len(xs) > 1:
                        xs, keys = [np.concatenate(xs)], [pa.concat_arrays(keys)]
                    n = part.num_rows
                    sizes, near, far = least_of(matrix(part), xs[0], k, part.column(at["bound"]).to_numpy()) if xs else (np.zeros(n, int), np.zeros(0, int), np.zeros(0))
                    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
                    values = keys[0].take(pa.array(near)) if keys else columns[at["key"]].slice(0, 0)
                    columns[at["far"]] = pa.ListArray.from_arrays(offsets, pa.array(far)).cast(schema.field("far").type)
                    columns[at["near"]] = pa.ListArray.from_arrays(offsets, values).cast(schema.field("near").type)
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return both.mapInArrow(run, kind)


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def _fitted(rows: DataFrame, p: int, n: int) -> Boxes:
    """The partition of n reference rows (key, x), from about PER_BOX sampled rows for each of its boxes."""
    boxes = min(MOST_BOXES, -(-n // PART))
    if boxes < 2:
        return Boxes.of(np.zeros((0, p)), 1)
    draw = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 40)).cast("double") * n
    sample = rows.where(draw < float(PER_BOX * boxes << 40)).select("x").toArrow()["x"].combine_chunks()
    sample = _matrix(sample, p)
    return Boxes.of(sample[np.lexsort(sample.T)], boxes)


def nearest(df: DataFrame, features: Sequence[str], key: str, reference: Column, k: int) -> DataFrame:
    """key, reference and `near`, an array of (far, key): each row's k nearest reference rows, itself included, in order.

    `key` tells rows apart. Rows that lack a feature are left out. Of equally far rows, those of a row's own
    part come first, then those with the least key; no row is asked about what can't be nearer, so many equal
    rows are not compared with each other.
    """
    spark, p = df.sparkSession, len(features)
    x = F.array(*[F.col(f).cast("double") for f in features])
    known = df.select(F.col(key).alias("key"), F.coalesce(reference, F.lit(False)).alias("reference"), x.alias("x"))
    known = known.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    own = F.col("reference")
    boxes = spark.sparkContext.broadcast(_fitted(known.where(own), p, known.where(own).count()))

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(boxes.value.place(_matrix(batch.column(2), p)), pa.int32())], ["key", "reference", "x", "box"])

    along = known.mapInArrow(located, T.StructType([*known.schema.fields, T.StructField("box", T.IntegerType())]))
    ends = [f(F.when(own, F.get("x", F.lit(i)))).alias(f"{name}{i}") for i in range(p) for name, f in (("lo", F.min), ("hi", F.max))]
    tally = {r["box"]: r for r in along.groupBy("box").agg(F.count_if(own).alias("told"), F.count(F.lit(1)).alias("n"), *ends).collect()}
    parts = {b: max(1, math.ceil(r["told"] / PART)) for b, r in tally.items()}
    # of a box with few reference rows and many others, each part is copied to several lanes
    lanes = {b: max(1, math.ceil(r["n"] / parts[b] / (4 * PART))) for b, r in tally.items()}
    tasks = min(sum(parts[b] * lanes[b] for b in tally) or 1, MOST_TASKS)
    sizes = spark.createDataFrame([(b, parts[b], lanes[b]) for b in tally], "box int, parts long, lanes int")
    deal = lambda rows: rows.join(F.broadcast(sizes), "box")
    lane = F.pmod(F.xxhash64("key", F.lit(7)), F.col("lanes")).cast("int")
    placed = deal(along).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    told = placed.where("reference").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    lists = [F.lit(None).cast(t).alias(c) for c, t in (("far", T.ArrayType(T.DoubleType())), ("near", T.ArrayType(df.schema[key].dataType)))]
    asks = placed.select("box", "part", lane.alias("lane"), "key", "reference", "x", F.lit(math.inf).alias("bound"), *lists)
    first = _answered(told, asks, k, tasks)
    with_rows = {b: (np.array([r[f"lo{i}"] for i in range(p)]), np.array([r[f"hi{i}"] for i in range(p)]), parts[b]) for b, r in tally.items() if r["told"]}
    if sum(parts[b] for b in with_rows) > 1:
        reach = spark.sparkContext.broadcast(Reach.of(boxes.value, p, with_rows))
        kind = T.StructType([*first.schema.fields, T.StructField("cells", T.ArrayType(T.StructType.fromDDL("box int, part long")))])
        arrow, at = to_arrow_schema(kind), {c: i for i, c in enumerate(first.columns)}

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The parts that a row asks besides its own, and one of box -1, where it stays as it is."""
            for batch in batches:
                n = batch.num_rows
                row, box = reach.value.within(_matrix(batch.column(at["x"]), p), batch.column(at["bound"]).to_numpy())
                counts = reach.value.parts[box]
                row, box = np.repeat(row, counts), np.repeat(box, counts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                other = (box != batch.column(at["box"]).to_numpy()[row]) | (part != batch.column(at["part"]).to_numpy()[row])
                row, box, part = (np.concatenate([a, b[other]]) for a, b in ((np.arange(n), row), (np.full(n, -1), box), (np.arange(n), part)))
                order = np.argsort(row, kind="stable")
                cells = pa.StructArray.from_arrays([pa.array(box[order], pa.int32()), pa.array(part[order], pa.int64())], ["box", "part"])
                offsets = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells).cast(arrow.field("cells").type)], schema=arrow)

        bound = F.when(F.size("far") == k, F.element_at("far", -1)).otherwise(F.lit(math.inf))
        more = first.withColumn("bound", bound).mapInArrow(reached, kind).withColumn("cell", F.explode("cells"))
        kept = lambda c: F.when(F.col("cell.box") < 0, F.col(c)).alias(c)
        more = more.select("cell.box", "cell.part", "key", "reference", "x", "bound", kept("far"), kept("near"))
        more = more.join(F.broadcast(sizes.select("box", "lanes")), "box", "left").withColumn("lane", F.coalesce(lane, F.lit(0)))
        first = _answered(told, more.select(*asks.columns), k, tasks)
    pairs = F.arrays_zip(F.col("far").alias("far"), F.col("near").alias("key"))
    merged = first.groupBy("key", "reference").agg(F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, k).alias("near"))
    return merged


def local_outlier_factors(df: DataFrame, features: Sequence[str], key: str, reference: Column, k: int = 20, name: str = "score") -> DataFrame:
    """key and factor of each row that has all features: the mean density of its k nearest reference rows over its own.

    Densities are those of all reference rows. A reference row's neighbours are others; when it is scored it is
    a new row, and so its own neighbour. With fewer than 2 reference rows there is no factor and no row.
    """
    k = min(k, df.where(reference).dropna(subset=list(features)).count() - 1)
    near = nearest(df, features, key, reference, max(k, 1) + 1).where(F.lit(k > 0))
    others = F.slice(F.filter("near", lambda o: o["key"] != F.col("key")), 1, max(k, 1))
    own = near.where("reference").select("key", others.alias("near"))
    kdist = own.select(F.col("key").alias("other"), F.element_at("near", -1)["far"].alias("kdist"))
    pairs = own.select("key", F.explode("near").alias("o")).select("key", F.col("o.key").alias("other"), "o.far")
    reach = F.avg(F.greatest("kdist", "far")) + F.lit(1e-10)
    density = pairs.join(kdist, "other").groupBy(F.col("key").alias("other")).agg(F.max("far").alias("kdist"), (1 / reach).alias("density"))
    asked = near.select("key", F.explode(F.slice("near", 1, max(k, 1))).alias("o")).select("key", F.col("o.key").alias("other"), "o.far")
    return asked.join(density, "other").groupBy(F.col("key").alias(key)).agg((F.avg("density") * reach).alias(name))


def left_out_factors(df: DataFrame, features: Sequence[str], k: int | None = None) -> DataFrame:
    """fold and score of each row that has all features: its factor against the densities of all others, as if they alone were known.

    One search finds each row's k + 1 nearest others. To leave a row out moves up the k-th neighbour of those that
    had it among theirs, so only their distances, and the densities that hang on them, are taken anew: a pair of
    rows meets the neighbours of its second, in joins of n * k rows and lists of (k + 1) * k keys. By default k is
    20 or the root of the number of rows. Fewer than 3 rows have no factors.
    """
    keyed = pinned(df.select(F.monotonically_increasing_id().alias("fold"), *features), "left-out")
    n = keyed.dropna(subset=list(features)).count()
    k = min(n - 2, max(20, math.isqrt(max(n - 1, 0))) if k is None else k)
    if k < 1:
        return keyed.where("false").select("fold", F.lit(0.0).alias("score"))
    near = nearest(keyed, features, "fold", F.lit(True), k + 2)
    others = F.slice(F.filter("near", lambda o: o["key"] != F.col("key")), 1, k + 1)
    lists = pinned(near.select("key", others.alias("near")).where(F.size("near") == k + 1), "left-out-near")
    far = lambda place: F.element_at("near", F.lit(place))["far"]
    own = lists.select("key", F.transform(F.slice("near", 1, k), lambda o: o["key"]).alias("first"), far(k).alias("kdist"), far(k + 1).alias("kdist1"))
    links = lists.select(F.col("key").alias("o"), F.posexplode("near").alias("place", "x")).select("o", "place", F.col("x.key").alias("key"), "x.far")
    about = links.join(own, "key").groupBy("o").agg(F.array_sort(F.collect_list(F.struct("place", "key", "far", "kdist", "kdist1", "first"))).alias("around"))
    about = about.join(own.select(F.col("key").alias("o"), "first", "kdist", "kdist1"), "o")
    without = lambda first, kdist, kdist1: F.when(F.array_contains(first, F.col("fold")), kdist1).otherwise(kdist)
    pairs = links.where(F.col("place") < k).select(F.col("o").alias("fold"), F.col("key").alias("o"), "far").join(about, "o")
    around = F.slice(F.filter("around", lambda q: q["key"] != F.col("fold")), 1, k)
    reach = F.aggregate(around, F.lit(0.0), lambda total, q: total + F.greatest(without(q["first"], q["kdist"], q["kdist1"]), q["far"]))
    density = 1 / (reach / k + F.lit(1e-10))
    known = pairs.select("fold", density.alias("density"), F.greatest(without(F.col("first"), F.col("kdist"), F.col("kdist1")), F.col("far")).alias("reach"))
    return known.groupBy("fold").agg((F.avg("density") * (F.avg("reach") + F.lit(1e-10))).alias("score"))
