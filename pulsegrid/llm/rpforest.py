"""Near copies among embeddings by a forest of random projection trees.

Equal vectors are one from the start (each row keeps its id). Of TREES trees each splits the unit vectors
again and again: at every level they are projected on a random direction and cut near the middle, where the
fewest sampled ones stand around; those within the spill of the cut go to both sides. The spill is SPILL
standard deviations of what two vectors of just `least` differ by on a random direction. A node of LEAF
vectors or fewer is a leaf, and so is one whose sides both keep most of it, for such vectors are near each
other. Cuts of a node are found from a sample of about SAMPLE of its vectors (a documented bound); all vectors
are sent down. A round goes down DEPTH levels at most, then nodes that are still too large get new samples.

Within a leaf all vectors are compared, by cosine in double precision, in cells of two parts of PART vectors
at most. A pair that meets in several leaves counts in the first of them, so each cell gives a row for each of
its linked vectors: how many partners it has and one that it is connected with. Pairs are never listed, so rows
follow the vectors, while comparisons follow the square of what stands in one leaf: a dense group of g vectors
that are all near each other takes g * g / 2 of them, as its links have to be counted.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths neither. Rows with equal ids or without an id are rows of their own; a component without
any id has none, and its rows are kept. An empty table gives none. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import HOT, join_groups, row_keys, written
from pulsegrid.llm.components import components

LEAST, TREES, LEAF, SPILL = 0.95, 6, 256, 0.6
#: Vectors of a node that its cuts are found from, and levels that a round goes down.
SAMPLE, DEPTH = 8192, 10
#: Vectors in a part of a large leaf, and how much of a node both of its sides have to keep for it to be a leaf.
PART, DENSE = 2048, 0.85
_CHOICES = np.linspace(0.35, 0.65, 7)


@dataclass(frozen=True)
class Forest:
    least: float = LEAST
    trees: int = TREES
    leaf: int = LEAF
    spill: float = SPILL
    seed: int = 12

    def directions(self, tree: int, level: int, size: int) -> np.ndarray:
        """Random unit vectors of a tree's levels level, level + 1 and so on, as columns."""
        x = np.stack([np.random.default_rng([self.seed, tree, level + k, size]).standard_normal(size) for k in range(DEPTH)], axis=1)
        return x / np.linalg.norm(x, axis=0)

    def margin(self, size: int) -> float:
        return self.spill * np.sqrt(2 * max(1 - self.least, 0.0) / size)

    def cuts(self, sample: np.ndarray, count: int, tree: int, level: int) -> np.ndarray:
        """Where the inner nodes of a subtree of `count` vectors are cut, by number as in a heap (1 is the root, 2 k and 2 k + 1 below k); NaN: not at all."""
        size = sample.shape[1]
        at, margin = sample @ self.directions(tree, level, size), self.margin(size)
        out = np.full(1 << DEPTH, np.nan, np.float64)
        held = {1: np.arange(len(sample))}
        for k in range(1, 1 << DEPTH):
            rows = held.pop(k, None)
            # too few sampled vectors tell nothing: the next round has more of them
            if rows is None or len(rows) < 32 or len(rows) / len(sample) * count <= self.leaf:
                continue
            x = at[rows, k.bit_length() - 1]
            ordered = np.sort(x)
            options = np.quantile(ordered, _CHOICES)
            crowd = np.searchsorted(ordered, options + margin) - np.searchsorted(ordered, options - margin)
            cut = options[int(np.argmin(crowd))]
            left, right = rows[x <= cut + margin], rows[x > cut - margin]
            if max(len(left), len(right)) == len(rows) or min(len(left), len(right)) > DENSE * len(rows):
                continue
            out[k], held[2 * k], held[2 * k + 1] = cut, left, right
        return out

    def sent(self, vectors: np.ndarray, cuts: np.ndarray, tree: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For vectors at a subtree's root: the row numbers and the subtree's leaf, one for each leaf that a row reaches."""
        at, margin = vectors @ self.directions(tree, level, vectors.shape[1]), self.margin(vectors.shape[1])
        row, node = np.arange(len(vectors)), np.ones(len(vectors), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(DEPTH):
            cut = cuts[node]
            ends = np.isnan(cut)
            done.append((row[ends], node[ends]))
            row, node, cut = row[~ends], node[~ends], cut[~ends]
            x = at[row, k]
            left, right = x <= cut + margin, x > cut - margin
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        done.append((row, node))
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def child(node: int, leaf: np.ndarray) -> np.ndarray:
    """Numbers of nodes below `node`: a hash, the same in every task."""
    return np.array([int.from_bytes(hashlib.blake2b(f"{node}/{k}".encode(), digest_size=8).digest(), "big", signed=True) for k in leaf.tolist()], np.int64)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; they are divided by their largest component first, whose square may be out of range."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of equal length as rows of unit length."""
    return units(np.asarray(column.flatten(), np.float64).reshape(-1, size))


def links_of_cell(vectors: np.ndarray, least: float, leaf: int, leaves: list[np.ndarray], times: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors in a leaf, one of `left` and one of `right` (row numbers): linked rows, their number of partners and a row that each is connected with.

    leaves: each row's leaves, ascending. Pairs with an earlier leaf in common are left to that one. times: how many rows of the table a vector stands for.
    """
    alike = vectors[left] @ vectors[right].T >= least
    if len(left) == len(right) and (left == right).all():
        alike = np.triu(alike, 1)
    i, j = np.nonzero(alike)
    if not len(i):
        return i, i, i
    a, b = left[i], right[j]
    linked = np.unique(np.concatenate([a, b]))
    before = [leaves[r][leaves[r] < leaf] for r in linked.tolist()]
    known, code, seen = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
    if (seen > 1).any():
        several = np.cumsum(seen > 1) - 1
        at = np.repeat(np.arange(len(linked)), [len(x) for x in before])
        use = seen[code] > 1
        member = np.zeros((len(linked), int((seen > 1).sum())), np.float32)
        member[at[use], several[code[use]]] = 1
        x, y = np.searchsorted(linked, a), np.searchsorted(linked, b)
        new, step = np.ones(len(a), bool), max(1, (1 << 23) // member.shape[1])
        for lo in range(0, len(a), step):
            new[lo : lo + step] = ~np.einsum("ij,ij->i", member[x[lo : lo + step]], member[y[lo : lo + step]]).astype(bool)
        a, b = a[new], b[new]
    n = len(vectors)
    partners = (np.bincount(a, times[b], n) + np.bincount(b, times[a], n)).astype(np.int64)
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == was).all():
            break
    rows = np.flatnonzero(partners)
    return rows, partners[rows], label[rows]


class NearVectors:
    """Links and components of the vectors of a table. What is computed is written to the shared folder step by step."""

    def __init__(self, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", forest: Forest = Forest()) -> None:
        self.id_col, self.forest = id_col, forest
        self.rows = self._read(table, vector_col)
        doc_id = F.col("id")
        best = F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("id"))
        groups = self.rows.groupBy("print").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n"), F.min(best).alias("best"), F.first("size").alias("size"))
        self.groups = written(groups, "vectors-groups")
        several = self.groups.where("n > 1").select("print", "rep", "n")
        self.total = self.groups.agg(F.sum("n")).first()[0] or 0
        repeated = join_groups(self.rows.select("key", "print"), several, "print", "n", self.total).where("key <> rep").select("key")
        times = several.select(F.col("rep").alias("key"), "n")
        vectors = self.rows.where("size > 0").join(repeated, "key", "left_anti").join(times, "key", "left")
        self.vectors = written(vectors.select("key", "size", "vector", F.coalesce("n", F.lit(1)).alias("n")), "vectors")
        self.cells = written(self._compared(*self._placed()), "vectors-links")

    def _read(self, table: DataFrame, vector_col: str) -> DataFrame:
        """id, key (a number of the row), print (of the vector), size (0 if it links with nothing) and the vector."""
        kind = table.schema[self.id_col].dataType.simpleString()
        single = table.schema[vector_col].dataType == T.ArrayType(T.FloatType())
        number = "float" if single else "double"
        wide = pa.float32() if single else pa.float64()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = 0
            for batch in batches:
                keys = row_keys(batch.num_rows, at)
                at += batch.num_rows
                prints, kept = [], []
                for key, x in zip(keys.tolist(), batch.column(1), strict=True):
                    values = x.values
                    v = np.zeros(0) if values is None or values.null_count else np.asarray(values, np.float64)
                    top = np.abs(v).max() if len(v) else 0.0
                    links = top > 0 and np.isfinite(top)
                    prints.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if links else b"\0" * 8 + int(key).to_bytes(8, "big"))
                    kept.append(v if links else v[:0])
                sizes = np.array([len(v) for v in kept], np.int32)
                vectors = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate([np.zeros(0), *kept]), pa.float64()).cast(wide))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(prints, pa.binary()), pa.array(sizes), vectors], ["id", "key", "print", "size", "vector"])

        rows = table.select(F.col(f"`{self.id_col}`").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{number}>").alias("vector"))
        return written(rows.mapInArrow(run, f"id {kind}, key long, print binary, size int, vector array<{number}>"), "vectors-read")

    def _placed(self) -> tuple[DataFrame, DataFrame]:
        """Where each vector comes to stand: (key, node); and each leaf's number of vectors: (node, count)."""
        forest, done, counted = self.forest, None, None
        trees = F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1)))
        start = self.vectors.select("key", "size", "vector", trees.alias("tree")).withColumn("node", F.xxhash64("tree", "size")).withColumn("level", F.lit(0))
        standing = start
        counts = written(start.groupBy("node", "tree", "level", "size").agg(F.count(F.lit(1)).alias("count")), "vectors-nodes")
        while True:
            large, total = counts.where(F.col("count") > forest.leaf), counts.agg(F.sum("count")).first()[0] or 0
            models = written(self._cuts(standing, large, total), "vectors-cuts")
            split = models.where("split").select("node")
            ends = counts.join(split, "node", "left_anti")
            # leaves of this round: what is small enough, and what no cut parts
            stays = join_groups(standing.select("key", "node"), ends.select("node", "count"), "node", "count", total).select("key", "node")
            done = stays if done is None else done.union(stays)
            counted = ends if counted is None else counted.unionByName(ends)
            if models.where("split").isEmpty():
                return written(done, "vectors-placed"), written(counted.select("node", "count"), "vectors-leaves")
            standing = written(self._sent(standing, models.where("split"), total), "vectors-open")
            counts = written(standing.groupBy("node", "tree", "level", "size").agg(F.count(F.lit(1)).alias("count")), "vectors-nodes")

    def _with_vectors(self, rows: DataFrame) -> DataFrame:
        """rows (key and others) with their vectors, which the first round's rows still have."""
        return rows if "vector" in rows.columns else rows.join(self.vectors.select("key", "vector"), "key")

    def _cuts(self, rows: DataFrame, large: DataFrame, total: int) -> DataFrame:
        """node, tree, level, size, count, cuts of each large node, and whether it is cut at all."""
        forest = self.forest
        chosen = F.pmod(F.xxhash64("key", "node", F.lit(forest.seed)), F.lit(1 << 40)) * F.col("count").cast("double") < F.lit(float(SAMPLE << 40))
        slim = rows.drop("tree", "level", "size")
        sample = self._with_vectors(join_groups(slim, large, "node", "count", total).where(chosen))

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            first = group.iloc[0]
            vectors = units(np.stack(group.sort_values("key")["vector"].to_numpy()).astype(np.float64))
            cuts = forest.cuts(vectors, int(first["count"]), int(first["tree"]), int(first["level"]))
            return pd.DataFrame([(first["node"], first["tree"], first["level"], first["size"], first["count"], cuts, not np.isnan(cuts[1]))], columns=["node", "tree", "level", "size", "count", "cuts", "split"])

        return sample.groupBy("node").applyInPandas(fit, "node long, tree int, level int, size int, count long, cuts array<double>, split boolean")

    def _sent(self, rows: DataFrame, models: DataFrame, total: int) -> DataFrame:
        """The rows of nodes that are cut, at the nodes that they reach. Of hot nodes, 1 / HOT at most, the cuts go to every task; others meet theirs in a shuffle."""
        forest, spark = self.forest, rows.sparkSession
        kind = "key long, node long, tree int, level int, size int"
        hot = models.where(F.col("count") > total * HOT)
        table = {r.node: (r.tree, r.level, np.array(r.cuts, np.float64)) for r in hot.collect()}
        shared = spark.sparkContext.broadcast(table)

        def send(keys: np.ndarray, vectors: np.ndarray, node: int, tree: int, level: int, cuts: np.ndarray) -> pa.RecordBatch:
            row, leaf = forest.sent(vectors, cuts, tree, level)
            numbers, place = np.unique(leaf, return_inverse=True)
            depth = np.floor(np.log2(numbers)).astype(np.int32)
            fixed = lambda v: pa.array(np.full(len(row), v, np.int32))
            return pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(child(node, numbers)[place]), fixed(tree), pa.array(level + depth[place], pa.int32()), fixed(vectors.shape[1])], ["key", "node", "tree", "level", "size"])

        def by_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, nodes, sizes = (batch.column(k).to_numpy() for k in range(3))
                for node in np.unique(nodes).tolist():
                    at = np.flatnonzero(nodes == node)
                    tree, level, cuts = shared.value[node]
                    yield send(keys[at], matrix(batch.column(3).take(pa.array(at)), int(sizes[at[0]])), node, tree, level, cuts)

        def by_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model: dict = {}
            for batch in batches:
                nodes = batch.column(1).to_numpy()
                starts = np.append(np.append(0, np.flatnonzero(nodes[1:] != nodes[:-1]) + 1), len(nodes)) if len(nodes) else np.zeros(1, int)
                for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    part = batch.slice(lo, hi - lo)
                    if part.column(0)[0].as_py() is None:  # a node's cuts come before its rows
                        model = {k: part.column(k)[0].as_py() for k in ("node", "tree", "level", "cuts")}
                        part = part.slice(1)
                    if part.num_rows:
                        yield send(part.column(0).to_numpy(), matrix(part.column(3), part.column(2)[0].as_py()), model["node"], model["tree"], model["level"], np.array(model["cuts"], np.float64))

        place = ["key", "node", "size", "vector"]
        slim = rows.drop("tree", "level")
        out = self._with_vectors(slim.where(F.col("node").isin(list(table)))).select(*place).mapInArrow(by_table, kind) if table else None
        # a node is cut if it has a row among the models; other rows find none and are left out
        cold = models.where(F.col("count") <= total * HOT)
        if not cold.isEmpty():
            theirs = self._with_vectors(slim.join(cold.select("node"), "node", "left_semi")).select(*place, F.lit(None).cast("int").alias("tree"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("array<double>").alias("cuts"))
            heads = cold.select(F.lit(None).cast("long").alias("key"), "node", "size", F.array().cast(self.vectors.schema["vector"].dataType).alias("vector"), "tree", "level", "cuts")
            met = theirs.unionByName(heads).repartition("node").sortWithinPartitions("node", F.col("key").asc_nulls_first()).mapInArrow(by_order, kind)
            out = met if out is None else out.union(met)
        return out

    def _compared(self, placed: DataFrame, leaves: DataFrame) -> DataFrame:
        """Per cell and linked vector: key, partners, and the key of a vector that it is connected with."""
        least = self.forest.least
        lists = placed.groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("leaves"))
        total = leaves.agg(F.sum("count")).first()[0] or 0
        sized = leaves.where("count > 1").select("node", "count", F.ceil(F.col("count") / PART).alias("parts"))
        stands = join_groups(placed, sized, "node", "count", total).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
        stands = stands.select("key", "node", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        cells = stands.select("key", "node", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part")
        dealt = cells.join(self.vectors.join(lists, "key"), "key").select("node", "low", "high", "part", "key", "n", "leaves", "size", "vector")
        dealt = dealt.repartition("node", "low", "high").sortWithinPartitions("node", "low", "high", "key")

        def links(cell: pa.Table) -> pa.RecordBatch:
            cell = cell.combine_chunks()
            low, high, part, key, times = (cell.column(c).to_numpy() for c in ("low", "high", "part", "key", "n"))
            lists, size = cell.column("leaves").chunk(0), cell.column("size")[0].as_py()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            own = [flat[at[k] : at[k + 1]] for k in range(len(key))]
            rows, partners, label = links_of_cell(matrix(cell.column("vector").chunk(0), size), least, cell.column("node")[0].as_py(), own, times, np.flatnonzero(part == low), np.flatnonzero(part == high))
            return pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(key[label]), pa.array(partners)], ["a", "b", "partners"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_, of = [], None
            for batch in batches:
                places = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
                starts = np.append(np.append(0, np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1), len(places)) if len(places) else np.zeros(1, int)
                for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    if open_ and tuple(places[lo]) != of:
                        yield links(pa.Table.from_batches(open_))
                        open_ = []
                    open_.append(batch.slice(lo, hi - lo))
                    of = tuple(places[lo])
            if open_:
                yield links(pa.Table.from_batches(open_))

        return dealt.mapInArrow(run, "a long, b long, partners long")

    def components(self) -> DataFrame:
        """Per row of the table: its id, n_links (other rows linked with it), component_id (the least id that links lead to) and kept (it has that id)."""
        partners = self.cells.groupBy(F.col("a").alias("rep")).agg(F.sum("partners").alias("partners"))
        labels = components(self.cells.select("a", "b"))
        texts = self.groups.join(partners, "rep", "left").join(labels, F.col("rep") == F.col("key"), "left")
        copies = F.when(F.col("size") > 0, F.col("n") - 1).otherwise(0)
        texts = texts.select("print", "n", "best", (F.coalesce("partners", F.lit(0)) + copies).alias("n_links"), F.coalesce("label", "rep").alias("label"))
        texts = written(texts, "vectors-labels")
        first = texts.groupBy("label").agg(F.min("best").alias("first"), F.count(F.lit(1)).alias("texts"))
        vectors = join_groups(texts.drop("best"), first, "label", "texts", texts.count())
        vectors = written(vectors.select("print", "n", "n_links", F.col("first.id").alias("component_id")), "vectors-components")
        joined = join_groups(self.rows.select("id", "print"), vectors, "print", "n", self.total)
        return joined.select(F.col("id").alias(self.id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
