"""Merkle manifest of a dataset: one digest for all rows, one for each group, and a proof for each row.

A row's leaf is the digest of its columns. In a group the leaves ascend by id; two consecutive nodes become
their digest (a last one alone, too) until one remains, the group's root. These, ordered by group, become
the manifest's root the same way. H is the lowercase hex of sha256, its inputs concatenated.

Trees are built in tiers of TIER levels: each block of 2^TIER nodes is a row, so a group of any size is
spread over its blocks, and leaves are numbered by sorted ranges and the ranges' counts. All nodes are
written as a table (tree, level, place, node). For a proof, a leaf's index and its group's size give the
coordinates of the siblings it needs: those of the lowest tier are exploded by the leaves, those of the
next tier once for each block, and so on, so no node is looked up by more than 2^TIER rows. They are joined
with the table, ordered by level and concatenated; the fold of leaf and siblings gives the root.

Rows with equal ids ascend by their leaf; null ids and null groups come first; rows that agree in all
columns are leaves of their own. A null value is told from an empty one, so any text may be in a column.
An empty table has no root: its frames are empty. Of docs only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import join_groups, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TIER = 8
_PATH = "array<struct<level:int,left:boolean,node:binary>>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 bytes with their number before them, `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _height(n: Column) -> Column:
    """Levels above n leaves: the bits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _shifted(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _nodes_at(n: Column, level: Column) -> Column:
    """Nodes of a level of a tree with n leaves."""
    return _shifted(n - 1, level) + 1


def numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """leaves (tree, node, columns of `order`, others) with `place` in their tree, from 0, and `n`, the tree's leaves.

    Rows are sorted by ranges; a row's place is its place in its range and what the ranges before hold of its tree.
    """
    spread = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    at = F.monotonically_increasing_id()
    ranged = written(spread.select("*", F.spark_partition_id().alias("part"), at.alias("at")), "merkle-ranged")
    held = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    # a row for each range, and one more for each further tree in it
    before = F.sum("here").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    size = F.sum("here").over(Window.partitionBy("tree"))
    held = held.select("tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), size.alias("n"))
    joined = ranged.join(held, ["tree", "part"])
    return written(joined.select(*leaves.columns, (F.col("at") - F.col("first") + F.col("before")).alias("place"), "n"), "merkle-placed")


def _levels(block: Column, n: Column, base: int) -> Column:
    """The nodes of a block at levels base, base + 1 and so on, as far as its tree and the tier go."""
    steps = F.greatest(F.least(_height(n) - base, F.lit(TIER)), F.lit(0))

    def above(nodes: Column) -> Column:
        pair = lambda j: F.sha2(F.concat(F.get(nodes, 2 * j), F.coalesce(F.get(nodes, 2 * j + 1), F.lit(""))), 256)
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), pair)

    rise = F.aggregate(F.sequence(F.lit(1), steps), F.array(block), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))
    return F.when(steps > 0, rise).otherwise(F.array(block))


@dataclass
class Trees:
    """leaves: tree, place, n, node and the columns they came with. nodes: tree, n, level, place, node (32 bytes)."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame  # tree, n, root
    height: int

    @classmethod
    def of(cls, leaves: DataFrame, order: Sequence[str]) -> Trees:
        """Trees of leaves (tree: string, node: hex, columns of `order`, others), their leaves ascending by `order`."""
        placed = numbered(leaves, order)
        height = placed.agg(F.max(_height(F.col("n")))).first()[0] or 0
        ground, tiers = placed.select("tree", "n", "place", "node"), []
        for base in range(0, max(height, 1), TIER):
            block = F.shiftright("place", TIER)
            blocks = ground.groupBy("tree", "n", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("own"))
            levels = blocks.select("tree", "n", "block", F.posexplode(_levels(F.col("own.node"), F.col("n"), base)).alias("up", "row"))
            # the topmost level of a block is a leaf of the next tier, or the root
            made = levels.select("tree", "n", (F.col("up") + base).alias("level"), F.col("up").alias("up"), "block", F.posexplode("row").alias("j", "node"))
            place = F.shiftleft(F.col("block"), TIER)
            tier = made.select("tree", "n", "level", "up", (_shifted(place, F.col("up")) + F.col("j")).alias("place"), F.unhex("node").alias("node"))
            tiers.append(written(tier, "merkle-nodes"))
            ground = tiers[-1].where((F.col("up") == TIER) & (F.col("level") < _height(F.col("n")))).select("tree", "n", "place", F.lower(F.hex("node")).alias("node"))
        nodes = tiers[0]
        for tier in tiers[1:]:
            nodes = nodes.union(tier.where("up > 0"))  # up = 0 repeats the level that the tier stands on
        roots = nodes.where(F.col("level") == _height(F.col("n"))).select("tree", "n", F.lower(F.hex("node")).alias("root"))
        return cls(placed, nodes.select("tree", "n", "level", "place", "node"), roots, height)

    def proofs(self) -> DataFrame:
        """tree, place and `path` of each leaf: from its level up, the sibling of each level and whether it stands left (a null node: there is none)."""
        above, tier = None, (max(self.height - 1, 0) // TIER) * TIER
        for base in range(tier, -1, -TIER):
            n, place = F.col("n"), F.col("place")
            first = self.nodes.where((F.col("level") == base) & (_height(n) > base)).select("tree", "n", "place")
            last = F.least(_height(n), F.lit(base + TIER)) - 1
            level = F.explode(F.sequence(F.lit(base), last))
            wanted = first.select("tree", "n", "place", level.alias("level"))
            own = _shifted(place, F.col("level") - base)
            wanted = wanted.select("tree", "place", "level", own.bitwiseXOR(F.lit(1).cast("long")).alias("want"), (own % 2 == 1).alias("left"), _nodes_at(n, F.col("level")).alias("there"))
            exists = F.col("want") < F.col("there")
            alone = wanted.where(~exists).select("tree", "place", "level", "left", F.lit(None).cast("binary").alias("node"))
            table = self.nodes.where(F.col("level").between(base, base + TIER - 1)).select("tree", F.col("level"), F.col("place").alias("want"), "node")
            found = wanted.where(exists).join(table, ["tree", "level", "want"]).select("tree", "place", "level", "left", "node")
            steps = found.unionByName(alone).groupBy("tree", "place").agg(F.array_sort(F.collect_list(F.struct("level", "left", "node"))).alias("path"))
            if above is not None:
                up = above.select("tree", F.col("place").alias("block"), F.col("path").alias("further"))
                steps = steps.withColumn("block", F.shiftright("place", TIER)).join(up, ["tree", "block"], "left")
                steps = steps.select("tree", "place", F.concat("path", F.coalesce("further", F.array().cast(_PATH))).alias("path"))
            above = written(steps, "merkle-paths")
        return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and the siblings of its path give."""
    hexed = lambda s: F.lower(F.hex(s["node"]))
    step = lambda own, s: F.sha2(F.when(s["node"].isNull(), own).when(s["left"], F.concat(hexed(s), own)).otherwise(F.concat(own, hexed(s))), 256)
    return F.aggregate(path, leaf, step)


def siblings(path: Column) -> Column:
    """The siblings of a path, from the leaf up, as hex one after the other."""
    return F.array_join(F.transform(F.filter(path, lambda s: s["node"].isNotNull()), lambda s: F.lower(F.hex(s["node"]))), "")


class Manifest:
    """Leaves of docs in a tree for each value of `group`, and a tree of their roots.

    tampered: columns of docs (by name) as they are when rows are verified, if they differ from those that were signed.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", group: str = "lang", columns: Sequence[str] = COLUMNS, tampered: dict[str, Column] | None = None) -> None:
        signed = [F.col(f"`{c}`") for c in columns]
        seen = [(tampered or {}).get(c, F.col(f"`{c}`")) for c in columns]
        own, now = leaf(*signed), leaf(*seen)
        # a null group comes before all others, an empty one too
        tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
        # written, so that sorting them by ranges doesn't read the texts again; rows that agree in all columns have a number to be parted by
        leaves = docs.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), own.alias("node"), now.alias("now"), F.monotonically_increasing_id().alias("row"))
        self.id_col, self.groups = id_col, Trees.of(written(leaves, "merkle-leaves"), ["id", "node", "now", "row"])
        tops = self.groups.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("size"), F.col("root").alias("node"))
        self.top = Trees.of(tops, ["name"])

    def root(self) -> str | None:
        row = self.top.roots.first()
        return row.root if row else None

    def proofs(self) -> DataFrame:
        """Per row of docs: its id, leaf, `now` (the leaf as it is now), subroot, root, and its whole path."""
        root = self.root()
        tops = self.top.leaves.select("place", F.col("name").alias("tree"), F.col("node").alias("subroot"), F.col("size").alias("n"))
        further = self.top.proofs().select("place", F.col("path").alias("further"))
        tops = written(tops.join(further, "place", "left").drop("place"), "merkle-groups")
        none = F.array().cast(_PATH)
        rows = self.groups.leaves.select("tree", "place", "id", F.col("node").alias("leaf"), "now")
        rows = rows.join(self.groups.proofs(), ["tree", "place"], "left")
        total = self.groups.leaves.count()
        whole = join_groups(rows, tops, "tree", "n", total)
        path = F.concat(F.coalesce("path", none), F.coalesce("further", none))
        return whole.select(F.col("id").alias(self.id_col), "leaf", "now", "subroot", F.lit(root).cast("string").alias("root"), path.alias("path"))

    def verified(self) -> DataFrame:
        """Per row of docs: its id, leaf, subroot, root, proof_sha256 (of all its siblings), folded_root (of its columns as they are now) and verified."""
        out = self.proofs().select(self.id_col, "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("now"), F.col("path")).alias("folded_root"))
        return out.withColumn("verified", F.col("folded_root") == F.col("root"))
