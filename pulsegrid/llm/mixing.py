"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Sources in code point order, null last, weigh WEIGHTS in turn and share SHARE times all words. No
source's target is above REPEATS times its size; what is over goes to the others by weight.

The words of a mix are dealt in equal blocks: each goes to the source with the highest quotient
target / (2 k + 1), k being the blocks it has, and that has not REPEATS times its own; a source's blocks
go to its shards in the same way. A shard's documents stand in seeded order, cut into blocks of equal
length. A quota of q out of n blocks takes each block q // n times, and once more the q % n that follow
a seeded place.

Shard and order hang on a hash of id and text, so neither partitioning nor repeated or missing ids
change a result; rows that agree in id, source and text are taken alike. Null texts have no words.
Sources without words, and empty tables, get none. Columns of docs may have any names but `_nth`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import WORD_PATTERN, join_groups, written

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Words of a shard, about, and shards of a source at most; the longest block, and blocks of the smallest source at least.
SHARD_WORDS, SHARDS, BLOCK_WORDS, BLOCKS = 100_000, 4096, 1024, 64
#: Rows (of about 100 bytes) of a table of sources or shards that may be broadcast; beyond that rows are shuffled to it.
FEW_GROUPS = 200_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def sainte_lague(parties: DataFrame, group: list[str], party: str, weight: str, seats: str, cap: str | None = None) -> DataFrame:
    """parties with `quota`: how many of their group's `seats` each gets, the highest quotients weight / (2 k + 1) first, then by `party`.

    No party gets more than its `cap`; what it would get goes to the next quotients. With q the exact share
    and d = parties / (2 seats), no party gets fewer than round(q (1 - d)) - 1 or (without caps) more than
    round(q (1 + d)) + 1 seats: rounding moves the sum by half a seat for each party at most. So only
    quotients between are ranked, about three for each party, and as many more as caps set free.
    """
    of = Window.partitionBy(*group)
    w = F.col(weight).cast("double")
    share = parties.withColumn("_q", F.when(F.sum(w).over(of) > 0, F.col(seats) * w / F.sum(w).over(of)).otherwise(0.0)).withColumn("_d", F.count(F.lit(1)).over(of) / (2 * F.greatest(F.col(seats), F.lit(1))))
    low = F.greatest(F.lit(0), F.floor(F.col("_q") * (1 - F.col("_d")) + 0.5) - 1).cast("long")
    high = (F.floor(F.col("_q") * (1 + F.col("_d")) + 0.5) + 1).cast("long")
    if cap is not None:
        share = share.withColumn("_free", F.sum(F.greatest(high + 1 - F.col(cap), F.lit(0))).over(of))
        low, high = F.least(low, F.col(cap)), F.least(high + F.col("_free"), F.col(cap) - 1)
    share = share.withColumns({"_low": low, "_high": high}).withColumn("_first", F.sum("_low").over(of))
    tried = share.where((w > 0) & (F.col("_high") >= F.col("_low"))).select(*group, party, seats, "_first", F.explode(F.sequence("_low", "_high")).alias("_k"), w.alias("_w"))
    rank = F.row_number().over(of.orderBy((F.col("_w") / (2 * F.col("_k") + 1)).desc(), F.col(party), "_k"))
    won = tried.withColumn("_won", rank + F.col("_first") <= F.col(seats)).groupBy(*group, party).agg(F.sum(F.col("_won").cast("long")).alias("_won"))
    return share.join(won, [*group, party], "left").select(*parties.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sources (source, source_size, n_docs) with their order `nth` and `target`.

    Sources that stop at their cap are those with the least cap for their weight. In that order, once
    the caps of the first k are taken, each of the rest gets `level` times its weight; the first k
    whose next source can take that are the ones that stop. One task has a row for each source.
    """
    everything = Window.partitionBy("_all")
    nth = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    named = sources.withColumn("_all", F.lit(1)).withColumn("nth", nth).withColumn("_w", weight).withColumn("_cap", repeats * F.col("source_size").cast("double"))
    upward = everything.orderBy(F.col("_cap") / F.col("_w"), "nth")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    ranked = named.withColumn("_level", level)
    ranked = ranked.withColumn("_rank", F.row_number().over(upward)).withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    first = F.min(F.when(F.col("_fits"), F.struct("_rank", "_level"))).over(everything)
    ranked = ranked.withColumn("_first", first)
    target = F.when(F.col("_first").isNull() | (F.col("_rank") < F.col("_first._rank")), F.col("_cap")).otherwise(F.col("_first._level") * F.col("_w"))
    return ranked.select("nth", "source", "source_size", "n_docs", target.alias("target"), "_all")


def _facts(id_: Column, source: Column, text: Column, seed: int) -> dict[str, Column]:
    """What the mix hangs on. A null source and an empty one are told apart by the first letter, ids likewise."""
    name = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    size, own = n_words(text), F.xxhash64(F.coalesce(text, F.lit("")), F.lit(seed))
    place = F.concat_ws(":", hexed(F.xxhash64(name(id_), own, size, F.lit(seed + 1))), hexed(own), name(id_))
    return {"_of": name(source), "_size": size, "_place": place}


@dataclass
class Mix:
    """What a mix takes: sources (a row each) and edges (a row for each shard: how often it is taken, and between which places once more)."""

    sources: DataFrame
    edges: DataFrame
    seed: int

    @classmethod
    def of(cls, rows: DataFrame, seed: int = 1) -> Mix:
        """rows: _of, _size, _place. Rows that agree in all three are taken alike."""
        sources = targets(rows.groupBy(F.col("_of").alias("source")).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
        everything = Window.partitionBy("_all")
        block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(everything) / BLOCKS))).cast("long")
        shards = F.greatest(F.lit(1), F.least(F.lit(SHARDS), F.ceil(F.col("source_size") / SHARD_WORDS))).cast("int")
        sources = written(sources.select("_all", "nth", F.col("source").alias("_of"), "source_size", "n_docs", "target", F.coalesce(block, F.lit(1)).alias("block"), shards.alias("shards")), "mix-sources")
        self = cls(sources, sources, seed)
        placed = self.sharded(rows.where("_size > 0")).groupBy("nth", "shard", "block", "_place", "_size").agg(F.count(F.lit(1)).alias("m"))
        placed = written(placed.withColumn("words", F.col("m") * F.col("_size")), "mix-places")
        dealt = placed.groupBy("nth", "shard").agg(F.sum("words").alias("words"), F.first("block").alias("block"))
        dealt = dealt.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / F.col("block"))).cast("long"))
        # apportionment reads its parties twice: written, each is a plan of its own and none stands in another's several times
        dealt = written(dealt, "mix-shards")
        # a source's weight and cap are in its own blocks, whose length is nearly that of all
        own = sources.join(dealt.groupBy("nth").agg(F.sum("blocks").alias("own")), "nth").withColumns({"wanted": F.col("target") * F.col("own") / F.col("source_size"), "most": REPEATS * F.col("own")})
        given = sainte_lague(own.withColumn("seats", F.round(F.sum("wanted").over(everything)).cast("long")), ["_all"], "nth", "wanted", "seats", "most")
        given = written(given.select("nth", F.col("quota").alias("given")), "mix-given")
        # by their blocks, of which a source gets REPEATS times all at most, no shard gets more than that of its own
        dealt = sainte_lague(dealt.join(given, "nth"), ["nth"], "shard", "blocks", "given")
        dealt = dealt.withColumn("more", F.col("quota") % F.col("blocks")).withColumn("start", F.pmod(F.xxhash64("nth", "shard", F.lit(seed)), F.col("blocks")))
        edge = lambda c: F.floor(c * F.col("words") / F.col("blocks")).cast("long")  # noqa: E731  words before block c
        last = F.col("start") + F.col("more")
        dealt = dealt.select("nth", "shard", F.expr("quota div blocks").alias("times"), edge(F.col("start")).alias("a"), edge(F.least(last, F.col("blocks"))).alias("b"), edge(F.greatest(last - F.col("blocks"), F.lit(0))).alias("c"))
        inside = Window.partitionBy("nth", "shard").orderBy("_place", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        along = placed.join(dealt, ["nth", "shard"]).withColumn("end", F.sum("words").over(inside)).withColumn("begin", F.col("end") - F.col("words"))
        common = lambda lo, hi: F.greatest(F.least(F.col("end"), hi) - F.greatest(F.col("begin"), lo), F.lit(0))
        extra = common(F.col("a"), F.col("b")) + common(F.lit(0), F.col("c"))
        after, before = (F.col("begin") >= F.col("a")) & (F.col("end") <= F.col("b")), F.col("end") <= F.col("c")
        cut = F.when(~after & ~before & (extra > 0), F.struct("_place", F.floor(extra / F.col("m") + 0.5).cast("long").alias("words")))
        # an edge cuts one place: three of a shard at most
        edges = along.groupBy("nth", "shard").agg(F.first("times").alias("times"), F.min(F.when(after, F.col("_place"))).alias("lo"), F.max(F.when(after, F.col("_place"))).alias("hi"), F.max(F.when(before, F.col("_place"))).alias("to"), F.collect_list(cut).alias("cuts"))
        self.edges = written(edges, "mix-edges")
        return self

    def sharded(self, rows: DataFrame) -> DataFrame:
        """rows with their source's columns and `shard`. Where sources are many, the rows of small ones are shuffled by source."""
        groups = self.sources.drop("_all")
        if groups.count() <= FEW_GROUPS:
            out = rows.join(F.broadcast(groups), "_of")
        else:
            out = join_groups(rows, groups, "_of", "n_docs", groups.agg(F.sum("n_docs")).first()[0])
        return out.withColumn("shard", F.pmod(F.xxhash64("_place", F.lit(self.seed)), F.col("shards")).cast("int"))

    def taken(self, rows: DataFrame) -> DataFrame:
        """rows (with _of, _size, _place) with source_size, target and taken: nothing is shuffled where sources and shards are few."""
        edges = self.edges
        out = self.sharded(rows).join(F.broadcast(edges) if edges.count() <= FEW_GROUPS else edges, ["nth", "shard"], "left")
        cut = F.get(F.filter("cuts", lambda c: c["_place"] == F.col("_place")), F.lit(0))["words"]
        whole = F.col("_place").between(F.col("lo"), F.col("hi")) | (F.col("_place") <= F.col("to"))
        extra = F.coalesce(cut, F.when(whole, F.col("_size")), F.lit(0))
        return out.withColumn("taken", F.when(F.col("_size") > 0, F.coalesce("times", F.lit(0)) * F.col("_size") + extra).otherwise(F.lit(0)).cast("long"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """Per row of docs: its id, size, source_size, target and taken (words, repeats counted)."""
    facts = _facts(F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), F.col(f"`{text_col}`"), seed)
    rows = written(docs.select(F.col(f"`{id_col}`").alias("_id"), *[c.alias(k) for k, c in facts.items()]), "mix-sizes")
    return Mix.of(rows, seed).taken(rows).select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "taken")


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """docs' rows, each as often as the words taken from it fill it (halves rounded up), with docs' own columns. Texts stay where they are read."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.withColumns(_facts(F.col("doc")[id_col], F.col("doc")[source_col], F.col("doc")[text_col], seed))
    mix = Mix.of(written(rows.drop("doc"), "mix-sizes"), seed)
    times = F.floor(F.col("taken") / F.col("_size") + 0.5).cast("int")
    again = mix.taken(rows).where("taken > 0").withColumn("_nth", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    return again.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
