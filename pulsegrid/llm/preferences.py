"""Preference formatting of conversations, with DataFrame functions only.

The longest common turn prefix of a chosen and a rejected conversation is rendered once as the prompt;
what follows on either side is a completion with its mask: only what the assistant says is learned.

Turns are ordered by turn, then role and text; turns of equal number stay, each for itself. Null roles
and texts are empty. Conversations without an id, and pairs of which one side is missing, give no row.
Equal conversations are all prompt, with empty completions. An output row is as long as its two
conversations, and no longer group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before a turn's text, with the role in it, and after it.
BEFORE, BETWEEN, AFTER = "<|start|>", "\n", "<|end|>\n"
LEARNED = "assistant"


def paired(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) of the pairs (pair_id, chosen_id, rejected_id), with pair_id and is_chosen. A conversation may be in several pairs."""
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("chosen_id").alias("conv_id"), F.lit(True).alias("is_chosen")), F.struct(F.col("rejected_id").alias("conv_id"), F.lit(False).alias("is_chosen")))).alias("side"))
    return turns.join(sides.select("pair_id", "side.*"), "conv_id").select("pair_id", "is_chosen", "conv_id", "turn", "role", "text")


def _header(turn: Column) -> Column:
    return F.concat(F.lit(BEFORE), turn["role"], F.lit(BETWEEN))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(AFTER))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Runs of the rendered turns: length in characters and whether it is learned."""
    run = lambda text, learned: F.struct(F.length(text).alias("length"), learned.alias("learned"))
    return F.flatten(F.transform(turns, lambda t: F.array(run(_header(t), F.lit(False)), run(_body(t), t["role"] == LEARNED))))


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns: pair_id, is_chosen, conv_id, turn, role, text. Per pair: ids, n_prompt_turns, prompt, and of either side the completion and its mask."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda chosen: F.sort_array(F.collect_list(F.when(F.col("is_chosen") == chosen, turn)))
    both = turns.where("pair_id is not null").groupBy("pair_id").agg(F.min(F.when(F.col("is_chosen"), F.col("conv_id"))).alias("chosen_id"), F.min(F.when(~F.col("is_chosen"), F.col("conv_id"))).alias("rejected_id"), side(True).alias("c"), side(False).alias("r"))
    both = both.where((F.size("c") > 0) & (F.size("r") > 0))
    same = F.zip_with("c", "r", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x.isNotNull() & y.isNotNull())
    differs = F.array_position(same, False)
    both = both.withColumn("n", F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    both = both.select("pair_id", "chosen_id", "rejected_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return both.select("pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt_turns"), rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"), rendered(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"))


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs conversation 2 k (chosen) with 2 k + 1 (rejected)."""
    known = turns.where("conv_id is not null")
    return known.select(F.shiftright("conv_id", 1).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("is_chosen"), "conv_id", "turn", "role", "text")
