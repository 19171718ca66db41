"""Flags, votes, metrics, ROC curves and what figures are drawn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.config import MODELS, PRETTY, VOTES
from pulsegrid.functions.columns import ratio
from pulsegrid.functions.quantiles import exact_quantiles, grouped_quantiles, range_of
from pulsegrid.operators.detectors import fit_components, value_ranks


def flag(score: Column, threshold: float | None) -> Column:
    """1 above the threshold; 0 without one, and for missing scores."""
    return F.lit(0) if threshold is None else F.coalesce((score > F.lit(threshold)).cast("int"), F.lit(0))


def with_votes(df: DataFrame, models: Sequence[str] = MODELS, votes: int = VOTES) -> DataFrame:
    """df with vote_count and flag_vote. The number of votes needed does not follow the number of models."""
    have = [F.col(f"flag_{m}") for m in models if f"flag_{m}" in df.columns]
    return df.withColumn("vote_count", sum(have, F.lit(0))).withColumn("flag_vote", (F.col("vote_count") >= votes).cast("int"))


def named(df: DataFrame, prefix: str, order: Sequence[str]) -> DataFrame:
    """df as it is if it has `file`; else with prefix_0, prefix_1, ... in the given order. Tables of an evaluation are small: one task numbers them."""
    if "file" in df.columns:
        return df
    return df.withColumn("file", F.concat(F.lit(f"{prefix}_"), F.row_number().over(Window.orderBy(*order)) - 1))


def pretty(feature: Column) -> Column:
    """What figures call a feature; a name without another one stays."""
    names = F.create_map(*[F.lit(x) for pair in PRETTY.items() for x in pair])
    return F.coalesce(F.element_at(names, feature), feature)


def fold_report(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Of left-out scores: mean, deviation and largest."""
    return folds.groupBy(*keys).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.max("score").alias("max"), F.count(F.lit(1)).alias("n"))


def fold_histogram(folds: DataFrame, threshold: float, bins: int = 25) -> DataFrame:
    """Left-out scores in `bins` bars of equal width (the last one closed) and the threshold that is drawn beside them."""
    lo, hi = folds.agg(F.min("score"), F.max("score")).first()
    width = (hi - lo) / bins if lo is not None and hi > lo else 1.0
    bar = F.least(F.floor((F.col("score") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = folds.where("score is not null").groupBy(bar.alias("bar")).agg(F.count(F.lit(1)).alias("n"))
    bars = folds.sparkSession.range(bins).select(F.col("id").cast("int").alias("bar"))
    start = F.lit(lo) + F.col("bar") * F.lit(width)
    return bars.join(F.broadcast(counts), "bar", "left").select("bar", start.alias("from"), (start + F.lit(width)).alias("to"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(threshold).alias("threshold"))


def correlation_triangle(pairs: DataFrame, boxed: float = 0.97) -> DataFrame:
    """Each pair of features once, by the names that figures use, and whether a box marks it."""
    return pairs.select(pretty(F.col("a")).alias("a"), pretty(F.col("b")).alias("b"), "r", F.coalesce(F.abs("r") > boxed, F.lit(False)).alias("boxed"))


def evaluated(normal: DataFrame, anomalous: DataFrame | None) -> DataFrame:
    out = normal.withColumn("label", F.lit("normal"))
    return out if anomalous is None else out.unionByName(anomalous.withColumn("label", F.lit("anomalous")))


def long_scores(df: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """file, label, model, score, flag."""
    packed = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"score_{m}").cast("double").alias("score"), F.col(f"flag_{m}").alias("flag")) for m in models if f"flag_{m}" in df.columns])
    return df.select("file", "label", F.explode(packed).alias("x")).select("file", "label", "x.*")


def metrics(flags: DataFrame, keys: Sequence[str] = ("model",), digits: int = 4) -> DataFrame:
    """Per model, of the rows' label and flag: counts, false positive rate, detection rate, precision, recall, F1."""
    anomalous, hit = F.col("label") == "anomalous", F.col("flag") == 1
    counted = flags.groupBy(*keys).agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("n_normal", ~anomalous), ("false_positives", ~anomalous & hit), ("n_anomalous", anomalous), ("tp", anomalous & hit))])
    tp, fp = F.col("tp"), F.col("false_positives")
    precision, recall = ratio(tp, tp + fp), ratio(tp, F.col("n_anomalous"))
    rates = counted.withColumns({"false_positive_rate": ratio(fp, F.col("n_normal")), "detection_rate": recall, "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)})
    return rates.withColumns({c: F.round(c, digits) for c in ("false_positive_rate", "detection_rate", "precision", "recall", "f1")})


def confusion(flags: DataFrame) -> DataFrame:
    return flags.groupBy("label", "flag").agg(F.count(F.lit(1)).alias("n"))


def roc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """A point for each distinct score, from the highest on: false and true positive rates. NaN and null scores count as 0.

    Cumulated over ranges of the score, so no task holds all scores.
    """
    clean = F.coalesce(F.when(~F.isnan(score), F.col(score)), F.lit(0.0))
    rows = df.select(clean.alias("score"), positive.cast("long").alias("hit"))
    counts = rows.groupBy("score").agg(F.sum("hit").alias("p"), F.sum(1 - F.col("hit")).alias("n"))
    dealt = counts.select("*", (-range_of(rows, "score")).alias("_part"))
    totals = dealt.groupBy("_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    before, everything = Window.orderBy("_part"), Window.partitionBy(F.lit(0))
    starts = totals.select("_part", *[(F.sum(c).over(before) - F.col(c)).alias(f"{c}0") for c in ("_p", "_n")], F.sum("_p").over(everything).alias("_P"), F.sum("_n").over(everything).alias("_N"))
    inside = Window.partitionBy("_part").orderBy(F.desc("score"))
    tp, fp = F.col("_p0") + F.sum("p").over(inside), F.col("_n0") + F.sum("n").over(inside)
    return dealt.join(starts, "_part").select("score", ratio(fp, F.col("_N")).alias("fpr"), ratio(tp, F.col("_P")).alias("tpr"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Mann-Whitney form with mean ranks for ties: one row, `auc`."""
    clean = F.coalesce(F.when(~F.isnan(score), F.col(score)), F.lit(0.0))
    rows = df.select(clean.alias("v"), positive.cast("long").alias("hit"))
    ranks = value_ranks(rows, "v").select("v", (F.col("up_to") - (F.col("n") - 1) / 2).alias("rank"))
    hits = rows.groupBy("v").agg(F.sum("hit").alias("p"), F.sum(1 - F.col("hit")).alias("q"))
    sums = hits.join(ranks, "v").agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("P"), F.sum("q").alias("N"))
    return sums.select(((F.col("r") - F.col("P") * (F.col("P") + 1) / 2) / (F.col("P") * F.col("N"))).alias("auc"))


def histogram(df: DataFrame, value: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, (F.floor(F.col(value) / F.lit(width)) * F.lit(width)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_plot(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Per group, of which there are few: least, quartiles, largest, rows. No task holds a group's values."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"))
    return with_quantiles(ends, df, keys, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).select(*keys, "lo", "q1", "q2", "q3", "hi", "n")


def with_quantiles(groups: DataFrame, df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """groups (a row for each key, few) with quantiles of df's `value` in columns of the given names."""
    found = grouped_quantiles(df, keys, [value], list(shares.values()))
    kind = T.StructType([*[T.StructField(f"_q{i}", df.schema[k].dataType) for i, k in enumerate(keys)], *[T.StructField(n, T.DoubleType()) for n in shares]])
    table = df.sparkSession.createDataFrame([(*g[1:], *q) for g, q in found.items()], kind)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_q{i}"))
    return groups.join(F.broadcast(table), same, "left").select(*groups.columns, *shares)


def detection_matrix(df: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """Anomalous rows by model, and the vote: what the heat map shows; clips by the last part of their name."""
    voted = with_votes(df, models).where("label = 'anomalous'")
    name = F.element_at(F.split(F.regexp_replace("file", r"\.[^.]*$", ""), "_"), -1)
    return voted.select(name.alias("clip"), *[F.col(f"flag_{m}").alias(m) for m in (*models, "vote")])


def pca_scatter(eval_rows: DataFrame, features: Sequence[str], flag_column: str) -> DataFrame:
    """Two principal coordinates fitted on the normal rows of the evaluation, and what each point is drawn as."""
    axes = fit_components(eval_rows.where("label = 'normal'"), features, 2)
    anomalous, hit = F.col("label") == "anomalous", F.col(flag_column) == 1
    kind = F.when(anomalous & hit, "detected").when(anomalous, "missed").when(hit, "false_positive").otherwise("normal")
    return eval_rows.select("file", "label", axes.projection(0).alias("pc1"), axes.projection(1).alias("pc2"), kind.alias("kind"))


def summary_table(results: DataFrame, models: Sequence[str] = MODELS, votes: int = VOTES) -> DataFrame:
    """Metrics of each model and of the vote, with the area under each model's curve."""
    have = [m for m in models if f"flag_{m}" in results.columns]
    voted = with_votes(results, have, votes).withColumn("score_vote", F.col("vote_count").cast("double"))
    rates = metrics(long_scores(voted, [*have, "vote"]))
    areas = None
    for m in have:
        one = auc(results, f"score_{m}", F.col("label") == "anomalous").withColumn("model", F.lit(m))
        areas = one if areas is None else areas.unionByName(one)
    return rates.join(areas, "model", "left") if areas is not None else rates


def patch_threshold(model: dict, normal: DataFrame, score: Column, share: float = 0.95) -> dict:
    """The model with a threshold at `share` of the normal scores, if it had none; otherwise as it is."""
    if model.get("threshold") is not None:
        return model
    return model | {"threshold": exact_quantiles(normal.select(score.alias("s")), ["s"], [share])["s"][0]}
