"""The queries over the driver's tables: `user_id` plays the machine, `value` its signal or duration, `embedding` a feature vector or a signal of 64 samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.config import Sessions
from pulsegrid.functions.columns import clipped, cv, scaled, seconds
from pulsegrid.operators import detectors, evaluation, extract, neighbours, prep, schedule, selection, signals
from pulsegrid.streaming import live, monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS, ORDER = ["user_id"], ["ts", "event_id"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def vectors(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """vec_id, label and the first n places of the embedding as columns x0, x1, ..."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(n)])


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("machine"), F.col("event_id").alias("id"), "ts", F.col("value").alias("duration"))


@query("""SELECT o_orderkey, o_custkey, c_name, c_custkey IS NULL AS missed FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def q01_lookup_join(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", "c_name", F.col("c_custkey").isNull().alias("missed"))


@query("""SELECT user_id, round(stddev_pop(value) / (avg(value) + 1e-9), 6) AS motion_cv, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY user_id""")
def q02_variation(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(r6(cv(v)).alias("motion_cv"), r6(F.avg(v)).alias("mean"), r6(F.stddev_pop(v)).alias("std"))


@query("""WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem GROUP BY 1)
SELECT l_returnflag, count(*) AS n, round(avg(least(greatest(l_extendedprice, lo), hi)), 4) AS mean_clipped, round(min(lo), 4) AS lo, round(min(hi), 4) AS hi FROM lineitem JOIN b USING (l_returnflag) GROUP BY 1""")
def q03_clip(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    bounds = evaluation.with_quantiles(items.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows")), items, ["l_returnflag"], "l_extendedprice", {"lo": 0.01, "hi": 0.99}).drop("rows")
    within = clipped(F.col("l_extendedprice"), F.col("lo"), F.col("hi"))
    return items.join(F.broadcast(bounds), "l_returnflag").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(within), 4).alias("mean_clipped"), F.round(F.min("lo"), 4).alias("lo"), F.round(F.min("hi"), 4).alias("hi"))


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM lineitem" for c in (*MEASURES, "zero")).replace("zero::DOUBLE", "0.0::DOUBLE")


@query(f"""SELECT feature, round(stddev_samp(value), 4) AS std, stddev_samp(value) = 0 AS dropped FROM ({_LONG}) GROUP BY feature""")
def q04_zero_variance(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("zero", F.lit(0.0))
    return prep.zero_variance(items, [*MEASURES, "zero"]).select("feature", F.round("std", 4).alias("std"), "dropped")


@query(f"""WITH c AS (SELECT feature, value, count(*) AS n FROM ({_LONG}) GROUP BY 1, 2)
SELECT feature, round(max(n) / sum(n), 6) AS top_share, max(n) / sum(n) > 0.95 AS dropped FROM c GROUP BY 1""")
def q05_near_constant(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("zero", F.lit(0.0))
    return prep.near_constant(items, [*MEASURES, "zero"]).select("feature", r6("top_share").alias("top_share"), "dropped")


@query("""WITH b AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events),
c AS (SELECT event_id, least(greatest(value, lo), hi) AS v FROM events, b), b2 AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM c),
d AS (SELECT event_id, least(greatest(v, lo), hi) AS v FROM c, b2), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS z FROM d)
SELECT event_id, round((v - m) / CASE WHEN z = a THEN 1 ELSE z - a END, 6) AS scaled FROM d, q""")
def q06_robust_scale(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    once = prep.clip(events, prep.fit_bounds(events, ["value"]))
    return prep.transform(once, prep.fit(once, ["value"])).select("event_id", r6("value").alias("scaled"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]))
def q07_correlation(spark, sf_dir):
    return selection.correlations(table(spark, sf_dir, "lineitem"), MEASURES).select("a", "b", r6("r").alias("r"))


_IMPORTANCE = " UNION ALL ".join(f"SELECT '{c}' AS feature, stddev_pop({c}) / (avg({c}) + 1e-9) AS importance FROM lineitem" for c in MEASURES)
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :])


def _importance(items: DataFrame) -> DataFrame:
    return prep.long_form(items.agg(*[cv(F.col(c)).alias(c) for c in MEASURES]), [], MEASURES, value="importance")


@query(f"""WITH i AS ({_IMPORTANCE}), p AS ({_PAIRS})
SELECT DISTINCT CASE WHEN x.importance >= y.importance THEN p.b ELSE p.a END AS feature FROM p JOIN i x ON x.feature = p.a JOIN i y ON y.feature = p.b WHERE abs(r) >= 0.001""")
def q08_correlated_losers(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return selection.correlated_losers(selection.correlations(items, MEASURES), _importance(items), keep=(), least=0.001)


@query(f"""WITH i AS ({_IMPORTANCE}) SELECT feature, round(importance, 6) AS importance, row_number() OVER (ORDER BY importance DESC, feature) AS place FROM i QUALIFY place <= 3""")
def q09_selection(spark, sf_dir):
    return selection.selected(_importance(table(spark, sf_dir, "lineitem")), keep=3).select("feature", r6("importance").alias("importance"), "place")


@query("""WITH s AS (SELECT event_id, value AS a, -ln(value + 1) AS b FROM events), m AS (SELECT min(a) al, max(a) ah, min(b) bl, max(b) bh FROM s)
SELECT event_id, round(((a - al) / (ah - al) + (b - bl) / (bh - bl)) / 2, 6) AS score FROM s, m""")
def q10_ensemble(spark, sf_dir):
    scores = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("a"), (-F.log(F.col("value") + 1)).alias("b"))
    return selection.ensemble_score(scores, ["a", "b"]).select("event_id", r6("score").alias("score"))


@query("""WITH s AS (SELECT user_id, value, coalesce(lag(value) OVER w, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS moved
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(avg(abs(value - moved)), 6) AS importance FROM s GROUP BY 1""")
def q11_shift_importance(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    moved = events.withColumn("before", F.lag("value").over(w)).join(last, "user_id").withColumn("moved", F.coalesce("before", "last"))
    return moved.groupBy("user_id").agg(r6(F.avg(F.abs(F.col("value") - F.col("moved")))).alias("importance"))


@query("""WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
m AS (SELECT avg(x) mx, avg(y) my, var_samp(x) + 1e-6 a, var_samp(y) + 1e-6 c, covar_samp(x, y) b FROM e WHERE label = 0)
SELECT vec_id, round(sqrt((c * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * c - b * b)), 6) AS score FROM e, m""")
def q12_mahalanobis(spark, sf_dir):
    v = vectors(spark, sf_dir, 2)
    return v.select("vec_id", r6(detectors.fit_mahalanobis(v.where("label = 0"), ["x0", "x1"]).column()).alias("score"))


@query("""WITH e AS (SELECT vec_id, label, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE, embedding[4]::DOUBLE] AS v FROM embeddings), r AS (SELECT * FROM e WHERE label = 0),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS k FROM r a JOIN r b ON a.vec_id <> b.vec_id),
n AS (SELECT * FROM d WHERE k <= 20), kd AS (SELECT a, max(d) AS kdist FROM n GROUP BY a), den AS (SELECT n.a, 1 / (avg(greatest(kdist, d)) + 1e-10) AS lrd FROM n JOIN kd ON kd.a = n.b GROUP BY n.a),
q AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS k FROM e a, r b)
SELECT q.a AS vec_id, round(avg(den.lrd) * (avg(greatest(kd.kdist, q.d)) + 1e-10), 6) AS score FROM q JOIN kd ON kd.a = q.b JOIN den ON den.a = q.b WHERE q.k <= 20 GROUP BY q.a""")
def q13_local_outlier_factor(spark, sf_dir):
    features = [f"x{i}" for i in range(4)]
    factors = neighbours.local_outlier_factors(vectors(spark, sf_dir, 4), features, "vec_id", F.col("label") == 0)
    return factors.select("vec_id", r6("score").alias("score"))


@query("""SELECT event_id, round(coalesce(abs(value - lag(value) OVER w), 0), 6) AS change, coalesce(abs(value - lag(value) OVER w), 0) > 15 AS active FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q14_changes(spark, sf_dir):
    out = signals.changes(table(spark, sf_dir, "events"), KEYS, ORDER)
    return out.select("event_id", r6("change").alias("change"), (F.col("change") > 15).alias("active"))


@query("""WITH f AS (SELECT event_id, (value > 60)::INT a, (value > 80)::INT b, (event_type = 'error')::INT c, (value < 2)::INT d, (hour(ts) < 6)::INT e FROM events)
SELECT event_id, a + b + c + d + e AS vote_count, (a + b + c + d + e >= 3)::INT AS flag_vote FROM f""")
def q15_votes(spark, sf_dir):
    rules = {"a": F.col("value") > 60, "b": F.col("value") > 80, "c": F.col("event_type") == "error", "d": F.col("value") < 2, "e": F.hour("ts") < 6}
    flags = table(spark, sf_dir, "events").select("event_id", *[c.cast("int").alias(f"flag_{k}") for k, c in rules.items()])
    return evaluation.with_votes(flags, list(rules)).select("event_id", F.col("vote_count").alias("vote_count"), "flag_vote")


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1) AS n_normal, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS false_positives, count(*) FILTER (WHERE quality = 0) AS n_anomalous, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tp FROM labels),
r AS (SELECT *, CASE WHEN tp + false_positives > 0 THEN tp / (tp + false_positives) ELSE 0 END AS p, CASE WHEN n_anomalous > 0 THEN tp / n_anomalous ELSE 0 END AS r FROM c)
SELECT 'toxic' AS model, n_normal, false_positives, n_anomalous, tp, round(CASE WHEN n_normal > 0 THEN false_positives / n_normal ELSE 0 END, 4) AS false_positive_rate, round(r, 4) AS detection_rate, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM r""")
def q16_metrics(spark, sf_dir):
    flags = table(spark, sf_dir, "labels").select(F.lit("toxic").alias("model"), F.when(F.col("quality") == 0, "anomalous").otherwise("normal").alias("label"), F.col("toxic").alias("flag"))
    return evaluation.metrics(flags)


_LAG3 = "SELECT user_id, value, lead(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ahead FROM events"


@query(f"""SELECT user_id, round(corr(value, ahead), 6) AS autocorr, count(*) AS n FROM ({_LAG3}) WHERE ahead IS NOT NULL GROUP BY 1""")
def q17_autocorrelation(spark, sf_dir):
    return signals.regularity(table(spark, sf_dir, "events"), KEYS, ORDER, 3).select("user_id", r6("autocorr").alias("autocorr"), "n")


@query("""WITH a AS (SELECT *, row_number() OVER w - 1 AS i, lag(value) OVER w AS p, lead(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, value > p AND value > n AS peak, CASE WHEN value < p AND value < n THEN i END AS vi, CASE WHEN value < p AND value < n THEN value END AS vv FROM a),
z AS (SELECT *, last_value(vi IGNORE NULLS) OVER b AS bi, last_value(vv IGNORE NULLS) OVER b AS bv, first_value(vi IGNORE NULLS) OVER f AS ai, first_value(vv IGNORE NULLS) OVER f AS av FROM m
 WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
t AS (SELECT *, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS gap, CASE WHEN bv IS NOT NULL AND av IS NOT NULL THEN value - least(bv, av) END AS h FROM z WHERE peak)
SELECT user_id, count(*) AS peaks, round(coalesce(stddev_pop(gap) / (avg(gap) + 1e-9), 0), 6) AS interval_cv, round(coalesce(stddev_pop(h) / (avg(h) + 1e-9), 0), 6) AS stroke_amp_cv, round(coalesce(avg(i - bi) / (avg(ai - i) + 1e-9), 0), 6) AS rise_fall_ratio,
 round(coalesce(stddev_pop(i - bi) / (avg(i - bi) + 1e-9), 0), 6) AS rise_time_cv, round(coalesce(stddev_pop(ai - i) / (avg(ai - i) + 1e-9), 0), 6) AS fall_time_cv FROM t GROUP BY 1""")
def q18_strokes(spark, sf_dir):
    out = signals.strokes(table(spark, sf_dir, "events"), KEYS, ORDER)
    return out.select("user_id", "peaks", *[r6(c).alias(c) for c in out.columns[2:]])


@query(f"""WITH m AS (SELECT user_id, var_samp(value) a, covar_samp(value, ahead) b, var_samp(ahead) c FROM ({_LAG3}) WHERE ahead IS NOT NULL GROUP BY 1)
SELECT user_id, round(sqrt(1 - ((a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)) / ((a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) + 1e-9)), 6) AS eccentricity FROM m""")
def q19_eccentricity(spark, sf_dir):
    return signals.regularity(table(spark, sf_dir, "events"), KEYS, ORDER, 3).select("user_id", r6("eccentricity").alias("eccentricity"))


@query("""WITH c AS (SELECT user_id, hour(ts) AS cell, var_pop(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT user_id, avg(v) AS m FROM c GROUP BY 1)
SELECT user_id, round(avg((v > m * 0.5)::INT), 6) AS active_fraction, count(*) AS cells FROM c JOIN m USING (user_id) GROUP BY 1""")
def q20_variance_mask(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("cell", F.hour("ts"))
    return signals.variance_mask(events, "user_id", "cell", "value").select("user_id", r6("active_fraction").alias("active_fraction"), "cells")


@query("""WITH a AS (SELECT user_id, value > 20 AS on_, row_number() OVER w - 1 AS i, sum((value <= 20)::INT) OVER w AS island FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY i) AS k FROM a WHERE on_)
SELECT * FROM (SELECT user_id, min(i) FILTER (WHERE k = 5) - 4 AS "start", max(i) AS "end" FROM r GROUP BY 1) WHERE "start" IS NOT NULL AND "end" > "start" """)
def q21_first_run(spark, sf_dir):
    return signals.first_run(table(spark, sf_dir, "events"), KEYS, ORDER, F.col("value") > 20, 5)


_DAYS = "c AS (SELECT user_id, ts::DATE AS date, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT user_id, floor(median(n))::INT AS per_day FROM c GROUP BY 1), d AS (SELECT user_id, date, per_day FROM c JOIN u USING (user_id) WHERE n >= per_day)"


@query(f"""WITH {_DAYS} SELECT event_id, per_day FROM events e JOIN d ON d.user_id = e.user_id AND d.date = e.ts::DATE""")
def q22_complete_days(spark, sf_dir):
    return schedule.complete_days(schedule.dated(activations(spark, sf_dir))).select(F.col("id").alias("event_id"), "per_day")


@query(f"""WITH {_DAYS}, x AS (SELECT e.user_id, hour(ts) + minute(ts) / 60 + floor(second(ts)) / 3600 AS h, per_day, row_number() OVER (PARTITION BY e.user_id, e.ts::DATE ORDER BY ts, event_id) - 1 AS slot FROM events e JOIN d ON d.user_id = e.user_id AND d.date = e.ts::DATE)
SELECT user_id, slot, round(round(avg(h), 6), 4) AS hour, round(stddev_pop(h), 4) AS spread, count(*) AS days FROM x WHERE slot < per_day GROUP BY 1, 2""")
def q23_slots(spark, sf_dir):
    full = schedule.complete_days(schedule.dated(activations(spark, sf_dir))).withColumnRenamed("machine", "user_id").withColumn("machine", F.col("user_id"))
    return schedule.slots(full).select(F.col("machine").alias("user_id"), "slot", F.round("hour", 4).alias("hour"), F.round("spread", 4).alias("spread"), "days")


@query(f"""WITH {_DAYS}, x AS (SELECT e.user_id, event_id, ts, d.date FROM events e JOIN d ON d.user_id = e.user_id AND d.date = e.ts::DATE),
s AS (SELECT *, lag(ts) OVER w AS b, lag(date) OVER w AS bd FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT * FROM s WHERE date = bd),
r AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rb FROM k)
SELECT user_id, round(avg(epoch_us(ts) / 1e6 - epoch_us(b) / 1e6), 3) AS intra_day_mean, count(*) AS n_intra, round(avg(epoch_us(ts) / 1e6 - epoch_us(rb) / 1e6) FILTER (WHERE rb IS NOT NULL), 3) AS reference_mean, count(rb) AS n_reference FROM r GROUP BY 1""")
def q24_intervals(spark, sf_dir):
    full = schedule.complete_days(schedule.dated(activations(spark, sf_dir)))
    own, other = (schedule.intervals(full, m).groupBy(F.col("machine").alias("user_id")).agg(F.round(F.avg("interval_s"), 3).alias(f"{m}_mean"), F.count(F.lit(1)).alias(f"n_{n}")) for m, n in (("intra_day", "intra"), ("reference", "reference")))
    return own.join(other, "user_id", "left").fillna(0, ["n_reference"])


@query(f"""WITH {_DAYS}, x AS (SELECT e.user_id, event_id, ts, value, d.date, per_day, hour(ts) + minute(ts) / 60 + floor(second(ts)) / 3600 AS h, row_number() OVER (PARTITION BY e.user_id, d.date ORDER BY ts, event_id) - 1 AS slot,
 lag(ts) OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS b, lag(d.date) OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS bd FROM events e JOIN d ON d.user_id = e.user_id AND d.date = e.ts::DATE),
g AS (SELECT user_id, round(avg(epoch_us(ts) / 1e6 - epoch_us(b) / 1e6), 3) AS im, round(stddev_samp(epoch_us(ts) / 1e6 - epoch_us(b) / 1e6), 3) AS isd FROM x WHERE date = bd GROUP BY 1),
v AS (SELECT user_id, round(avg(value), 3) AS dm, round(stddev_samp(value), 3) AS ds FROM x GROUP BY 1), s AS (SELECT user_id, slot, round(avg(h), 6) AS sh FROM x WHERE slot < per_day GROUP BY 1, 2),
e AS (SELECT *, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) - 1 AS slot, hour(ts) + minute(ts) / 60 + floor(second(ts)) / 3600 AS h FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN abs(gap - im) > 3 * isd THEN CASE WHEN gap > im THEN 'missed_cycle' ELSE 'extra_cycle' END END, CASE WHEN abs(value - dm) > 3 * ds THEN 'wrong_duration' END, CASE WHEN abs(h - sh) > 0.5 THEN 'wrong_time' END], lambda t: t IS NOT NULL), ',') AS anomalies
FROM e LEFT JOIN g USING (user_id) LEFT JOIN v USING (user_id) LEFT JOIN s USING (user_id, slot)""")
def q25_schedule_check(spark, sf_dir):
    runs = activations(spark, sf_dir)
    return schedule.check(runs, schedule.fit(runs, "intra_day")).select(F.col("id").alias("event_id"), F.array_join("anomalies", ",").alias("anomalies"))


@query("""WITH s AS (SELECT user_id, list(CASE WHEN value > 30 THEN 1 ELSE -1 END ORDER BY ts, event_id) AS steps, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY 1),
r AS (SELECT user_id, ids, list_transform(range(1, len(steps) + 1), lambda n: list_reduce(steps[1:n], lambda a, x: least(greatest(a + x, 0), 5), 0)) AS levels FROM s)
SELECT unnest(ids) AS event_id, unnest(levels) AS level FROM r""")
def q26_hysteresis(spark, sf_dir):
    return signals.hysteresis(table(spark, sf_dir, "events"), KEYS, ORDER, F.col("value") > 30).select("event_id", "level")


@query("""WITH a AS (SELECT *, epoch_us(ts) / 1e6 AS t, coalesce((epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER w) / 1e6 > 14400)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM a), c AS (SELECT *, floor((t - min(t) OVER (PARTITION BY user_id, session)) / 21600) AS piece FROM b)
SELECT user_id, session::BIGINT AS session, piece::BIGINT AS piece, count(*) AS n, round(max(t) - min(t), 3) AS length_s FROM c GROUP BY 1, 2, 3""")
def q27_sessions(spark, sf_dir):
    out = signals.sessions(table(spark, sf_dir, "events"), KEYS, ORDER, 4 * 3600, 6 * 3600)
    return out.select("user_id", "session", "piece", "n", F.round(seconds(F.col("end")) - seconds(F.col("start")), 3).alias("length_s"))


@query("""WITH e AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings), c AS (SELECT vec_id, [x - list_avg(v) for x in v] AS v FROM e),
p AS (SELECT vec_id, k * 30.0 / 64 AS f, power(list_sum([v[j + 1] * cos(6.283185307179586 * k * j / 64) for j in range(64)]), 2) + power(list_sum([v[j + 1] * sin(6.283185307179586 * k * j / 64) for j in range(64)]), 2) AS p FROM c, range(33) t(k) WHERE k * 30.0 / 64 BETWEEN 1 AND 20),
s AS (SELECT *, p / (sum(p) OVER (PARTITION BY vec_id) + 1e-9) AS q FROM p)
SELECT vec_id, round(sum(p), 6) AS band_power, arg_max(f, p)::DOUBLE AS top_hz, round(sum(-q * ln(q + 1e-12)), 6) AS entropy FROM s GROUP BY 1""")
def q28_spectrum(spark, sf_dir):
    spectra = signals.spectrum(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 30.0, 1.0, 20.0)
    return signals.band_summary(spectra, "vec_id").select("vec_id", r6("band_power").alias("band_power"), "top_hz", r6("entropy").alias("entropy"))


@query("""WITH s AS (SELECT embedding[1]::DOUBLE AS v, label = 0 AS hit FROM embeddings), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS k FROM s)
SELECT round((sum(k) FILTER (WHERE hit) - count(*) FILTER (WHERE hit) * (count(*) FILTER (WHERE hit) + 1) / 2) / (count(*) FILTER (WHERE hit) * count(*) FILTER (WHERE NOT hit)), 6) AS auc FROM r""")
def q29_auc(spark, sf_dir):
    return evaluation.auc(vectors(spark, sf_dir, 1), "x0", F.col("label") == 0).select(r6("auc").alias("auc"))


@query("""WITH s AS (SELECT embedding[1]::DOUBLE AS score, label = 0 AS hit FROM embeddings), g AS (SELECT score, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE NOT hit) AS n FROM s GROUP BY 1)
SELECT score, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr FROM g WINDOW w AS (ORDER BY score DESC)""")
def q29_roc(spark, sf_dir):
    return evaluation.roc(vectors(spark, sf_dir, 1), "x0", F.col("label") == 0).select("score", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("""SELECT event_type, floor(value / 10) * 10 AS bin, count(*) AS n FROM events GROUP BY 1, 2""")
def q30_histogram(spark, sf_dir):
    return evaluation.histogram(table(spark, sf_dir, "events"), "value", 10.0, ["event_type"])


@query("""SELECT event_type, min(value) AS lo, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS hi, count(*) AS n FROM events GROUP BY 1""")
def q31_box_plot(spark, sf_dir):
    out = evaluation.box_plot(table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", "lo", *[r6(c).alias(c) for c in ("q1", "q2", "q3")], "hi", "n")


@query("""SELECT event_type, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, count(*) AS n FROM events GROUP BY 1, 2""")
def q32_rates(spark, sf_dir):
    return signals.rates(table(spark, sf_dir, "events"), ["event_type"], "ts", "1 hour").select("event_type", seconds(F.col("start")).cast("long").alias("start_s"), "n")


@query("""WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT avg(x) mx, avg(y) my, var_samp(x) a, var_samp(y) c, covar_samp(x, y) b FROM e WHERE label = 0),
l AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1 FROM m), v AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS vx, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS vy FROM l)
SELECT vec_id, round(greatest((x - mx) * (x - mx) + (y - my) * (y - my) - ((x - mx) * vx + (y - my) * vy) * ((x - mx) * vx + (y - my) * vy), 0), 6) AS error FROM e, v""")
def q33_pca_error(spark, sf_dir):
    v = vectors(spark, sf_dir, 2)
    return v.select("vec_id", r6(detectors.fit_components(v.where("label = 0"), ["x0", "x1"], 1).column()).alias("error"))


_ECOD_L = ", ".join(f"-ln(cume_dist() OVER (ORDER BY x{i})) AS l{i}, -ln(cume_dist() OVER (ORDER BY x{i} DESC)) AS r{i}" for i in range(4))
_ECOD_S = ", ".join(f"(avg(x{i} * x{i} * x{i}) - 3 * avg(x{i}) * avg(x{i} * x{i}) + 2 * power(avg(x{i}), 3)) AS s{i}" for i in range(4))
_ECOD_A = " + ".join(f"CASE WHEN s{i} < 0 THEN l{i} ELSE r{i} END" for i in range(4))


@query(f"""WITH e AS (SELECT vec_id, {", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(4))} FROM embeddings), t AS (SELECT vec_id, {_ECOD_L} FROM e), s AS (SELECT {_ECOD_S} FROM e)
SELECT vec_id, round(greatest(l0 + l1 + l2 + l3, r0 + r1 + r2 + r3, {_ECOD_A}), 6) AS score FROM t, s""")
def q34_ecod(spark, sf_dir):
    return detectors.ecod(vectors(spark, sf_dir, 4), [f"x{i}" for i in range(4)], "vec_id").select("vec_id", r6("score").alias("score"))


@query("""WITH e AS (SELECT embedding[1]::DOUBLE AS x FROM embeddings WHERE label = 0), m AS (SELECT count(*) n, sum(x) s, sum(x * x) q FROM e),
l AS (SELECT x, (s - x) / (n - 1) AS mean, ((q - x * x) - (s - x) * (s - x) / (n - 1)) / (n - 2) AS var FROM e, m)
SELECT round(quantile_cont(sqrt((x - mean) * (x - mean) / (var + 1e-6)), 0.99), 6) AS threshold FROM l""")
def q35_loo_threshold(spark, sf_dir):
    threshold, _ = detectors.leave_one_out(vectors(spark, sf_dir, 1).where("label = 0"), ["x0"], "mahalanobis")
    return spark.range(1).select(r6(F.lit(threshold)).alias("threshold"))


@query()
def q36_sampled_detectors(spark, sf_dir):
    """Scores of isolation forest, one-class SVM and robust covariance, fitted on the (sampled) rows of label 0, for all rows."""
    features = [f"x{i}" for i in range(8)]
    v = vectors(spark, sf_dir, 8)
    own = v.where("label = 0")
    forest = spark.sparkContext.broadcast(detectors.fit_forest(own, features))
    svm = spark.sparkContext.broadcast(detectors.OneClassSvm.of(detectors.sampled(own, features, 2000)))
    robust = detectors.fit_robust(own, features)
    out = detectors.scored(detectors.scored(v, features, lambda x: forest.value.score(x), "isoforest"), features, lambda x: svm.value.score(x), "ocsvm")
    return out.select("vec_id", r6("isoforest").alias("isoforest"), r6("ocsvm").alias("ocsvm"), r6(robust.column()).alias("elliptic_envelope"))


@query()
def q37_signal_features(spark, sf_dir):
    """Welch, envelope and cycle features of the embeddings as signals of 64 samples."""
    out = extract.extract_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", *[r6(c).alias(c) for c in out.columns[1:]])


_FRAMES = """f AS (
    SELECT user_id, ts, epoch_us(ts) / 1e6 AS t, value > 20 AS moved,
           row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, value > 20) AS i
    FROM events)"""


_RECORDER = f"""
WITH RECURSIVE {_FRAMES},
r AS (
    SELECT user_id, i, ts, 0 AS level, NULL::DOUBLE AS last, NULL::DOUBLE AS trigger, NULL::DOUBLE AS began, NULL::TIMESTAMP AS began_at, 0::BIGINT AS n, FALSE AS ends FROM f WHERE i = 1
    UNION ALL
    SELECT user_id, i, ts, level, last, trigger, began, began_at, n, began IS NOT NULL AND (t - last >= 14400 OR t - began >= 43200) AS ends
    FROM (
        SELECT user_id, i, ts, t, level, last, CASE WHEN opens THEN t ELSE trigger END AS trigger, CASE WHEN opens THEN t ELSE began END AS began,
               CASE WHEN opens THEN ts ELSE began_at END AS began_at, CASE WHEN opens THEN least(i, 3) WHEN began IS NOT NULL THEN n + 1 ELSE 0 END AS n
        FROM (
            SELECT *, began IS NULL AND level = 2 AND (trigger IS NULL OR t - trigger >= 3600) AS opens
            FROM (
                SELECT user_id, i, ts, t, level, CASE WHEN level = 2 THEN t ELSE last END AS last, trigger, began, began_at, n
                FROM (
                    SELECT f.user_id, f.i, f.ts, f.t, least(greatest(CASE WHEN r.ends THEN 0 ELSE r.level END + CASE WHEN f.moved THEN 1 ELSE -1 END, 0), 2) AS level,
                           CASE WHEN NOT r.ends THEN r.last END AS last, r.trigger, CASE WHEN NOT r.ends THEN r.began END AS began, CASE WHEN NOT r.ends THEN r.began_at END AS began_at, r.n
                    FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.i + 1)))))"""


@query(f"""{_RECORDER}
SELECT user_id AS machine, strftime(began_at, '%Y%m%d_%H%M%S') AS clip, n, i - n AS first_frame, i - 1 AS last_frame,
       round(epoch_us(ts) / 1e6 - epoch_us(began_at) / 1e6 - (n * 3600.0 - 10800.0), 3) AS lost_s
FROM r JOIN (SELECT user_id, max(i) AS final FROM f GROUP BY user_id) USING (user_id) WHERE began IS NOT NULL AND (ends OR i = final)
""")
def q38_recordings(spark, sf_dir):
    """The recorder over each machine's events as frames, one an hour: gap of 4 hours, 12 hours at most, 3 frames before."""
    frames = table(spark, sf_dir, "events").select(F.col("user_id").alias("machine"), "ts", (F.col("value") > 20).alias("active"))
    rule = Sessions(confirm=2, gap_s=4 * 3600.0, longest_s=12 * 3600.0, cooldown_s=3600.0, before_s=3 * 3600.0, fps=1 / 3600)
    return monitor.recordings_of(frames, rule).select("machine", "clip", "n", "first_frame", "last_frame", "lost_s")


_TURN = "6.283185307179586"


def _fourier(size: int, weight: str = "1") -> str:
    """Squares of the Fourier sums at k of the list x without its mean, weighted by an expression of j."""
    part = lambda f: f"power(list_sum([(x[j + 1] - m) * {weight} * {f}({_TURN} * k * j / {size}) for j in range({size})]), 2)"
    return f"({part('cos')} + {part('sin')})"


@query(f"""
WITH e AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings),
w AS (SELECT vec_id, s, [v[8 * s + j + 1] for j in range(16)] AS x, list_avg(x) AS m FROM e, range(7) t(s)),
p AS (SELECT vec_id, k, avg({_fourier(16, f"(0.5 - 0.5 * cos({_TURN} * j / 16))")} / (30.0 * 6) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) AS p
      FROM w, range(9) t(k) WHERE k * 30.0 / 16 BETWEEN 1 AND 20 GROUP BY ALL),
q AS (SELECT *, p / (sum(p) OVER (PARTITION BY vec_id) + 1e-9) AS q FROM p),
a AS (SELECT vec_id, round(sum(p), 6) AS band_power, arg_max(k * 30.0 / 16, p)::DOUBLE AS top_hz, round(sum(-q * ln(q + 1e-12)), 6) AS entropy FROM q GROUP BY 1),
l AS (SELECT vec_id, s, [v[8 * s + j + 1] for j in range(32)] AS x, list_avg(x) AS m FROM e, range(5) t(s)),
f AS (SELECT vec_id, s, arg_max(k * 30.0 / 32, {_fourier(32)}) AS top FROM l, range(17) t(k) WHERE k * 30.0 / 32 BETWEEN 1 AND 20 GROUP BY ALL),
b AS (SELECT vec_id, round(stddev_pop(top), 6) AS freq_stability_std, count(*) AS windows FROM f GROUP BY 1)
SELECT * FROM a JOIN b USING (vec_id)
""")
def q39_welch_windows(spark, sf_dir):
    """Welch spectra and the steadiness of the top frequency, of embeddings as series of 64 samples, a sample a row."""
    samples = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "value"))
    spectra = signals.welch(samples, ["vec_id"], ["place"], 16, 30.0).where(F.col("frequency").between(1.0, 20.0))
    steady = signals.stability(samples, ["vec_id"], ["place"], 32, 8, 30.0, 1.0, 20.0)
    summary = signals.band_summary(spectra, "vec_id").select("vec_id", r6("band_power").alias("band_power"), "top_hz", r6("entropy").alias("entropy"))
    return summary.join(steady.select("vec_id", r6("freq_stability_std").alias("freq_stability_std"), "windows"), "vec_id")


@query(f"""{_RECORDER},
c AS (SELECT user_id, began_at, n, i - n + 1 AS first, i AS last FROM r JOIN (SELECT user_id, max(i) AS final FROM f GROUP BY user_id) USING (user_id) WHERE began IS NOT NULL AND (ends OR i = final)),
p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, lpad(event_id::VARCHAR, 12, '0') AS pixels FROM events)
SELECT user_id AS machine, strftime(began_at, '%Y%m%d_%H%M%S') AS clip, n, sum(length(pixels))::BIGINT AS bytes, sha256(string_agg(pixels, '' ORDER BY i)) AS frames_sha256
FROM c JOIN p USING (user_id) WHERE i BETWEEN first AND last GROUP BY user_id, began_at, n
""")
def q40_clip_frames(spark, sf_dir):
    """The frames of each of q38's recordings in order, an event's frame being the digits of its id."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("machine"), "ts", (F.col("value") > 20).alias("active"), F.lpad(F.col("event_id").cast("string"), 12, "0").cast("binary").alias("pixels"))
    rule = Sessions(confirm=2, gap_s=4 * 3600.0, longest_s=12 * 3600.0, cooldown_s=3600.0, before_s=3 * 3600.0, fps=1 / 3600)
    frames = events.select("machine", "ts", F.lit(1).alias("h"), F.lit(12).alias("w"), "pixels")
    clips = live.gathered(monitor.recordings_of(events.select("machine", "ts", "active"), rule), frames, rule)
    return clips.select("machine", "clip", "n", F.length("pixels").cast("long").alias("bytes"), F.sha2("pixels", 256).alias("frames_sha256"))
