import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.config import OFFLINE, Profile, Sessions
from pulsegrid.functions import kernels as K
from pulsegrid.functions.quantiles import exact_quantiles, grouped_quantiles
from pulsegrid.operators import detectors, evaluation, extract, prep, schedule, signals
from pulsegrid.sources import files
from pulsegrid.streaming import monitor


def wave(hz, n=600, fps=30.0, noise=0.0):
    return 1 + np.sin(2 * np.pi * hz * np.arange(n) / fps) + noise * np.random.default_rng(1).normal(size=n)


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, 1.0], [float(i % 97) for i in range(9000)], [2.0**i for i in range(-40, 60)] * 60, [0.1] * 5000 + [0.2]])
def test_quantiles_equal_sorting(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, ["v"], shares)["v"]
    assert np.allclose(got, np.quantile(values, shares), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "v double"), ["v"], [0.5]) == {"v": [None]}


def test_nan_and_null_are_told_apart_and_filled(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", math.nan), ("c", None), ("d", 5.0)], "file string, x double")
    assert prep.medians(df, ["x"]) == {"x": 3.0}
    assert [r.x for r in prep.filled(df, {"x": 3.0}).orderBy("file").collect()] == [1.0, 3.0, 3.0, 5.0]
    assert [r.y for r in prep.live_vector(df, ["x", "y"]).collect()] == [0.0] * 4
    assert [r.x for r in prep.clip(df, {"x": (2.0, 4.0)}).orderBy("file").collect()] == [2.0, None, None, 4.0]
    with pytest.raises(ValueError, match="z"):
        prep.require(df, ["x", "z"])


def test_spectrum_finds_the_frequency():
    for hz in (2.5, 7.0, 11.0):
        assert abs(extract.spectral(wave(hz), 30.0, OFFLINE)["dominant_freq_hz"] - hz) < 0.25
    f, psd = K.welch(wave(5.0), 30.0, 128)
    assert abs(psd.sum() * (f[1] - f[0]) - 0.5) < 0.02  # power of a sine


@given(st.lists(st.integers(-5, 5), min_size=3, max_size=60))
@settings(max_examples=200, deadline=None)
def test_peaks_against_their_definition(xs):
    x = np.array(xs, float)
    want = []
    i = 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            want.append((i + j) // 2)
        i = j + 1
    assert K.local_maxima(x).tolist() == want
    kept = K.peaks(x, 3)
    assert all(b - a >= 3 for a, b in zip(kept[:-1], kept[1:], strict=True))


def test_frame_kernels():
    rng = np.random.default_rng(0)
    frame = rng.integers(0, 256, (9, 11), np.uint8)
    assert (K.blur(np.full((2, 8, 8), 77, np.uint8)) == 77).all()
    mask = rng.random((9, 11)) > 0.5
    padded = np.pad(mask, 2, mode="edge")
    assert (K.majority(mask) == np.array([[padded[i : i + 5, j : j + 5].sum() >= 13 for j in range(11)] for i in range(9)])).all()
    assert K.sharpness(frame) > 0 and K.sharpness(np.zeros((5, 5), np.uint8)) == 0
    assert K.gray(np.array([[[255, 255, 255], [0, 0, 255]]], np.uint8)).tolist() == [[255, 76]]
    assert np.allclose(K.envelope(np.cos(2 * np.pi * 5 * np.arange(100) / 100)), 1)


def clip(n=240, moving=(60, 200), h=24, w=24):
    rng = np.random.default_rng(3)
    frames = np.repeat(rng.integers(60, 200, (1, h, w)), n, axis=0)
    for i in range(*moving):
        frames[i, 4:20, 4:20] = 250 if i % 2 else 10
    return frames.astype(np.uint8)


def test_clips_are_extracted_or_rejected(spark):
    rows = [("a.mp4", 30.0, 24, 24, bytearray(clip().tobytes())), ("b.mp4", 30.0, 24, 24, bytearray(clip(30, (5, 20)).tobytes())), ("c.mp4", 30.0, 24, 24, bytearray(clip(moving=(0, 0)).tobytes())), ("d.mp4", 0.0, 24, 24, bytearray(np.full((90, 24, 24), 7, np.uint8).tobytes()))]
    got = {r.file: r for r in extract.extract_clips(spark.createDataFrame(rows, "file string, fps double, h int, w int, pixels binary")).collect()}
    assert {k: r.status for k, r in got.items()} == {"a.mp4": "OK", "b.mp4": "TOO_SHORT", "c.mp4": "NO_PUMP", "d.mp4": "BLURRY"}
    assert got["a.mp4"].pump_start_s == 2.0 and 6.5 < got["a.mp4"].pump_end_s < 6.8 and got["c.mp4"].motion_cv is None
    assert 0.2 < got["a.mp4"].active_roi_fraction < 0.8


def test_long_signals_equal_the_kernel(spark):
    x = wave(3.0, noise=0.1)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "clip_id string, i int, diff double")
    got = extract.extract_signals(df.orderBy(F.rand(1)), features=["dominant_freq_hz", "motion_cv"], profile=Profile()).first()
    want = extract.signal_features(pd.DataFrame({"diff": x}), 30.0, ["dominant_freq_hz", "motion_cv"])
    assert abs(got.dominant_freq_hz - want["dominant_freq_hz"]) < 1e-12 and abs(got.motion_cv - want["motion_cv"]) < 1e-12


def test_hysteresis_in_chunks_equals_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(u, i, bool(rng.random() < 0.55)) for u in (1, 2) for i in range(900)]
    df = spark.createDataFrame([(u, i, i, on) for u, i, on in rows], "u int, i0 int, j int, on boolean")
    got = {(r.u, r.j): r.level for r in signals.hysteresis(df, ["u"], ["j"], F.col("on")).collect()}
    level = {}
    for u, i, on in rows:
        level[u] = min(max(level.get(u, 0) + (1 if on else -1), 0), 5)
        assert got[u, i] == level[u]


def test_ecod_and_ranks_with_ties(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(20)], "k int, x double")
    got = {r.x: (r.up_to, r["from"]) for r in detectors.value_ranks(df, "x").collect()}
    assert got == {0.0: (5, 20), 1.0: (10, 15), 2.0: (15, 10), 3.0: (20, 5)}
    assert detectors.ecod(df, ["x"], "k").count() == 20


@given(st.lists(st.tuples(st.integers(0, 6), st.booleans()), min_size=2, max_size=25).filter(lambda x: len({h for _, h in x}) == 2))
@settings(max_examples=5, deadline=None)
def test_area_equals_pairs(spark, rows):
    df = spark.createDataFrame([(float(s), h) for s, h in rows], "s double, h boolean")
    pos, neg = [s for s, h in rows if h], [s for s, h in rows if not h]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(evaluation.auc(df, "s", F.col("h")).first().auc - want) < 1e-12


def test_chi2_quantile():
    assert abs(detectors.chi2_quantile(0.95, 1) - 3.841459) < 1e-5 and abs(detectors.chi2_quantile(0.5, 14) - 13.339274) < 1e-5


def test_left_out_scores_are_of_all_rows(spark):
    rng = np.random.default_rng(4)
    few = rng.normal(size=(40, 3))
    threshold, folds = detectors.leave_one_out(spark.createDataFrame(few.tolist(), "a double, b double, c double"), ["a", "b", "c"], "mahalanobis", 0.9)
    want = [detectors._loo_one(few, i, "mahalanobis") for i in range(len(few))]
    assert np.allclose(sorted(r.score for r in folds.collect()), sorted(want), rtol=1e-9) and abs(threshold - np.quantile(want, 0.9)) < 1e-9
    x, n = rng.standard_exponential(detectors.MOST_ROWS + 5000), detectors.MOST_ROWS + 5000
    mean = (x.sum() - x) / (n - 1)
    var = ((x * x).sum() - x * x - (n - 1) * mean**2) / (n - 2)
    threshold, folds = detectors.leave_one_out(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"], "mahalanobis")
    assert folds.count() == n and abs(threshold - np.quantile(np.abs(x - mean) / np.sqrt(var + 1e-6), 0.99)) < 1e-8


def test_samples_hold_copies_in_proportion(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("x"))
    got = detectors.sampled(df, ["x"], 3000)
    assert abs(len(got) - 3000) < 300 and abs((got == 0).mean() - 1 / 3) < 0.05
    assert (got == detectors.sampled(df.repartition(7), ["x"], 3000)).all()


def test_flags_without_a_threshold(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "s double")
    assert [r.f for r in df.select(evaluation.flag(F.col("s"), None).alias("f")).collect()] == [0, 0]
    assert [r.f for r in df.select(evaluation.flag(F.col("s"), 0.5).alias("f")).collect()] == [1, 0]


def test_artefacts(spark, tmp_path):
    assert files.load_artefact(spark, str(tmp_path), "none") is None
    files.save_artefact(spark, str(tmp_path), "m", {"threshold": 1.5, "features": ["a"]})
    assert files.load_artefact(spark, str(tmp_path), "m") == {"threshold": 1.5, "features": ["a"]}


def frames_of(spark, n=400):
    rng, base = np.random.default_rng(2), dt.datetime(2024, 1, 1)
    on = (np.arange(n) // 60) % 2 == 0
    return [(m, base + dt.timedelta(seconds=i * 0.5), bool(rng.random() < (0.9 if on[i] else 0.03))) for m in (1, 2) for i in range(n)]


def recorded(frames, rule):
    """The published recorder as a plain loop over one machine's (t, active): buffer, streak, trigger, then the frame is written."""
    out, buffer, streak, recording, last_motion, last_trigger = [], [], 0, None, None, None
    for number, (t, active) in enumerate(frames):
        buffer = (buffer + [number])[-int(rule.before_s * rule.fps) :]
        motion = False
        if number > 0:
            streak = streak + 1 if active else max(0, streak - 1)
            if streak >= rule.confirm:
                motion, last_motion, streak = True, t, rule.confirm
        if motion and recording is None and (last_trigger is None or t - last_trigger >= rule.cooldown_s):
            recording, last_trigger, began = list(buffer), t, t
        elif recording is not None:
            recording.append(number)
        if recording is not None and ((last_motion is not None and t - last_motion >= rule.gap_s) or t - began >= rule.longest_s):
            out.append((began, t, recording))
            recording, streak, last_motion = None, 0, None
    if recording is not None:
        out.append((began, t, recording))
    return [(b, e, len(r), r[0], r[-1]) for b, e, r in out]


RULE = Sessions(confirm=3, gap_s=4, longest_s=25, cooldown_s=1, before_s=2, fps=2)


def looped(rows, rule):
    at = lambda ts: (ts - dt.datetime(1970, 1, 1)).total_seconds()
    return sorted((m, *r) for m in {k for k, _, _ in rows} for r in recorded([(at(ts), on) for k, ts, on in rows if k == m], rule))


_RECORDED = "machine, unix_micros(start) / 1e6 s, unix_micros(end) / 1e6 e, n, first_frame, last_frame"


def test_streamed_recordings_equal_a_loop(spark, tmp_path):
    rows = frames_of(spark) + [(m, dt.datetime(2024, 1, 2), False) for m in (1, 2)]
    df = spark.createDataFrame(rows, "machine int, ts timestamp, active boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = monitor.recordings(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), RULE).writeStream.format("memory").queryName("recorded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    query.start().awaitTermination(120)
    got = sorted(map(tuple, spark.sql(f"select {_RECORDED} from recorded").collect()))
    assert got == looped(rows, RULE) and len(got) > 4


@pytest.mark.parametrize("rule", [RULE, Sessions(fps=2), Sessions(confirm=2, gap_s=1, longest_s=3, cooldown_s=30, before_s=60, fps=2)])
def test_recordings_equal_a_loop_and_carry_over_batches(spark, rule):
    rows = frames_of(spark)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, 37)
    try:
        out = monitor.recordings_of(spark.createDataFrame(rows, "machine int, ts timestamp, active boolean").orderBy(F.rand(3)), rule)
        assert "InPandas" not in out._jdf.queryExecution().toString()  # no whole series as a frame
        assert sorted(map(tuple, out.selectExpr(*_RECORDED.split(", ")).collect())) == looped(rows, rule)
        first = out.orderBy("machine", "start").first()
        assert first.clip == first.start.strftime("%Y%m%d_%H%M%S")
        assert abs(first.lost_s - ((first.end - first.start).total_seconds() - (first.n / rule.fps - rule.before_s))) < 1e-3
    finally:
        spark.conf.unset(size)


def test_motion_between_frames(spark):
    frames = clip(12, (4, 9))
    rows = [(m, i, 24, 24, bytearray(f.tobytes())) for m in (1, 2) for i, f in enumerate(frames)]
    out = extract.moving(spark.createDataFrame(rows, "machine int, ts int, h int, w int, pixels binary").orderBy(F.rand(2)))
    soft = K.blur(frames).astype(int)
    want = [False] + [bool(K.majority(np.abs(soft[i] - soft[i - 1]) > 15).sum() >= 60) for i in range(1, 12)]
    assert sum(want) >= 5
    assert [(r.machine, r.ts, r.active) for r in out.orderBy("machine", "ts").collect()] == [(m, i, a) for m in (1, 2) for i, a in enumerate(want)]


def test_files_to_features(spark, tmp_path):
    rng = np.random.default_rng(8)
    whole = np.repeat(rng.integers(40, 220, (1, 40, 48)), 240, axis=0).astype(np.uint8)
    whole[:, 8:32, 10:34] = clip()
    for name, head, more in (("a", b"YUV4MPEG2 W48 H40 F30:1 Ip A1:1 C420jpeg", 40 * 48 // 2), ("b", b"YUV4MPEG2 W48 H40 F60:2 Cmono", 0)):
        (tmp_path / f"{name}.y4m").write_bytes(head + b"\n" + b"".join(b"FRAME\n" + f.tobytes() + bytes(more) for f in whole) + b"FRAME\ncut")
    (tmp_path / "c.y4m").write_bytes(b"no clip at all")
    clips = files.read_clips(spark, str(tmp_path)).withColumn("key", F.regexp_replace("file", r"\.y4m$", ""))
    (tmp_path / "r.json").write_text('{"a.jpg": [10, 8, 24, 24], "b.jpg": [10, 8, 24, 24], "c.jpg": [0, 0, 5, 5]}')
    found, missed = files.with_regions(clips, files.read_regions(spark, str(tmp_path / "r.json")))
    got = {r.file: r for r in extract.extract_clips(found).collect()}
    assert missed.isEmpty() and {k: r.status for k, r in got.items()} == {"a.y4m": "OK", "b.y4m": "OK", "c.y4m": "TOO_SHORT"}
    status, want = extract.clip_signals(whole, 30.0, box=(10, 8, 34, 32))
    assert status == "OK" and got["a.y4m"].pump_start_s == got["b.y4m"].pump_start_s == round(want["start"] / 30, 2)
    # blurred whole, then cut: what lies beside the region counts at its border
    assert not np.array_equal(K.blur(whole[:1, 8:32, 10:34]), K.blur(whole[:1])[:, 8:32, 10:34])


def test_kernels_against_their_definitions():
    x, fps = wave(3.3, 200, noise=0.4), 30.0
    f, psd = K.welch(x, fps, 64)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    parts = [x[a : a + 64] for a in range(0, 200 - 63, 32)]
    power = np.array([[abs(sum((p[j] - p.mean()) * w[j] * np.exp(-2j * np.pi * k * j / 64) for j in range(64))) ** 2 for k in range(33)] for p in parts]).mean(axis=0) / (fps * (w**2).sum())
    power[1:-1] *= 2
    assert np.allclose(psd, power) and np.allclose(f, np.arange(33) * fps / 64)

    def stands_above(x, i):
        a = i
        while a > 0 and x[a - 1] <= x[i]:
            a -= 1
        b = i
        while b < len(x) - 1 and x[b + 1] <= x[i]:
            b += 1
        return x[i] - max(min(x[a : i + 1]), min(x[i : b + 1]))

    tops = K.local_maxima(x)
    assert len(tops) > 20 and all(abs(K.prominence(x, i) - stands_above(x, i)) < 1e-12 for i in tops)


def test_arrays_equal_the_kernel(spark):
    x = wave(3.0, noise=0.1)
    got = {r.k: r for r in extract.extract_arrays(spark.createDataFrame([(1, x.tolist()), (2, None), (3, [1.0, 2.0])], "k int, v array<double>"), "k", "v").collect()}
    want = extract.signal_features({"diff": x}, 30.0)
    assert all(abs(got[1][f] - v) < 1e-12 for f, v in want.items()) and got[2].motion_cv == got[3].motion_cv == 0


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i % 3 == 0 else f"g{i % 3}", float(v), None if i % 7 == 0 else float(i % 5)) for i, v in enumerate(rng.exponential(size=20_000))]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "x", "y"]), "g string, x double, y double")
    got = grouped_quantiles(df, ["g"], ["x", "y"], [0.0, 0.25, 0.99])
    for g in (None, "g1", "g2"):
        for c, j in (("x", 1), ("y", 2)):
            assert np.allclose(got[c, g], np.quantile([r[j] for r in rows if r[0] == g and r[j] is not None and r[j] == r[j]], [0, 0.25, 0.99]))


def test_hot_values_have_ranks(spark):
    df = spark.range(9000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, 1.0).otherwise(F.col("id") / 100).alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    rows = df.collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    tails = [(-np.log((v[:, None] >= u).mean(axis=1)), -np.log((v[:, None] <= u).mean(axis=1)), ((v - v.mean()) ** 3).mean()) for v, u in ((x, x), (y, y))]
    want = np.maximum.reduce([sum(t[0] for t in tails), sum(t[1] for t in tails), sum(t[0] if t[2] < 0 else t[1] for t in tails)])
    got = {r.k: r.score for r in detectors.ecod(df, ["x", "y"], "k").collect()}
    assert np.allclose([got[r.k] for r in rows], want)


def test_report_tables(spark, tmp_path):
    folds = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 2, 3, 6])], "fold long, score double")
    assert evaluation.fold_report(folds).first().asDict() == {"mean": 2.8, "std": np.std([1, 2, 2, 3, 6]), "max": 6.0, "n": 5}
    bars = evaluation.fold_histogram(folds, 5.5, 5).orderBy("bar").collect()
    assert [(b["from"], b["to"], b.n, b.threshold) for b in bars] == [(1, 2, 1, 5.5), (2, 3, 2, 5.5), (3, 4, 1, 5.5), (4, 5, 0, 5.5), (5, 6, 1, 5.5)]
    pairs = spark.createDataFrame([("motion_cv", "other", 0.98), ("top_bot_corr", "motion_cv", -0.5)], "a string, b string, r double")
    assert [tuple(r) for r in evaluation.correlation_triangle(pairs).collect()] == [("Motion CV", "other", 0.98, True), ("Top-Bottom Corr.", "Motion CV", -0.5, False)]
    named = evaluation.named(spark.createDataFrame([(3.0,), (1.0,)], "x double"), "normal", ["x"])
    assert {(r.file, r.x) for r in named.collect()} == {("normal_0", 1.0), ("normal_1", 3.0)}
    with pytest.warns(UserWarning, match="absent"):
        assert prep.pruned(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "a double, b double"), ["a", "b"], ["absent"]) == ["a"]
    for _ in range(2):
        files.append_log(spark.createDataFrame([("x.mp4", 1.23456)], "file_name string, total_s double"), str(tmp_path / "log"))
    assert [r.total_s for r in spark.read.option("header", True).csv(str(tmp_path / "log")).collect()] == ["1.235"] * 2


def test_streamed_schedule_check_equals_the_table(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, d * 10 + k, base + dt.timedelta(days=d, hours=6 + 3 * k, seconds=(7 * d + k) % 5 + (4000 if (d, k) == (8, 1) else 0)), 40.0 + (d % 3) / 10 + (9 if (d, k) == (9, 2) else 0)) for d in range(10) for k in range(4)]
    df = spark.createDataFrame(rows, "machine int, id int, ts timestamp, duration double")
    model = schedule.fit(df.where("id < 70"), "intra_day")
    want = {r.id: r.anomalies for r in schedule.check(df, model).collect()}
    assert "wrong_duration" in want[92] and "wrong_time" in want[81]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = monitor.checked(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), model.first().asDict())
    out.writeStream.format("memory").queryName("checked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.id: r.anomalies for r in spark.table("checked").collect()} == want


def test_windows_of_long_series_equal_the_kernels(spark):
    long, short = wave(3.3, 5000, noise=0.4), wave(5.0, 300)
    rows = [(k, i, float(v)) for k, x in (("long", long), ("short", short)) for i, v in enumerate(x)] + [("few", 0, 1.0), ("few", 1, None)]
    df = spark.createDataFrame(rows, "k string, i long, value double").withColumnRenamed("i", "at").repartition(5)
    got = signals.welch(df, ["k"], ["at"], 256, 30.0).orderBy("k", "frequency").collect()
    for k, x in (("long", long), ("short", short)):
        f, psd = K.welch(x, 30.0, 256)
        own = [(r.frequency, r.power) for r in got if r.k == k]
        assert np.allclose(own, np.column_stack([f, psd]))
    assert {r.k for r in got} == {"long", "short"}
    steady = {r.k: r for r in signals.stability(df, ["k"], ["at"], 120, 15, 30.0, OFFLINE.low_hz, OFFLINE.high_hz).collect()}
    assert abs(steady["long"].freq_stability_std - extract.spectral(long, 30.0, OFFLINE)["freq_stability_std"]) < 1e-9 and steady["long"].windows == (5000 - 120) // 15 + 1
    held = signals.windows(df.where("k = 'short'"), ["k"], ["at"], 7, 3).orderBy("window").collect()
    assert [r.samples for r in held] == [short[a : a + 7].tolist() for a in range(0, 300 - 6, 3)] and [r.window for r in held] == list(range(len(held)))
