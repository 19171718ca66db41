import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.config import LIVE, LIVE_FEATURES, SELECTED, Sessions
from pulsegrid.operators import extract
from pulsegrid.streaming import live, monitor

RULE = Sessions(fps=10, confirm=3, gap_s=1.5, longest_s=30, cooldown_s=1, before_s=3, least_pixels=40)
BASE = dt.datetime(2024, 1, 1, 6)
SCHEMA = "machine int, ts timestamp, h int, w int, pixels binary"
STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shots(machine):
    """Three runs of a machine; what is seen of the second is flat, so its clip is rejected; one frame of another size, one without pixels."""
    still = np.random.default_rng(machine).integers(60, 200, (24, 24)).astype(np.uint8)
    out = []
    for i in range(460):
        f = still.copy()
        if 40 <= i < 130 or 300 <= i < 400:
            f[4:20, 4:20] = 250 if i % 2 else 10
        elif 148 <= i < 266:
            f[:] = 140 if 180 <= i < 256 and i % 2 else 100
        out.append((machine, BASE + dt.timedelta(seconds=i / 10), 24, 24, bytearray(f.tobytes())))
    out[70] = (*out[70][:2], 12, 24, bytearray(12 * 24))
    out[75] = (*out[75][:4], None)
    return out


def looped(rows, rule):
    """(start, end, numbers of frames) of one machine's recordings, from a loop over its frames with a buffer of numbers."""
    out, state, buffer, held, last = [], monitor.fresh(), [], [], None
    for number, (_, ts, *shot) in enumerate(rows):
        active, last = extract.in_motion(last, tuple(shot), rule), tuple(shot)
        buffer = (buffer + [number])[-int(rule.before_s * rule.fps) :]
        was, found = state["start"], monitor.step(state, (ts - dt.datetime(1970, 1, 1)).total_seconds(), active, rule)
        # step() has put an end to a clip by the time that it gives it
        if was is not None:
            held.append(number)
        elif state["start"] is not None:
            held, start = list(buffer), number
        if found:
            out.append((rows[start][1], ts, held))
    return out


def pixels_of(rows, numbers, start):
    size = next(r[2:4] for r in rows if r[1] == start)
    return b"".join(bytes(rows[k][4]) for k in numbers if rows[k][4] is not None and rows[k][2:4] == size)


@pytest.fixture(scope="module")
def frames():
    return {m: shots(m) for m in (1, 2)}


def test_clips_of_a_table_equal_a_loop(spark, frames):
    df = spark.createDataFrame([r for rows in frames.values() for r in rows], SCHEMA).repartition(3)
    got = sorted((r.machine, r.start, r.end, r.n, r.first_frame, bytes(r.pixels)) for r in live.clips_of(df, RULE).collect())
    want = sorted((m, start, end, len(own), own[0], pixels_of(rows, own, start)) for m, rows in frames.items() for start, end, own in looped(rows, RULE))
    assert got == want and len(want) == 6
    assert all(own == sorted(set(own)) for rows in frames.values() for _, _, own in looped(rows, RULE))
    assert live.clips_of(df.where("false"), RULE).collect() == []


def models():
    cycle = {"interval_mean": 13.0, "interval_std": 1.0, "duration_mean": 8.9, "duration_std": 0.2, "expected_hours": [6.0, 9.0]}
    detectors = {"one": (live.by_column("one", F.col("motion_cv")), 0.1), "two": (live.by_column("two", -F.col("dominant_freq_hz")), 0.0)}
    return live.Models(cycle, {f: (-1e6, 1e6, 0.5, 2.0) for f in SELECTED}, detectors, votes=1)


def by_table(spark, df, given):
    """What the query logs, from the forms for tables and a loop over each machine's clips."""
    found = live.clips_of(df, RULE)
    rows = extract.extract_clips(found, LIVE_FEATURES, LIVE, keep=("machine", "start", "n", "lost_s"))
    votes = {r.file: r for r in live.voted(live.scaled(rows, given), given).collect()}
    out, state = [], {}
    for r in rows.orderBy("machine", "start").collect():
        anomalies = None
        if r.status == "OK":
            state[r.machine], anomalies = monitor.checked_one(state.get(r.machine, (None, None, 0)), r.start, r.pump_dur_s, given.schedule)
        own = votes.get(r.file)
        out.append((r.file, r.status, r.n, r.pump_dur_s, r.motion_cv and round(r.motion_cv, 5), anomalies, own and own.flag_one, own and own.flag_two, own and own.vote_count))
    return sorted(out, key=str)


def logged(spark, path):
    rows = spark.read.json(f"{path}/results").collect()
    return sorted(((r.file, r.status, r.n, r.pump_dur_s, r.motion_cv, r.anomalies, r.flag_one, r.flag_two, r.vote_count) for r in rows), key=str)


def test_one_query_from_frames_to_the_log_over_a_restart(spark, frames, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE)
    given, rows = models(), [r for own in frames.values() for r in own]
    df = spark.createDataFrame(rows, SCHEMA)
    want = by_table(spark, df, given)
    assert [w[1] for w in want].count("OK") == 4 and len(want) == 6
    # the second OK clip's interval is that to the first, not to the rejected one between them
    assert any("missed_cycle" in (w[5] or []) for w in want)

    cut = BASE + dt.timedelta(seconds=9.05)  # within a clip
    (tmp_path / "in").mkdir()
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    go = lambda: live.run(stream(), given, str(tmp_path / "out"), str(tmp_path / "checkpoint"), RULE).awaitTermination(300)
    df.where(F.col("ts") < cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    df.where(F.col("ts") >= cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert logged(spark, tmp_path / "out") == want
    perf = spark.read.option("header", True).csv(str(tmp_path / "out" / "perf")).collect()
    assert sorted(r.file_name for r in perf) == sorted(w[0] for w in want if w[1] == "OK")
    assert all(float(r.total_s) >= float(r.scale_s) + float(r.vote_s) - 2e-3 and float(r.features_s) > 0 for r in perf)

    # the last batches' commits are lost: they run again and write over what they wrote
    commits = sorted((int(p.name), p) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    last = commits[-1][1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    go()
    assert logged(spark, tmp_path / "out") == want
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "perf")).count() == 4


def test_colour_frames_become_gray(spark):
    rng = np.random.default_rng(4)
    colours = rng.integers(0, 256, (3, 5, 4, 3)).astype(np.uint8)
    rows = [(1, 5, 4, bytearray(colours[:1].tobytes()), "a"), (2, 5, 4, bytearray(colours.tobytes()), "b"), (3, 5, 4, None, "c"), (4, 5, 4, bytearray(7), "d"), (5, None, 4, bytearray(12), "e")]
    got = {r.k: r for r in extract.grayed(spark.createDataFrame(rows, "k int, h int, w int, pixels binary, other string")).collect()}
    by_hand = lambda x: bytes(min(255, round(0.114 * b + 0.587 * g + 0.299 * r)) for b, g, r in x.reshape(-1, 3).astype(float).tolist())
    assert bytes(got[1].pixels) == by_hand(colours[:1]) and bytes(got[2].pixels) == by_hand(colours)
    assert got[3].pixels is got[4].pixels is got[5].pixels is None and [got[k].other for k in range(1, 6)] == list("abcde")
