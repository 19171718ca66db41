"""The live path as Structured Streaming: recordings by motion, and the schedule check, both keyed by machine.

Event time takes the place of arrival time. A batch of a trigger is sorted by time within a machine,
and events that come later than the machine's last one are handled where they arrive, as a late clip
would be. Input is bounded by the source's options, not dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.config import Sessions
from pulsegrid.functions.columns import seconds
from pulsegrid.sources.files import write_csv


def step(state: dict, t: float, active: bool, rule: Sessions) -> dict | None:
    """Takes one frame into a machine's state; the recording that it closes, if any.

    Active frames raise the level, others lower it; motion is a level of `confirm`, and renews the last motion.
    Motion opens a recording, `cooldown_s` after the last trigger or later, with the frames of the last
    `before_s` seconds (by number, at `fps`); each frame counts once. The frame that comes `gap_s` after the last
    motion or `longest_s` after the trigger is its last, and the level starts anew. A first frame shows no motion.
    """
    motion = False
    if state["count"]:
        state["level"] = min(max(state["level"] + (1 if active else -1), 0), rule.confirm)
        if motion := state["level"] == rule.confirm:
            state["last"] = t
    state["count"] += 1
    if state["start"] is not None:
        state["n"] += 1
    elif motion and (state["trigger"] is None or t - state["trigger"] >= rule.cooldown_s):
        state |= {"start": t, "trigger": t, "n": min(state["count"], max(1, int(rule.before_s * rule.fps)))}
    if state["start"] is None or (state["last"] is None or t - state["last"] < rule.gap_s) and t - state["start"] < rule.longest_s:
        return None
    return closed(state, t)


def closed(state: dict, t: float) -> dict:
    """The open recording, which ends at t with the machine's latest frame."""
    out = {"start": state["start"], "end": t, "n": state["n"], "first_frame": state["count"] - state["n"], "last_frame": state["count"] - 1}
    state |= {"start": None, "level": 0, "last": None, "n": 0}
    return out


def stamps(at: Sequence[float]) -> pd.DatetimeIndex:
    """Seconds as timestamps of whole microseconds."""
    return pd.to_datetime([round(t * 1e6) for t in at], unit="us")


def fresh() -> dict:
    return {"level": 0, "start": None, "last": None, "trigger": None, "n": 0, "count": 0}


def described(recordings: DataFrame, rule: Sessions, keep: Sequence[str] = ()) -> DataFrame:
    """Recordings with the clip's id (the trigger's time), and how many seconds were lost: real time less that of the frames after the trigger."""
    real = seconds(F.col("end")) - seconds(F.col("start"))
    clip = F.date_format("start", "yyyyMMdd_HHmmss")
    return recordings.select("machine", clip.alias("clip"), "start", "end", "n", "first_frame", "last_frame", F.round(real - (F.col("n") / rule.fps - rule.before_s), 3).alias("lost_s"), *keep)


class _Recorder(StatefulProcessor):
    """State of a machine: level, open recording, last trigger, frames so far. A timer closes a recording once the watermark is past its gap: no frame came to end it."""

    COLUMNS = ("level", "start", "last", "trigger", "n", "count")

    def __init__(self, rule: dict) -> None:
        self.rule = Sessions(**rule)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recorder", "level int, start double, last double, trigger double, n long, count long, latest double")

    def _load(self) -> tuple[dict, float]:
        got = self.state.get() if self.state.exists() else None
        return (dict(zip(self.COLUMNS, got[:-1], strict=True)), got[-1]) if got is not None else (fresh(), 0.0)

    def _out(self, key: tuple, found: list[dict]) -> Iterator[pd.DataFrame]:
        if found:
            times = {c: stamps([x[c] for x in found]) for c in ("start", "end")}
            yield pd.DataFrame({"machine": [key[0]] * len(found), **times, **{c: [int(x[c]) for x in found] for c in ("n", "first_frame", "last_frame")}})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (state, latest), found = self._load(), []
        frames = pd.concat(list(rows)).sort_values(["ts", "active"], kind="stable")
        for t, active in zip(frames["ts"].astype("datetime64[ns]").astype("int64") // 1000 / 1e6, frames["active"], strict=True):
            latest = float(t)
            if (c := step(state, latest, bool(active), self.rule)) is not None:
                found.append(c)
        self.state.update((*[state[c] for c in self.COLUMNS], latest))
        if state["start"] is not None:
            self.handle.registerTimer(int(self._due(state) * 1000) + 1)
        yield from self._out(key, found)

    def _due(self, state: dict) -> float:
        """When an open recording ends if no more frames come."""
        longest = state["start"] + self.rule.longest_s
        return longest if state["last"] is None else min(longest, state["last"] + self.rule.gap_s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (state, latest), found = self._load(), []
        if state["start"] is not None and expiredTimerInfo.getExpiryTimeInMs() > self._due(state) * 1000:
            found.append(closed(state, latest))
            self.state.update((*[state[c] for c in self.COLUMNS], latest))
        yield from self._out(key, found)

    def close(self) -> None:
        pass


def recordings(frames: DataFrame, rule: Sessions = Sessions(), late: str = "10 seconds") -> DataFrame:  # noqa: B008
    """frames (machine, ts timestamp, active boolean), a stream, to recordings (see `described`) as they close."""
    marked = frames.withWatermark("ts", late).select("machine", "ts", "active")
    kind = frames.schema["machine"].dataType.simpleString()
    schema = f"machine {kind}, start timestamp, end timestamp, n long, first_frame long, last_frame long"
    return described(marked.groupBy("machine").transformWithStateInPandas(_Recorder(asdict(rule)), schema, "Append", "EventTime"), rule)


def recordings_of(frames: DataFrame, rule: Sessions = Sessions()) -> DataFrame:  # noqa: B008
    """The same of a table: a series is folded in order, batch by batch, and what is open at its end is closed there."""
    schema = T.StructType([T.StructField("machine", frames.schema["machine"].dataType), *T.StructType.fromDDL("start double, end double, n long, first_frame long, last_frame long").fields])
    arrow, names = to_arrow_schema(schema), ("start", "end", "n", "first_frame", "last_frame")

    def record(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c[j] for c in found], f.type) for j, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, latest = fresh(), None, 0.0
        for batch in batches:
            found = []
            for machine, t, active in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if machine != last:
                    if state["start"] is not None:
                        end = closed(state, latest)
                        found.append((last, *[end[c] for c in names]))
                    state, last = fresh(), machine
                latest = t
                if (c := step(state, t, bool(active), rule)) is not None:
                    found.append((machine, *[c[k] for k in names]))
            yield record(found)
        if state["start"] is not None:
            end = closed(state, latest)
            yield record([(last, *[end[c] for c in names])])

    timed = frames.select("machine", seconds(F.col("ts")).alias("t"), "active")
    found = timed.repartition("machine").sortWithinPartitions("machine", "t", "active").mapInArrow(run, schema)
    return described(found.withColumns({c: F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long")) for c in ("start", "end")}), rule)


def checked_one(state: tuple, ts: pd.Timestamp, duration: float, model: dict) -> tuple[tuple, list[str]]:
    """Takes one activation into a machine's state (time of its last one, the day and how many it had on it): the new state and the anomalies."""
    (last, day, n), found = state, []
    t, today = ts.timestamp(), ts.strftime("%Y-%m-%d")
    n = 0 if day != today else n
    hour = ts.hour + ts.minute / 60 + ts.second / 3600
    if last is not None and abs(t - last - model["interval_mean"]) > 3 * model["interval_std"]:
        found.append("missed_cycle" if t - last > model["interval_mean"] else "extra_cycle")
    if abs(duration - model["duration_mean"]) > 3 * model["duration_std"]:
        found.append("wrong_duration")
    expected = model["expected_hours"]
    if n < len(expected) and expected[n] is not None and abs(hour - expected[n]) > 0.5:
        found.append("wrong_time")
    return (t, today, n + 1), found


class _Checker(StatefulProcessor):
    """State of a machine: see checked_one. A row without a duration, of a clip that was rejected, passes by and changes nothing."""

    def __init__(self, model: dict, names: list[str]) -> None:
        self.model, self.names = model, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("checker", "last double, day string, n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else (None, None, 0)
        rows, found = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable"), []
        for ts, duration in zip(rows["ts"], rows["duration"], strict=True):
            anomalies = None
            if not pd.isna(duration):
                state, anomalies = checked_one(state, ts, duration, self.model)
            found.append(anomalies)
        self.state.update(tuple(state))
        rows["anomalies"] = found
        yield rows[self.names]

    def close(self) -> None:
        pass


def checked(activations: DataFrame, model: dict, keep: Sequence[str] = ()) -> DataFrame:
    """activations (machine, id, ts, duration), a stream, to machine, id, the columns of `keep` and anomalies; clips that were rejected have a null duration, and get null."""
    names = ["machine", "id", *keep]
    schema = T.StructType([*[activations.schema[c] for c in names], T.StructField("anomalies", T.ArrayType(T.StringType()))])
    given = activations.select(*dict.fromkeys([*names, "ts", "duration"]))
    return given.groupBy("machine").transformWithStateInPandas(_Checker(model, schema.names), schema, "Append", "None")


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """What a result log shows: floating columns rounded, nested ones as they are."""
    return df.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def log_to(df: DataFrame, path: str, checkpoint: str):
    """A stream's results as JSON lines, a file for each batch; a batch that runs again writes over its own."""

    def write(batch: DataFrame, n: int) -> None:
        rounded(batch).write.mode("overwrite").json(f"{path}/batch={n}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def perf_log_to(results: DataFrame, path: str, checkpoint: str, started: str = "received"):
    """A stream's timings as a CSV log (timestamp, file_name, total_s), a folder for each batch, which a batch that runs again writes over: how long after `started`, a timestamp of the row, its batch was handled."""

    def write(batch: DataFrame, n: int) -> None:
        now = F.current_timestamp()
        timed = batch.select(F.date_format(now, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("file").alias("file_name"), (seconds(now) - seconds(F.col(started))).alias("total_s"))
        write_csv(rounded(timed, 3), f"{path}/batch={n}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
