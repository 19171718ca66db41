"""Frames to a log of judged clips, as one streaming query or as jobs over a table.

    frames -> motion -> clips -> features -> schedule check -> scaling and votes -> results and timings

Motion, clips and the check hold state by machine, one after the other in one query: a machine's last frame; its
level of motion, the frames of its buffer and of the open clip; its last activation. A checkpoint carries all of
them and the source's place over a restart, and results are written in a folder for each batch, so none is lost or
written twice. The forms for tables give the same clips by a window, a join on frame numbers and a fold.

frames: machine, ts, h, w, pixels (the gray region). Those of a machine have different times. A clip holds the frames
that have the size of its first with motion, each once, up to (before_s + longest_s) * fps of them; they are one row,
as features need the whole clip, so frames should be cut to their region before they come here. Frames without pixels
count, and are in no clip.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.config import LIVE, LIVE_FEATURES, SELECTED, VOTES, Profile, Sessions
from pulsegrid.functions.columns import seconds
from pulsegrid.operators import evaluation, extract, prep
from pulsegrid.sources.files import write_csv
from pulsegrid.streaming import monitor
from pulsegrid.streaming.monitor import closed, described, fresh, rounded, stamps, step

_SHOT = "h int, w int, pixels binary"


def _micros(times: pd.Series) -> list[float]:
    return (times.astype("datetime64[ns]").astype("int64") // 1000 / 1e6).tolist()


class _Motion(StatefulProcessor):
    """State of a machine: its last frame."""

    def __init__(self, rule: dict) -> None:
        self.rule = Sessions(**rule)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frame = handle.getValueState("frame", _SHOT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.frame.get()) if self.frame.exists() else None
        frames, active = pd.concat(list(rows)).sort_values("ts", kind="stable"), []
        for shot in zip(frames["h"].tolist(), frames["w"].tolist(), frames["pixels"], strict=True):
            active.append(extract.in_motion(last, shot, self.rule))
            last = shot
        self.frame.update(last)
        frames["active"] = active
        yield frames[["machine", "ts", "h", "w", "pixels", "active"]]

    def close(self) -> None:
        pass


def motion(frames: DataFrame, rule: Sessions = Sessions(), late: str = "10 seconds") -> DataFrame:  # noqa: B008
    """frames, a stream, with `active` (see `extract.moving`, which does the same for tables)."""
    names = ["machine", "ts", "h", "w", "pixels"]
    schema = T.StructType([*[frames.schema[c] for c in names], T.StructField("active", T.BooleanType())])
    marked = frames.select(*names).withWatermark("ts", late)
    return marked.groupBy("machine").transformWithStateInPandas(_Motion(asdict(rule)), schema, "Append", "EventTime", eventTimeColumnName="ts")


def joined(shots: list[tuple[int, int, bytes | None]], size: tuple[int, int]) -> bytes:
    """The frames of a clip after each other: those of its size that have pixels."""
    return b"".join(pixels for h, w, pixels in shots if (h, w) == size and pixels is not None)


class _Clips(StatefulProcessor):
    """State of a machine: the recorder's (see `step`), the last frames of its buffer, and the frames of the open clip with its size."""

    COLUMNS = ("level", "start", "last", "trigger", "n", "count")
    NAMES = ("machine", "start", "end", "n", "first_frame", "last_frame", "h", "w", "pixels")

    def __init__(self, rule: dict) -> None:
        self.rule = Sessions(**rule)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recorder", "level int, start double, last double, trigger double, n long, count long, latest double, h int, w int")
        self.buffer, self.open = handle.getListState("buffer", _SHOT), handle.getListState("open", _SHOT)

    def _load(self) -> tuple[dict, float, tuple[int, int]]:
        if not self.state.exists():
            return fresh(), 0.0, (0, 0)
        got = self.state.get()
        return dict(zip(self.COLUMNS, got[:6], strict=True)), got[6], tuple(got[7:])

    def _save(self, state: dict, latest: float, size: tuple[int, int]) -> None:
        self.state.update((*[state[c] for c in self.COLUMNS], latest, *size))

    def _out(self, key: tuple, clips: list[tuple[dict, tuple[int, int], bytes]]) -> Iterator[pd.DataFrame]:
        if clips:
            times = {c: stamps([x[c] for x, _, _ in clips]) for c in ("start", "end")}
            counts = {c: [int(x[c]) for x, _, _ in clips] for c in ("n", "first_frame", "last_frame")}
            sizes = {"h": [s[0] for _, s, _ in clips], "w": [s[1] for _, s, _ in clips]}
            yield pd.DataFrame({"machine": [key[0]] * len(clips), **times, **counts, **sizes, "pixels": [p for _, _, p in clips]})[list(self.NAMES)]

    def _due(self, state: dict) -> float:
        longest = state["start"] + self.rule.longest_s
        return longest if state["last"] is None else min(longest, state["last"] + self.rule.gap_s)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (state, latest, size), room = self._load(), max(1, int(self.rule.before_s * self.rule.fps))
        buffer = [tuple(x) for x in self.buffer.get()] if self.buffer.exists() else []
        # frames that go to the open clip's list at the end of the batch; the list itself is only read when the clip closes
        new, clips = [], []
        frames = pd.concat(list(rows)).sort_values(["ts", "active"], kind="stable")
        for t, active, *shot in zip(_micros(frames["ts"]), frames["active"], frames["h"].tolist(), frames["w"].tolist(), frames["pixels"], strict=True):
            latest, was, shot = t, state["start"], tuple(shot)
            buffer = (buffer + [shot])[-room:]
            found = step(state, t, bool(active), self.rule)
            if was is not None:
                new.append(shot)
            elif state["start"] is not None or found is not None:
                new, size = list(buffer), shot[:2]
            if found is not None:
                held = [tuple(x) for x in self.open.get()] if was is not None and self.open.exists() else []
                clips.append((found, size, joined(held + new, size)))
                self.open.clear()
                new = []
        self.buffer.put(buffer)
        if new:
            self.open.appendList(new)
        self._save(state, latest, size)
        if state["start"] is not None:
            self.handle.registerTimer(int(self._due(state) * 1000) + 1)
        yield from self._out(key, clips)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (state, latest, size), clips = self._load(), []
        if state["start"] is not None and expiredTimerInfo.getExpiryTimeInMs() > self._due(state) * 1000:
            clips.append((closed(state, latest), size, joined([tuple(x) for x in self.open.get()], size)))
            self.open.clear()
            self._save(state, latest, size)
        yield from self._out(key, clips)

    def close(self) -> None:
        pass


def _clip_schema(frames: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("machine", frames.schema["machine"].dataType), *T.StructType.fromDDL("start timestamp, end timestamp, n long, first_frame long, last_frame long, h int, w int, pixels binary").fields])


def _named(clips: DataFrame, rule: Sessions) -> DataFrame:
    """Clips with what `described` says of their recordings, and `file` and `fps`, as features are taken from clips."""
    told = described(clips, rule, ("h", "w", "pixels"))
    file = F.concat_ws("_", F.col("machine").cast("string"), F.col("clip"))
    return told.select("machine", "clip", file.alias("file"), "start", "end", "n", "first_frame", "last_frame", "lost_s", F.lit(float(rule.fps)).alias("fps"), "h", "w", "pixels")


def clips(frames: DataFrame, rule: Sessions = Sessions(), late: str = "10 seconds") -> DataFrame:  # noqa: B008
    """frames, a stream, to clips (machine, clip, file, start, end, n, first_frame, last_frame, lost_s, fps, h, w, pixels) as they close."""
    found = motion(frames, rule, late).groupBy("machine").transformWithStateInPandas(_Clips(asdict(rule)), _clip_schema(frames), "Append", "EventTime", eventTimeColumnName="end")
    return _named(found, rule)


def clips_of(frames: DataFrame, rule: Sessions = Sessions()) -> DataFrame:  # noqa: B008
    """The same of a table: recordings are folded from times and motion alone, then their frames are gathered."""
    return gathered(monitor.recordings_of(extract.moving(frames, rule).select("machine", "ts", "active"), rule), frames, rule)


def gathered(recordings: DataFrame, frames: DataFrame, rule: Sessions = Sessions()) -> DataFrame:  # noqa: B008
    """The clips of recordings (see `monitor.recordings_of`) with their frames.

    Each recording explodes the numbers of its frames, which are joined with those of the machine's frames in order
    of time, and by their times with the frames, so pixels move once to be compared and once to be put together:
    sorted by clip and number they are folded row by row, and only the clip at hand is in memory.
    """
    numbers = frames.select("machine", "ts", (F.row_number().over(Window.partitionBy("machine").orderBy("ts")) - 1).cast("long").alias("number"))
    wanted = recordings.select("machine", "start", "end", "n", "first_frame", "last_frame", F.explode(F.sequence("first_frame", "last_frame")).alias("number"))
    shots = wanted.join(numbers, ["machine", "number"]).join(frames.select("machine", "ts", "h", "w", "pixels"), ["machine", "ts"])
    schema = _clip_schema(frames)
    arrow, names = to_arrow_schema(schema), ["machine", "start", "end", "n", "first_frame", "last_frame"]

    def clip(head: list, held: list[tuple], size: tuple[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([*head, *size, joined(held, size)], arrow, strict=True)], schema=arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, size = None, [], (0, 0)
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in [*names, "h", "w", "pixels", "trigger"]], strict=True):
                if head != list(row[:6]):
                    if head is not None:
                        yield clip(head, held, size)
                    head, held = list(row[:6]), []
                held.append(row[6:9])
                if row[9]:
                    size = row[6:8]
        if head is not None:
            yield clip(head, held, size)

    ordered = shots.repartition("machine", "start").sortWithinPartitions("machine", "start", "number")
    # recordings have their times as numbers of seconds that are rounded to microseconds
    trigger = F.abs(seconds(F.col("ts")) - seconds(F.col("start"))) < 1e-6
    return _named(ordered.select(*names, "h", "w", "pixels", trigger.alias("trigger")).mapInArrow(fold, schema), rule)


@dataclass(frozen=True)
class Models:
    """What clips are judged by: the schedule (a row of `schedule.fit` as a dictionary), the scaler's parameters, and for each detector its score and threshold."""

    schedule: dict
    scaler: dict
    detectors: dict[str, tuple[Callable[[DataFrame], DataFrame], float]] = field(default_factory=dict)
    votes: int = VOTES
    features: Sequence[str] = LIVE_FEATURES
    selected: Sequence[str] = SELECTED


def by_column(name: str, score: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn(f"score_{name}", score)


_CARRIED = ("machine", "start", "n", "lost_s")


def judged(found: DataFrame, models: Models, profile: Profile = LIVE) -> DataFrame:
    """Clips, a stream, with features (and the seconds they took) and the schedule's anomalies; rejected ones have neither, and leave the schedule's state as it was."""
    taken = extract.extract_clips(found, models.features, profile, keep=_CARRIED, timed=True)
    rows = taken.select("*", F.col("file").alias("id"), F.col("start").alias("ts"), F.when(F.col("status") == "OK", F.col("pump_dur_s")).alias("duration"))
    return monitor.checked(rows, models.schedule, keep=taken.columns[1:]).drop("id")


def scaled(rows: DataFrame, models: Models) -> DataFrame:
    """Of clips that weren't rejected: file and the selected features, scaled as the detectors know them."""
    return prep.transform(prep.live_vector(rows.where("status = 'OK'"), models.selected), models.scaler)


def voted(vectors: DataFrame, models: Models) -> DataFrame:
    """file, and the score and flag of each detector, vote_count and flag_vote."""
    out = vectors
    for name, (score, threshold) in models.detectors.items():
        out = score(out).withColumn(f"flag_{name}", evaluation.flag(F.col(f"score_{name}"), threshold))
    out = evaluation.with_votes(out, list(models.detectors), models.votes)
    return out.select("file", *[c for m in models.detectors for c in (f"score_{m}", f"flag_{m}")], "vote_count", "flag_vote")


def run(frames: DataFrame, models: Models, path: str, checkpoint: str, rule: Sessions = Sessions(), profile: Profile = LIVE, late: str = "10 seconds"):  # noqa: B008
    """Starts the query over all that is there: JSON rows of results in `path`/results and a CSV log of timings in `path`/perf, a folder for each batch.

    The log has each clip's own seconds of features, and those that its batch took for scaling, for votes and in all:
    the steps of a batch are made one after the other. A batch that runs again writes over its own folders.
    """

    def write(batch: DataFrame, n: int) -> None:
        marks, held = [time.perf_counter()], []

        def made(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            held[-1].count()
            marks.append(time.perf_counter())
            return held[-1]

        try:
            rows = made(batch)
            vectors = made(scaled(rows, models))
            votes = made(voted(vectors, models))
            rounded(rows.drop("features_s").join(votes, "file", "left")).write.mode("overwrite").json(f"{path}/results/batch={n}")
            spent = {"total_s": marks[3] - marks[0], "scale_s": marks[2] - marks[1], "vote_s": marks[3] - marks[2]}
            timed = rows.where("status = 'OK'").select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("file").alias("file_name"), F.lit(spent["total_s"]).alias("total_s"), "features_s", *[F.lit(spent[c]).alias(c) for c in ("scale_s", "vote_s")])
            write_csv(rounded(timed, 3), f"{path}/perf/batch={n}")
        finally:
            for df in held:
                df.unpersist()

    stream = judged(clips(frames, rule, late), models, profile)
    return stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
