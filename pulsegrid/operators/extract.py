"""Clips to signals and features: one row of a clip per task step, never a pixel per row."""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.config import EPS, FEATURES, LOG_EPS, OFFLINE, Profile, Sessions
from pulsegrid.functions import kernels as K


def _cv(x: np.ndarray) -> float:
    return float(x.std() / (x.mean() + EPS)) if len(x) else 0.0


def spectral(x: np.ndarray, fps: float, p: Profile) -> dict[str, float]:
    f, psd = K.welch(x, fps, min(512, len(x) // 4))
    band = (f >= p.low_hz) & (f <= p.high_hz)
    dom = lo = hi = 0.0
    if band.any():
        fb, pb = f[band], psd[band]
        top = int(pb.argmax())
        low = np.flatnonzero(pb < pb[top] / 2)
        a, b = low[low < top], low[low > top]
        width = max(fb[b[0] if len(b) else -1] - fb[a[-1] if len(a) else 0], 0.2 * fb[top])
        dom, lo, hi = float(fb[top]), float(fb[top] - width), float(fb[top] + width)
    power, freq = np.abs(np.fft.rfft(x - x.mean())) ** 2, np.fft.rfftfreq(len(x), 1 / fps)
    wide, own, second = ((freq >= a) & (freq <= b) for a, b in ((p.low_hz, p.high_hz), (lo, hi), (1.8 * dom, 2.2 * dom)))
    amplitude = np.sqrt(power[wide])
    share = psd[band] / (psd[band].sum() + EPS)
    size, step = int(fps * p.window_s), int(fps * p.step_s)
    tops = np.zeros(0)
    if len(x) >= size > 0:
        parts = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
        spectra, freqs = np.abs(np.fft.rfft(parts - parts.mean(axis=1, keepdims=True), axis=1)), np.fft.rfftfreq(size, 1 / fps)
        inside = (freqs >= p.low_hz) & (freqs <= p.high_hz)
        tops = freqs[inside][spectra[:, inside].argmax(axis=1)] if inside.any() else np.zeros(len(parts))
    return {
        "dominant_freq_hz": dom,
        "spectral_power_in_band": float(power[own].sum() / (power[wide].sum() + EPS)),
        "spectral_snr": float(amplitude.max() / (np.median(amplitude) + EPS)) if len(amplitude) else 0.0,
        "spectral_entropy": float(-(share * np.log(share + LOG_EPS)).sum()),
        "harmonic2_ratio": float(power[second].sum() / (power[own].sum() + EPS)),
        "freq_stability_std": float(tops.std()) if len(tops) else 0.0,
    }


def strokes(x: np.ndarray, fps: float, p: Profile) -> tuple[dict[str, float], np.ndarray]:
    distance = max(1, int(p.peak_distance_s * fps))
    tops, lows = K.peaks(x, distance, p.peak_prominence * x.std()), K.peaks(-x, distance)
    after = np.searchsorted(lows, tops, side="right")
    before = np.searchsorted(lows, tops, side="left") - 1
    has_b, has_a = before >= 0, after < len(lows)
    rise, fall = (tops[has_b] - lows[before[has_b]]) / fps * 1000, (lows[after[has_a]] - tops[has_a]) / fps * 1000
    both = has_b & has_a
    height = x[tops[both]] - np.minimum(x[lows[before[both]]], x[lows[after[both]]])
    known = len(rise) > 0 and len(fall) > 0
    return {
        "interval_cv": _cv(np.diff(tops) / fps * 1000),
        "stroke_amp_cv": _cv(height),
        "rise_fall_ratio": float(rise.mean() / (fall.mean() + EPS)) if known else 0.0,
        "rise_time_cv": _cv(rise) if known else 0.0,
        "fall_time_cv": _cv(fall) if known else 0.0,
    }, tops


def regularity(x: np.ndarray, tops: np.ndarray, dom: float, fps: float) -> dict[str, float]:
    lag = int(round(fps / dom)) if dom > 0 else 3
    out = dict.fromkeys(("autocorr_at_period", "phase_portrait_eccentricity", "cycle_shape_cv", "cycle_corr_mean"), 0.0)
    if 0 < lag < len(x) - 1:
        a, b = x[:-lag], x[lag:]
        out["autocorr_at_period"] = K.correlation(a, b)
        eigen = np.linalg.eigvalsh(np.cov(a, b))
        out["phase_portrait_eccentricity"] = float(np.sqrt(max(0.0, 1 - eigen[0] / (eigen[1] + EPS))))
    if len(tops) > 4 and dom > 0:
        cycles = [x[a:b] for a, b in zip(tops[:-1], tops[1:], strict=True) if b - a > 3]
        if len(cycles) > 3:
            shape = np.array([np.interp(np.linspace(0, 1, lag), np.linspace(0, 1, len(c)), c) for c in cycles])
            out["cycle_shape_cv"] = float(shape.std(axis=0).mean() / (shape.mean(axis=0).mean() + EPS))
            out["cycle_corr_mean"] = float(np.mean([K.correlation(a, b) for a, b in zip(shape[:-1], shape[1:], strict=True)]))
    out["envelope_cv"] = _cv(K.envelope(x - x.mean()))
    out["motion_cv"] = _cv(x)
    return out


def signal_features(clip: Mapping[str, Any], fps: float, features: Sequence[str] = FEATURES, p: Profile = OFFLINE) -> dict[str, float]:
    """Of a clip's signals in order (diff, and top, bot, left, right, flow where they are): the wanted features; others are 0."""
    clip = {c: np.asarray(clip[c], float) for c in ("diff", "top", "bot", "left", "right", "flow") if c in clip}
    x = clip["diff"]
    out = dict.fromkeys(features, 0.0)
    if len(x) < 8:
        return out
    got = spectral(x, fps, p)
    more, tops = strokes(x, fps, p)
    got |= more | regularity(x, tops, got["dominant_freq_hz"], fps)
    for name, a, b in (("top_bot_corr", "top", "bot"), ("left_right_corr", "left", "right")):
        if a in clip and b in clip:
            got[name] = K.correlation(clip[a][1:], clip[b][1:])
    if "flow" in clip and "flow_dom_freq" in features:
        f, psd = K.welch(clip["flow"][1:], fps, min(512, len(x) // 4))
        inside = (f >= 7) & (f <= 14)
        got["flow_dom_freq"] = float(f[inside][psd[inside].argmax()]) if inside.any() else 0.0
        got["freq_flow_diff"] = abs(got["dominant_freq_hz"] - got["flow_dom_freq"])
    return {f: got.get(f, 0.0) for f in features}


def extract_signals(signals: DataFrame, key: str = "clip_id", order: str = "i", fps: float = 30.0, features: Sequence[str] = FEATURES, profile: Profile = OFFLINE) -> DataFrame:
    """signals in long form (key, order, diff, ...) to a row of features for each clip."""
    kind = signals.schema[key].dataType.simpleString()

    def run(clip: pd.DataFrame) -> pd.DataFrame:
        clip = clip.sort_values(order)
        return pd.DataFrame([{key: clip[key].iloc[0], **signal_features(clip, fps, features, profile)}])

    return signals.groupBy(key).applyInPandas(run, f"`{key}` {kind}, " + ", ".join(f"{f} double" for f in features))


def extract_arrays(df: DataFrame, key: str, samples: str, fps: float = 30.0, features: Sequence[str] = FEATURES, profile: Profile = OFFLINE) -> DataFrame:
    """The same of signals that come as an array in each row: rows stay where they are. Null arrays have no samples."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [signal_features({"diff": np.array(x.as_py() or [], float)}, fps, features, profile) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[f] for g in got], pa.float64()) for f in features]], [key, *features])

    return df.select(key, F.col(samples).cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{f} double" for f in features))


def grayed(frames: DataFrame) -> DataFrame:
    """Frames or clips (h, w, pixels and others) whose pixels are blue, green and red bytes, with gray ones, as all operators here take them.

    Null pixels stay null, and those that aren't a whole number of h * w colours become null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = batch.schema.get_field_index("pixels"), []
            for h, w, pixels in zip(*[batch.column(c).to_pylist() for c in ("h", "w", "pixels")], strict=True):
                whole = pixels is not None and h and w and len(pixels) % (3 * h * w) == 0
                out.append(K.gray(np.frombuffer(pixels, np.uint8).reshape(-1, 3)).tobytes() if whole else None)
            columns = batch.columns
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return frames.mapInArrow(run, frames.schema)


def in_motion(before: tuple[int, int, bytes | None] | None, now: tuple[int, int, bytes | None], rule: Sessions) -> bool:
    """Whether least_pixels or more changed between two gray frames (h, w, pixels). Without a frame before, without pixels, or of another size: no."""
    if before is None or now[2] is None or before[2] is None or now[:2] != before[:2]:
        return False
    h, w, _ = now
    soft = K.blur(np.stack([np.frombuffer(x, np.uint8).reshape(h, w) for x in (before[2], now[2])])).astype(int)
    return bool(K.majority(np.abs(soft[1] - soft[0]) > rule.on_off_threshold).sum() >= rule.least_pixels)


def moving(frames: DataFrame, rule: Sessions = Sessions(), order: Sequence[str] = ("ts",)) -> DataFrame:  # noqa: B008
    """frames (machine, h, w, pixels: the gray region, and the columns of `order`) with `active`: whether least_pixels or more changed since the machine's frame before.

    Only a frame and the one before meet in a row. A machine's first frame, and one of another size, is not active.
    """
    before = F.lag(F.struct("h", "w", "pixels")).over(Window.partitionBy("machine").orderBy(*order))
    pairs = frames.withColumn("_before", before)
    names = [c for c in frames.columns if c != "pixels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c).to_pylist() for c in ("h", "w", "pixels", "_before")]
            active = [in_motion(last and (last["h"], last["w"], last["pixels"]), (h, w, pixels), rule) for h, w, pixels, last in zip(*own, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(active, pa.bool_())], [*names, "active"])

    kind = T.StructType([*[frames.schema[c] for c in names], T.StructField("active", T.BooleanType())])
    return pairs.select(*names, "pixels", "_before").mapInArrow(run, kind)


def clip_signals(frames: np.ndarray, fps: float, p: Profile = OFFLINE, box: tuple[int, int, int, int] | None = None) -> tuple[str, dict[str, object]]:
    """Status (OK, TOO_SHORT, BLURRY, NO_PUMP), and of the running part of gray frames [n, h, w] the signals and spatial features.

    box: x1, y1, x2, y2 of the region, which is cut out of the whole frames after they are blurred; None if frames are the region.
    """
    inside = (slice(None), slice(None)) if box is None else (slice(box[1], box[3]), slice(box[0], box[2]))
    n = len(frames)
    if n < p.least_frames:
        return "TOO_SHORT", {}
    own = frames[:, *inside]
    h, w = own.shape[1:]
    if not h or not w:
        return "NO_REGION", {}
    sharp = float(np.mean([K.sharpness(f) for f in own[:: p.sharpness_every]]))
    if sharp < p.least_sharpness:
        return "BLURRY", {"sharpness": sharp}
    soft = np.concatenate([K.blur(frames[k : k + 64])[:, *inside] for k in range(0, n, 64)])
    moved = np.zeros(n)
    for i in range(1, n):
        moved[i] = K.majority(np.abs(soft[i].astype(int) - soft[i - 1]) > p.on_off_threshold).sum()
    active = moved >= max(10, int(p.active_share * h * w))
    runs = np.convolve(active, np.ones(p.persist, int), "valid") == p.persist if n >= p.persist else np.zeros(0, bool)
    if not runs.any() or np.flatnonzero(active)[-1] <= int(runs.argmax()):
        return "NO_PUMP", {"sharpness": sharp}
    start, end = int(runs.argmax()), int(np.flatnonzero(active)[-1])
    sample = soft[n // 4 : n // 4 + 30]
    threshold = max(p.least_threshold, int(sample.mean() * p.threshold_factor))
    own = soft[start : end + 1].astype(np.float32)
    variance = own.var(axis=0)
    mask = variance > variance.mean() * p.mask_factor
    step = np.abs(np.diff(own, axis=0))
    lead = lambda x: np.append(0.0, x)
    diff = lead(np.array([K.majority(d > threshold)[mask].sum() for d in step]) / max(1, int(mask.sum())))
    sides = {"top": step[:, : h // 2], "bot": step[:, h // 2 :], "left": step[:, :, : w // 2], "right": step[:, :, w // 2 :]}
    signals = {"diff": diff} | {k: lead(v.mean(axis=(1, 2))) for k, v in sides.items()}
    quarters = [step[:, a, b] for a in (slice(0, h // 2), slice(h // 2, h)) for b in (slice(0, w // 2), slice(w // 2, w))]
    spatial = {"quadrant_cv_max": max(_cv(q.mean(axis=(1, 2))) for q in quarters), "active_roi_fraction": float(mask.mean())}
    a, b = mask[:, : w // 2].any(axis=0), mask[:, w // 2 :].any(axis=0)
    if a.any() and b.any():
        spatial["left_right_corr"] = K.correlation(own[:, :, : w // 2][:, :, a].mean(axis=(1, 2)), own[:, :, w // 2 :][:, :, b].mean(axis=(1, 2)))
    return "OK", {"sharpness": sharp, "start": start, "end": end, "signals": pd.DataFrame(signals), "spatial": spatial}


def extract_clips(clips: DataFrame, features: Sequence[str] = FEATURES, profile: Profile = OFFLINE, keep: Sequence[str] = (), timed: bool = False) -> DataFrame:
    """clips: file, fps, h, w, pixels (gray frames after each other) to a row for each clip, rejected ones too, with their status.

    keep: further columns that are carried along. timed: with features_s, the seconds that the clip took.

    Frames are whole where clips have the columns roi_x1, roi_y1, roi_x2, roi_y2, else the region alone. A
    clip is a row and its frames stay in one task step; clips are spread over tasks as they are read.
    """
    region = [c for c in ("roi_x1", "roi_y1", "roi_x2", "roi_y2") if c in clips.columns]
    kept = T.StructType([clips.schema[c] for c in keep] + [T.StructField("features_s", T.DoubleType())] * timed)
    schema = "file string, status string, pump_start_s double, pump_end_s double, pump_dur_s double, sharpness double, " + ", ".join(f"{f} double" for f in features)
    schema = T.StructType([*kept.fields, *T.StructType.fromDDL(schema).fields])

    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                began = time.perf_counter()
                fps = row.fps if row.fps and row.fps > 0 else profile.fps
                frames = np.frombuffer(row.pixels or b"", np.uint8).reshape(-1, row.h, row.w)
                box = [getattr(row, c) for c in region]
                status, got = clip_signals(frames, fps, profile, tuple(map(int, box)) if len(box) == 4 and not any(pd.isna(b) for b in box) else None)
                out = {"file": row.file, "status": status, "sharpness": got.get("sharpness"), "pump_start_s": None, "pump_end_s": None, "pump_dur_s": None, **dict.fromkeys(features)}
                if status == "OK":
                    values = signal_features(got["signals"], fps, features, profile) | {k: v for k, v in got["spatial"].items() if k in features}
                    out |= {"pump_start_s": round(got["start"] / fps, 2), "pump_end_s": round(got["end"] / fps, 2), "pump_dur_s": round((got["end"] - got["start"]) / fps, 2)} | {k: round(v, 6) for k, v in values.items()}
                out |= {c: getattr(row, c) for c in keep} | ({"features_s": time.perf_counter() - began} if timed else {})
                yield pd.DataFrame([out])[kept.names + [c for c in out if c not in kept.names]]

    return clips.select("file", "fps", "h", "w", "pixels", *region, *keep).mapInPandas(run, schema)
