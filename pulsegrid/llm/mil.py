"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE bytes. Each is encoded from the frequencies of its byte-class
pairs and the share of words that repeat the word before; gated attention weighs the encodings, and a
logistic layer scores their weighted sum. Encoder, attention and output are learned together from
document labels only. A null or empty text is one empty passage, and is scored like any other.

Equal texts have equal scores; repeated rows and ids are rows of their own, and an empty table gives none.
Without labels all scores are 0.5, with labels of one kind that kind. `score` reads id and text alone, and
`keep_good` gives rows back as they are, so no name of a column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import BLOCK, _piece_words, blocks, bounded_sample, held_out, text_buffer

PASSAGE = 512
#: Labelled rows that a model is fitted on at most (a documented bound), and the longest text among them in characters.
FIT_ROWS, FIT_CHARS = 2000, 100_000
_CLASSES = 16


def _byte_classes() -> np.ndarray:
    out = np.full(256, 14, np.uint8)
    for k, chars in enumerate((" \t\v\f", "\n\r", "", "", "", ".", ",;:", "!?", "|", "#*$%&", "<>", "-_/\\+=~^@`", "", "", "", "\"'()[]{}")):
        out[[ord(c) for c in chars]] = k
    out[97:123], out[65:91], out[48:58], out[192:], out[128:192] = 2, 3, 4, 12, 13
    return out


_CLASS = _byte_classes()
WIDTH = _CLASSES * _CLASSES + 2


def passages(raw: np.ndarray, offsets: np.ndarray, limit: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the rows, and how many passages each row has (one at least). limit: bytes of rows that are taken together."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    out = np.zeros((int(counts.sum()), WIDTH), np.float32)
    first = np.cumsum(counts) - counts
    pieces = []  # (start, end, first passage, cuts between rows)
    for lo, hi in blocks(offsets, limit):
        if hi - lo == 1:
            for at in range(int(offsets[lo]), int(offsets[hi]), BLOCK // PASSAGE * PASSAGE):
                pieces.append((lo, hi, at, min(at + BLOCK // PASSAGE * PASSAGE, int(offsets[hi]))))
        else:
            pieces.append((lo, hi, int(offsets[lo]), int(offsets[hi])))
    for lo, hi, start, end in pieces:
        if end == start:
            continue
        piece = raw[start:end]
        row = np.repeat(np.arange(lo, hi), np.minimum(offsets[lo + 1 : hi + 1], end) - np.maximum(offsets[lo:hi], start))
        inside = np.arange(start, end) - offsets[row]
        of = first[row] + inside // PASSAGE
        base, n = int(of[0]), int(of[-1] - of[0]) + 1
        kind = _CLASS[piece].astype(np.int64)
        local = of - base
        pair = local[:-1] * (_CLASSES * _CLASSES) + kind[:-1] * _CLASSES + kind[1:]
        got = np.bincount(pair[local[:-1] == local[1:]], minlength=n * _CLASSES * _CLASSES).reshape(n, -1)
        length = np.bincount(local, minlength=n)
        out[base : base + n, :-2] = np.sqrt(got / np.maximum(length, 1)[:, None])
        cuts = offsets[lo:hi] - start
        starts, words = _piece_words(piece, np.unique(cuts[(cuts > 0) & (cuts < len(piece))]))
        if len(words):
            at = local[starts]
            again = np.zeros(len(words))
            again[1:] = (words[1:] == words[:-1]) & (at[1:] == at[:-1])
            n_words = np.bincount(at, minlength=n)
            out[base : base + n, -2] = np.bincount(at, again, minlength=n) / np.maximum(n_words, 1)
            out[base : base + n, -1] = n_words / np.maximum(length, 1)
    return out, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """prior: the score where there is nothing to learn from (no labels, or one label only)."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w, at = self.weights, np.cumsum(counts) - counts
        h = np.tanh(x @ w["enc"] + w["enc0"])
        gate, value = _sigmoid(h @ w["gate"]), np.tanh(h @ w["att"])
        e = (gate * value) @ w["out"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
        a = e / np.repeat(np.add.reduceat(e, at), counts)
        z = np.add.reduceat(h * a[:, None], at, axis=0)
        return {"h": h, "gate": gate, "value": value, "a": a, "z": z, "p": _sigmoid(z @ w["cls"] + w["cls0"][0])}

    def scores(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(counts), self.prior)
        return self._forward((features - self.mean) / self.scale, counts)["p"]


def fit(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int = 120, rate: float = 0.02, hidden: int = 16, gates: int = 8, seed: int = 7) -> Model:
    """Adam on the log loss of the documents, all at once, from a fixed start."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(float(labels[0]) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 0.02
    x = ((features - mean) / scale).astype(np.float64)
    w = {
        "enc": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "enc0": np.zeros(hidden),
        "att": rng.normal(0, 0.3, (hidden, gates)), "gate": rng.normal(0, 0.3, (hidden, gates)), "out": rng.normal(0, 0.3, gates),
        "cls": rng.normal(0, 0.3, hidden), "cls0": np.zeros(1),
    }
    model = Model(float(labels.mean()), mean, scale, w)
    at = np.cumsum(counts) - counts
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    for t in range(1, epochs + 1):
        f = model._forward(x, counts)
        d = (f["p"] - labels) / len(labels)
        dz = np.repeat(d[:, None] * w["cls"], counts, axis=0)
        dot = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (dot - np.repeat(np.add.reduceat(f["a"] * dot, at), counts))
        dgv = de[:, None] * w["out"]
        dvalue, dgate = dgv * f["gate"] * (1 - f["value"] ** 2), dgv * f["value"] * f["gate"] * (1 - f["gate"])
        dh = (dz * f["a"][:, None] + dvalue @ w["att"].T + dgate @ w["gate"].T) * (1 - f["h"] ** 2)
        g = {
            "enc": x.T @ dh + 1e-4 * w["enc"], "enc0": dh.sum(axis=0), "att": f["h"].T @ dvalue, "gate": f["h"].T @ dgate,
            "out": (f["gate"] * f["value"]).T @ de, "cls": f["z"].T @ d, "cls0": np.array([d.sum()]),
        }
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 7) -> Model:
    """Fits on a bounded sample, chosen by a hash of the id, of the labelled rows outside the held-out fold.

    Of several labels of one id the largest counts, of several texts the first in order; null labels count as none.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = bounded_sample(known.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where(F.coalesce(F.char_length("text"), F.lit(0)) <= FIT_CHARS)
    got = sorted(rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect(), key=lambda r: r[0])
    raw, offsets = text_buffer(pa.array([r[2] for r in got], pa.string()))
    # in small pieces, as the driver's memory is
    features, counts = passages(raw, offsets, BLOCK // 16) if got else (np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64))
    return fit(features, counts, np.array([r[1] for r in got], np.float64), seed=seed)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id and `score`, 0 to 1. Rows are scored alone, in place; nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            out = np.empty(batch.num_rows)
            for lo, hi in blocks(offsets, 4 * BLOCK):
                out[lo:hi] = model.scores(*passages(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(out, 6))], [id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs that score `least` or more, with docs' own columns. Scored and filtered in one pass, without a join."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            raw, offsets = text_buffer(batch.column(at))
            out = np.empty(batch.num_rows)
            for lo, hi in blocks(offsets, 4 * BLOCK):
                out[lo:hi] = model.scores(*passages(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            yield batch.filter(pa.array(np.round(out, 6) >= least))

    return docs.mapInArrow(run, docs.schema)
