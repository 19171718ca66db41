"""Language identification by a convolutional network over bytes.

A text is cut into windows of WINDOW bytes (the last padded with zeros). Filters of several widths,
each a table of weights by place and byte, are applied everywhere in a window; their largest values,
rectified, go to a softmax. A text's probabilities are its windows' mean, weighted by their bytes.

Null and empty texts and those without a letter are `und` with score 0. Of languages of equal probability the
first by name is taken. Texts of an id and language that is repeated are one when a model is fitted. Rows are told each for itself, repeated ones and ids too; an empty table gives none,
and one without languages a model that says `und`. Long texts are read whole, window by window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import held_out, text_buffer, written

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
#: Texts of each language that a model is fitted on at most, and of all languages together as long as there are no more languages than
#: that (documented bounds), and the characters taken from a seeded place of each.
FIT_ROWS, FIT_TOTAL, FIT_CHARS = 400, 40_000, 1024


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    filters: list[list[np.ndarray]] = field(default_factory=list)  # by width, then place: (256, FILTERS)
    bias: np.ndarray | None = None
    dense: np.ndarray | None = None
    dense0: np.ndarray | None = None

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter in each window, and where it stands."""
        top, where = [], []
        for tables in self.filters:
            reach = windows.shape[1] - len(tables) + 1
            x = tables[0][windows[:, :reach]]
            for j in range(1, len(tables)):
                x += tables[j][windows[:, j : j + reach]]
            k = x.argmax(axis=1)
            where.append(k)
            top.append(np.take_along_axis(x, k[:, None, :], axis=1)[:, 0])
        return np.concatenate(top, axis=1) + self.bias, np.concatenate(where, axis=1)

    def highest(self, windows: np.ndarray) -> np.ndarray:
        top = []
        for tables in self.filters:
            reach = windows.shape[1] - len(tables) + 1
            x = tables[0][windows[:, :reach]]
            for j in range(1, len(tables)):
                x += tables[j][windows[:, j : j + reach]]
            top.append(x.max(axis=1))
        return np.concatenate(top, axis=1) + self.bias

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = np.maximum(self.highest(windows), 0) @ self.dense + self.dense0
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def cut(raw: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the rows first to last, each window's row and how many bytes it holds."""
    sizes = np.diff(offsets[first : last + 1])
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(first, last), counts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offsets[row] + k * WINDOW
    held = np.minimum(WINDOW, offsets[row + 1] - at)
    index = at[:, None] + np.arange(WINDOW)
    windows = raw[np.minimum(index, len(raw) - 1)] * (np.arange(WINDOW) < held[:, None])
    return windows.astype(np.uint8), row, held


def fit(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 14, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Model:
    """Adam on the log loss; the gradient of a filter reaches the bytes where it was largest."""
    rng = np.random.default_rng(seed)
    n, c = FILTERS * len(WIDTHS), len(langs)
    model = Model(langs, [[rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS], np.zeros(n, np.float32), rng.normal(0, 0.1, (n, c)).astype(np.float32), np.zeros(c, np.float32))
    params = [t for tables in model.filters for t in tables] + [model.bias, model.dense, model.dense0]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, y = windows[pick], labels[pick]
            top, where = model.pooled(x)
            act = np.maximum(top, 0)
            logits = act @ model.dense + model.dense0
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            d = (p @ model.dense.T) * (top > 0)
            grads, rows = [], np.arange(len(y))[:, None]
            for i, w in enumerate(WIDTHS):
                part, place = d[:, i * FILTERS : (i + 1) * FILTERS], where[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    g = np.zeros((256, FILTERS), np.float32)
                    np.add.at(g, (x[rows, place + j], np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
            grads += [d.sum(axis=0), act.T @ p, p.sum(axis=0)]
            t += 1
            for i, (q, g) in enumerate(zip(params, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                q -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def fit_texts(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_total: int = FIT_TOTAL, seed: int = 3) -> DataFrame:
    """doc_id, lang and FIT_CHARS characters of the texts that a model is fitted on: of each language the same number of ids, those of the least hashes, outside the held-out fold.

    Of several rows of an id and language one text is taken, the first in order. Every language has one text at least, however many there are.
    """
    able = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 50))
    counts = written(able.select("lang", "doc_id").distinct().groupBy("lang").count(), "languages")
    wanted = min(fit_rows, max(fit_total // max(counts.count(), 1), 1))
    # some more are chosen by their hash alone, then ordered, so each language's order is that of a bounded number of rows
    share = counts.select("lang", (F.lit(2.0 * wanted + 20) / F.col("count")).alias("share"))
    start = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.greatest(F.char_length("text") - FIT_CHARS + 1, F.lit(1))).cast("int") + 1
    some = able.join(share, "lang").where(draw < F.col("share") * (1 << 50)).select("doc_id", "lang", F.substr("text", start, F.lit(FIT_CHARS)).alias("text"))
    some = some.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id"))
    return some.withColumn("_place", place).where(F.col("_place") <= wanted).select("doc_id", "lang", "text")


def train(docs: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 3, fit_total: int = FIT_TOTAL) -> Model:
    """Fits on `fit_texts`. All languages are told apart: a model has a column of weights for each.

    Some windows are cut short, so that short texts are known too. No labelled text: a model without languages.
    """
    got = sorted(fit_texts(docs, fit_rows, fit_total, seed).collect())
    got = [r for r in got if has_letter(r[2])]
    langs = sorted({r[1] for r in got})
    if not langs:
        return Model([])
    raw, offsets = text_buffer(pa.array([r[2] for r in got], pa.string()))
    windows, row, held = cut(raw, offsets, 0, len(got))
    rng = np.random.default_rng(seed)
    short = np.where(rng.random(len(windows)) < 0.25, rng.integers(12, WINDOW, len(windows)), WINDOW)
    windows = windows * (np.arange(WINDOW) < short[:, None])
    keep = held >= 12
    return fit(windows.astype(np.uint8)[keep], np.array([langs.index(got[i][1]) for i in row])[keep], langs, seed=seed)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at_once: int = 64) -> DataFrame:
    """Per row: its id, `lang_pred` and `score`. Null texts and texts without a letter: `und`, 0. Nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            n, c = batch.num_rows, max(1, len(model.langs))
            lettered = np.array([has_letter(batch.column(1)[i].as_py()) for i in range(n)], bool)
            sums = np.zeros((n, c))
            if model.langs and len(raw):
                row_at = 0
                while row_at < n:
                    end = max(row_at + 1, int(np.searchsorted(offsets, offsets[row_at] + WINDOW * at_once * 16, side="right")) - 1)
                    end = min(end, n)
                    windows, row, held = cut(raw, offsets, row_at, end)
                    for k in range(0, len(windows), at_once):
                        p = model.probabilities(windows[k : k + at_once]).astype(np.float64)
                        np.add.at(sums, row[k : k + at_once], p * held[k : k + at_once, None])
                    row_at = end
            total = sums.sum(axis=1)
            best = sums.argmax(axis=1)
            known = lettered & (total > 0)
            share = np.where(known, sums[np.arange(n), best] / np.maximum(total, 1e-12), 0.0)
            names = [model.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.round(share, 6))], [id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
