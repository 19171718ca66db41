"""Quality rules over lines: a linear-chain conditional random field marks content and boilerplate.

A text's lines that have a word are labelled by Viterbi decoding; the share of words that stand in
content lines decides whether a text that passes the base rules is kept. Only documents are labelled:
a good one's lines are content; of a bad one's, those that a logistic model of single lines takes for
boilerplate are, the most likely one always. The field is trained on these labels.

A null or empty text has no words and fails the base rules; so do texts of under 50 words and those where
over half the words repeat. Of label sequences of equal score the one with content, looked at from the last
line on, is taken. Rows are judged each for itself, repeated ones and ids too; an empty table gives none, and
one without labels a field by which all lines are content. Only id and text are read, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import AS_IS, WHITE, blocks, bounded_sample, held_out, mix64, text_buffer, words_at

#: Labelled rows that the field is fitted on at most (a documented bound), the longest text among them in characters, lines of a training sequence.
FIT_ROWS, FIT_CHARS, FIT_LINES = 2000, 100_000, 64
#: A text is kept if content lines hold this share of its words.
LEAST_CONTENT = 0.5
MIN_WORDS, MAX_REPEATED = 50, 0.5

_WHITE_BYTES = WHITE.encode()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _PIPE, _SHOUT, _DIGIT, _UPPER, _STOP = _mask("#*$%&|<>"), _mask("|"), _mask("!"), _mask("0123456789"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask(".?!:")
_SOLID = ~_mask(WHITE)
_POINT = np.ones(256, bool)
_POINT[128:192] = False
WIDTH = 12


@dataclass
class Measured:
    """Of some rows: base counts, and features, words and number of the lines that have a word."""

    base: dict[str, np.ndarray]
    features: np.ndarray
    words: np.ndarray
    lines: np.ndarray


def measure(raw: np.ndarray, offsets: np.ndarray) -> Measured:
    n = len(offsets) - 1
    starts, words, bounds = words_at(raw, offsets, AS_IS)
    row_of_word = np.repeat(np.arange(n), np.diff(bounds))
    repeated = _in_repeated_windows(words, row_of_word)
    # lines: a new one after each \\n and at each row; empty rows have none
    breaks = np.flatnonzero(raw == 10) + 1
    first = np.unique(np.concatenate([offsets[:-1], breaks]))
    first = first[first < len(raw)]
    line_of_word = np.searchsorted(first, starts, side="right") - 1
    n_words = np.bincount(line_of_word, minlength=len(first))
    row_of_line = np.searchsorted(offsets, first, side="right") - 1
    ends = np.append(first[1:], len(raw))
    twice = np.zeros(len(first), bool)
    seen: set[bytes] = set()
    last, data = -1, raw.tobytes()
    for k in np.flatnonzero(n_words):
        if row_of_line[k] != last:
            last, seen = row_of_line[k], set()
        line = data[first[k] : ends[k]]
        line = line.removesuffix(b"\n")
        if line in seen:
            twice[k] = True
        else:
            seen.add(line)

    def tally(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask[raw], dtype=np.int64))
        return sums[ends] - sums[first]

    solid = np.append(0, np.cumsum(_SOLID[raw] & _POINT[raw], dtype=np.int64))
    symbols = np.append(0, np.cumsum(_SYMBOL[raw], dtype=np.int64))
    base = {
        "n_words": np.diff(bounds),
        "word_chars": solid[offsets[1:]] - solid[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(row_of_line[twice], minlength=n),
        "n_repeat_words": np.bincount(row_of_word[repeated], minlength=n),
    }
    per_word, chars = np.maximum(n_words, 1), np.maximum(solid[ends] - solid[first], 1)
    x = np.zeros((len(first), WIDTH), np.float32)
    x[:, 0] = 1
    x[:, 1] = np.log1p(n_words) / 5
    x[:, 2] = tally(_SYMBOL) / per_word
    x[:, 3] = tally(_PIPE) / per_word
    x[:, 4] = tally(_SHOUT) / per_word
    x[:, 5] = tally(_UPPER) / chars
    x[:, 6] = tally(_DIGIT) / chars
    x[:, 7] = tally(_STOP) / per_word
    x[:, 8] = twice
    x[:, 9] = np.minimum(chars / per_word, 30) / 10
    x[:, 10] = np.bincount(line_of_word[repeated], minlength=len(first)) / per_word
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    x[:, 11] = np.bincount(line_of_word[same], minlength=len(first)) / per_word
    has = n_words > 0
    return Measured(base, x[has], n_words[has], np.bincount(row_of_line[has], minlength=n))


def _in_repeated_windows(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each word stands in a window of three words that its row has twice or more."""
    out = np.zeros(len(words), bool)
    if len(words) < 3:
        return out
    at = np.flatnonzero(row[2:] == row[:-2])
    h = mix64((words[at] * _STEP + words[at + 1]) * _STEP + words[at + 2])
    order = np.lexsort((h, row[at]))
    same = (h[order][1:] == h[order][:-1]) & (row[at][order][1:] == row[at][order][:-1])
    often = np.zeros(len(at), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    for j in range(3):
        out[at[often] + j] = True
    return out


@dataclass
class Field:
    """Scores: features @ weights for content against boilerplate; start and step [from, to] of the labels (0: boilerplate, 1: content)."""

    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray

    def viterbi(self, gains: np.ndarray) -> list[bool]:
        """The best labels of a sequence of lines."""
        (s0, s1), ((a, b), (c, d)) = self.start.tolist(), self.step.tolist()
        from0, from1 = [], []
        at0, at1 = s0, s1
        for i, g in enumerate(gains.tolist()):
            if i:
                p, q = at0 + a >= at1 + c, at0 + b >= at1 + d
                from0.append(p)
                from1.append(q)
                at0, at1 = (at0 + a if p else at1 + c), (at0 + b if q else at1 + d)
            at1 += g
        label = at1 >= at0
        out = [label]
        for p, q in zip(reversed(from0), reversed(from1), strict=True):
            label = not (q if label else p)
            out.append(label)
        return out[::-1]


def line_labels(features: np.ndarray, lines: np.ndarray, labels: np.ndarray, epochs: int = 300, rate: float = 0.05) -> np.ndarray:
    """A label for each line, from those of the rows. Each label has half of the weight in the model of single lines."""
    row = np.repeat(np.arange(len(lines)), lines)
    y = labels[row].astype(np.float64)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, m, v = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH)
    for t in range(1, epochs + 1):
        g = features.T @ ((y - 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))) * share) - 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gains = features @ w
    out = ((y > 0) | (gains > 0)).astype(int)
    at = np.cumsum(lines) - lines
    some = lines > 0
    least = np.minimum.reduceat(gains, at[some]) if some.any() else np.zeros(0)
    worst = np.zeros(len(lines))
    worst[some] = least
    out[(y == 0) & (gains <= worst[row])] = 0
    return out


def fit(features: np.ndarray, lines: np.ndarray, labels: np.ndarray, epochs: int = 300, rate: float = 0.05) -> Field:
    """Adam on the log likelihood of the label sequences, all at once; labels are the rows'. Long rows are cut into sequences."""
    at = np.cumsum(lines) - lines
    cuts = [(a + k, min(FIT_LINES, n - k)) for a, n in zip(at.tolist(), lines.tolist(), strict=True) for k in range(0, n, FIT_LINES)]
    w, start, step = np.zeros(WIDTH), np.zeros(2), np.zeros((2, 2))
    if not cuts or len(set(labels.tolist())) < 2:
        start[1] = 1.0 if not cuts or labels[0] else -1.0
        return Field(w, start, step)
    scale = np.maximum(features.astype(np.float64).std(axis=0), 0.02)
    scale[0] = 1
    features = features / scale
    per_line = line_labels(features, lines, labels)
    longest = max(n for _, n in cuts)
    x = np.zeros((len(cuts), longest, WIDTH))
    y = np.zeros((len(cuts), longest), int)
    length = np.array([n for _, n in cuts])
    for i, (a, n) in enumerate(cuts):
        x[i, :n], y[i, :n] = features[a : a + n], per_line[a : a + n]
    inside = np.arange(longest) < length[:, None]
    params = [w, start, step]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, epochs + 1):
        e = np.zeros((len(cuts), longest, 2))
        e[:, :, 1] = x @ w
        fw, bw = np.zeros_like(e), np.zeros_like(e)
        fw[:, 0] = start + e[:, 0]
        for k in range(1, longest):
            new = np.logaddexp(fw[:, k - 1, :1] + step[0], fw[:, k - 1, 1:] + step[1]) + e[:, k]
            fw[:, k] = np.where(inside[:, k, None], new, fw[:, k - 1])
        z = np.logaddexp(fw[:, -1, 0], fw[:, -1, 1])
        for k in range(longest - 2, -1, -1):
            to = e[:, k + 1] + bw[:, k + 1]
            bw[:, k] = np.where(inside[:, k + 1, None], np.logaddexp(step[:, 0] + to[:, :1], step[:, 1] + to[:, 1:]), 0)
        p = np.exp(fw + bw - z[:, None, None]) * inside[:, :, None]
        truth = np.stack([1 - y, y], axis=2) * inside[:, :, None]
        g_w = np.einsum("ijk,ij->k", x, truth[:, :, 1] - p[:, :, 1]) / len(cuts) - 1e-4 * w
        g_start = (truth[:, 0] - p[:, 0]).mean(axis=0)
        g_step = -2e-2 * step
        for k in range(1, longest):
            pair = np.exp(fw[:, k - 1, :, None] + step + (e[:, k] + bw[:, k])[:, None, :] - z[:, None, None]) * inside[:, k, None, None]
            g_step = g_step - pair.sum(axis=0) / len(cuts)
            np.add.at(g_step, (y[:, k - 1], y[:, k]), inside[:, k] / len(cuts))
        for i, g in enumerate((g_w, g_start, g_step)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] += rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Field(w / scale, start, step)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Field:
    """On a bounded sample of labelled ids outside the held-out fold, chosen by a hash of the id. No labels: all lines are content.

    Of several texts of an id the first in order is taken, of several labels the largest.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = bounded_sample(known.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where(F.coalesce(F.char_length("text"), F.lit(0)).between(1, FIT_CHARS))
    got = sorted(rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect())
    if not got:
        return fit(np.zeros((0, WIDTH)), np.zeros(0, int), np.zeros(0, int))
    raw, offsets = text_buffer(pa.array([r[2] for r in got], pa.string()))
    measured = measure(raw, offsets)
    return fit(measured.features, measured.lines, np.array([r[1] for r in got]))


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_CONTENT) -> DataFrame:
    """Per row: its id, the base counts, base_failed, content_share (of words, by Viterbi labels; 0 without words) and kept. Nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for lo, hi in blocks(offsets):
                m = measure(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                gains, at = m.features @ field.weights, 0
                share = np.zeros(hi - lo)
                for i, n in enumerate(m.lines.tolist()):
                    if n:
                        words = m.words[at : at + n]
                        share[i] = words[np.array(field.viterbi(gains[at : at + n]))].sum() / words.sum()
                        at += n
                failed = (m.base["n_words"] < MIN_WORDS) | (m.base["n_repeat_words"] > MAX_REPEATED * m.base["n_words"])
                columns = [batch.column(0).slice(lo, hi - lo), *[pa.array(m.base[c].astype(np.int64)) for c in counts], pa.array(failed), pa.array(np.round(share, 6)), pa.array(~failed & (share >= least))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, *counts, "base_failed", "content_share", "kept"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{c} bigint' for c in counts)}, base_failed boolean, content_share double, kept boolean")
