"""Fill-in-middle documents: a text is cut at two unit boundaries and its pieces are put in another order.

A text is decoded to an array of code points. Each code point has a class (the number of line feeds before
it, or whether it is white space); where neighbours differ in class a unit ends. Of the n + 1 boundaries of
n units two are chosen by a hash of the id: the prefix ends at the lower, the middle at the higher one.

Null and empty texts have no units and stay plain, as do texts that contain a sentinel; a null id is hashed
as empty decimals. Repeated rows and ids are cut each for itself, alike where they are alike; an empty table
gives none. Bytes that aren't UTF-8 are carried through as they are. A text is held in memory while it is
cut (about 16 bytes a code point), batches are handled row by row, and nothing is shuffled. Of docs only id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import WHITE, text_buffer

_FEED = ord("\n")
_WHITE = np.array([ord(c) for c in WHITE], np.uint32)


@dataclass(frozen=True)
class Rules:
    """unit: "line" (ends after a line feed), "word" (a run of white space or of anything else) or "char".

    Of 100 texts `rate` are cut, and of 100 of these `spm` put the suffix first.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "line"
    rate: int = 100
    spm: int = 50
    seed: int = 7


def decode(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def encode(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def boundaries(points: np.ndarray, unit: str = "line") -> np.ndarray:
    """Where units begin and end: 0, each change of class, and the length; 0 alone of an empty text."""
    if not len(points):
        return np.zeros(1, np.int64)
    if unit == "line":
        feeds = points == _FEED
        classes = np.cumsum(feeds) - feeds
    elif unit == "word":
        classes = np.isin(points, _WHITE)
    elif unit == "char":
        classes = np.arange(len(points))
    else:
        raise ValueError(f"unit is {unit!r}, not line, word or char")
    return np.concatenate([[0], np.flatnonzero(classes[1:] != classes[:-1]) + 1, [len(points)]])


def draws(doc_id: int | str | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def cut(raw: bytes, doc_id: int | str | None, rules: Rules = Rules()) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form (plain, psm or spm), code points of prefix and middle (None if plain), and the output."""
    points = decode(raw)
    ends = boundaries(points, rules.unit)
    n = len(ends) - 1
    first, second, chosen, order = draws(doc_id, rules.seed)
    marks = [m.encode() for m in (rules.prefix, rules.suffix, rules.middle)]
    if not n or any(m in raw for m in marks) or chosen % 100 >= rules.rate:
        return n, "plain", None, None, raw
    lo, hi = sorted((first % (n + 1), second % (n + 1)))
    a, b = int(ends[lo]), int(ends[hi])
    prefix, middle, suffix = (encode(points[x:y]) for x, y in ((0, a), (a, b), (b, len(points))))
    p, s, m = marks
    if order % 100 < rules.spm:
        return n, "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle))


def restore(output: bytes, form: str, rules: Rules = Rules()) -> bytes:
    """The text that became `output`. No sentinel is in a text that was cut, so the first of each is the one set."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in (rules.prefix, rules.suffix, rules.middle))
    head, second = (p, s) if form == "psm" else (s, p)
    if form not in ("psm", "spm") or not output.startswith(head):
        raise ValueError(f"not an output of form {form}")
    one, _, rest = output[len(head) :].partition(second)
    two, _, middle = rest.partition(m)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), output: bool = True) -> DataFrame:
    """Per row of docs: its id, n, form, prefix_chars, middle_chars, output (binary, if asked for), output_sha256 and restored_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n", "form", "prefix_chars", "middle_chars", *(["output"] if output else []), "output_sha256", "restored_sha256"]
    types = {"n": pa.int64(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            rows = []
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                n, form, before, between, out = cut(raw[offsets[k] : offsets[k + 1]].tobytes(), doc_id, rules)
                rows.append((n, form, before, between, *([out] if output else []), sha(out), sha(restore(out, form, rules))))
            columns = [pa.array([r[j] for r in rows], types.get(name, pa.string())) for j, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *names])

    fields = ", ".join(f"{x} {'long' if types.get(x) == pa.int64() else 'binary' if x == 'output' else 'string'}" for x in names)
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` {kind}, {fields}")
