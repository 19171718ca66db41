"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once by the numpy helpers.
BLOCK = 1 << 20

_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes as they are, for word_hashes.
AS_IS = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: tuple[np.ndarray, np.ndarray] | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that every executor reads and writes: spark.checkpoint.dir, or one below the warehouse where it is unset."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return got.rstrip("/")


_noted: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths that are made in the shared folder meanwhile, so that their maker can delete them when nothing reads them any more."""
    paths: list[str] = []
    _noted.append(paths)
    try:
        yield paths
    finally:
        _noted.remove(paths)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _noted:
        paths.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and a lost executor loses nothing of it."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys (8 bytes each) that may be broadcast; beyond that the rows are shuffled by their key.
FEW_KEYS = 1_000_000


def by_keys(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi", most: int | None = None) -> DataFrame:
    """rows with a key among `keys` (or without, by left_anti). keys are counted and broadcast if they are few, as they are if `most` bounds them."""
    few = (keys.count() if most is None or most > FEW_KEYS else most) <= FEW_KEYS
    return rows.join(F.broadcast(keys) if few else keys, key, how)


def row_keys(count: int, at: int) -> np.ndarray:
    """Keys of `count` rows from the task's row `at` on; no two rows of a job share one. They are kept by writing the job's rows."""
    from pyspark import TaskContext

    return (np.int64(TaskContext.get().partitionId()) << np.int64(33)) + np.arange(at, at + count, dtype=np.int64)


#: A key with more than this share of all rows is hot: no more than 1 / HOT keys are, however large the table.
HOT = 1 / 2000
#: Rows that any task can take: a key of so few is not hot, however few there are together.
FEW_ROWS = 256


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, most: int | None = None) -> DataFrame:
    """rows, each with the columns of its group (one row for each key; `size` is its number of rows, of `total` together).

    The hot groups, 1 / HOT at most, are broadcast; the rows of the others are shuffled by their key. Null keys match nothing.
    Where no group is hot it is a plain join: the driver holds each broadcast, and a thread and a plan for it. `most` is
    the largest group's size; if it isn't given, the groups are looked through.
    """
    limit = max(total * HOT, FEW_ROWS)
    hot = groups.where(F.col(key).isNotNull() & (F.col(size) > limit))
    if (total if most is None else most) <= limit or most is None and hot.isEmpty():
        return rows.join(groups, key)
    keys = hot.select(F.col(key).alias("_hot"))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(keys), F.col(key) == F.col("_hot"), "left_anti").join(groups.where(F.col(size) <= limit), key))


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(df: DataFrame, key: str, limit: int, n: int | None = None) -> DataFrame:
    """About `limit` rows, chosen by a hash of `key` alone; all rows if there are no more than that."""
    n = df.count() if n is None else n
    if n <= limit:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 50)) < int(limit / n * (1 << 50)))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row starts; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes together, or one longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers = (out[0], out[1])
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_words(raw: np.ndarray, cuts: np.ndarray, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a piece; a word ends at white space and at each of `cuts`. fold: what each byte counts as."""
    white = _IS_WHITE[raw]
    solid = ~white
    begin = solid.copy()
    begin[1:] &= white[:-1]
    if len(cuts):
        begin[cuts] = solid[cuts]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    finish = solid.copy()
    finish[:-1] &= white[1:]
    if len(cuts):
        before = cuts[cuts > 0] - 1
        finish[before] = solid[before]
    ends = np.flatnonzero(finish) + 1
    up, down = _power_tables(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((fold[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return starts, mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_at(raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of the rows starts, its 64-bit hash (letters A-Z lower-cased, unless `fold` is AS_IS), and the number of words before each row.

    Rows of over BLOCK bytes are hashed in pieces that end between words, so memory follows the block, not the row.
    """
    if len(raw) <= BLOCK:
        cuts = np.unique(offsets[:-1])
        starts, hashes = _piece_words(raw, cuts[cuts < len(raw)], fold)
        return starts, hashes, np.searchsorted(starts, offsets)
    import hashlib

    counts, out, begins = [0], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        at, n = int(lo), 0
        while at < hi:
            end = min(at + BLOCK, int(hi))
            if end < hi:
                white = np.flatnonzero(_IS_WHITE[raw[at:end]])
                if len(white):
                    end = at + int(white[-1]) + 1
                else:  # one word longer than a block
                    while end < hi and not _IS_WHITE[raw[end]]:
                        end += 1
                    word = hashlib.blake2b(fold[raw[at:end]].tobytes(), digest_size=8).digest()
                    out.append(np.frombuffer(word, np.uint64))
                    begins.append(np.array([at]))
                    n, at = n + 1, end
                    continue
            starts, hashes = _piece_words(raw[at:end], np.zeros(0, np.int64), fold)
            out.append(hashes)
            begins.append(starts + at)
            n, at = n + len(hashes), end
        counts.append(counts[-1] + n)
    return np.concatenate(begins), np.concatenate(out), np.array(counts, np.int64)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """words_at without the places."""
    return words_at(raw, offsets, fold)[1:]
