"""Exact deduplication by Grace hashing.

Texts are equal when nothing but white space sets them apart. A task puts its records into an
open-addressing table that compares complete content; when the table outgrows its budget, table and
remaining records are dealt by the next bits of their hash to spill files, each of which is handled
the same way. Two such passes run: one over each input partition, so that a group of copies leaves a
partition as one row, and one over what is left, dealt by hash.

A table holds each content once, and of its records the best; the others are given back as they come,
so memory does not follow the number of copies. In the second pass an entry also holds a few numbers for
each input partition that has the content.

Null texts are empty. Of equal texts the row with the most code points, then the smallest id (nulls
last), stays; if rows share that too, one of them. Every row is returned, repeated rows each for
themselves, with all columns of the input in a struct, so that no name can clash. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.llm.common import WHITE, row_keys, written

#: Bytes that a table holds at most (or one text), files that a table spills to, bytes of a batch given back.
BUDGET, FANOUT, OUT_BYTES = 96 << 20, 16, 8 << 20
#: Bytes that an entry takes besides its content, and what it notes of a record.
ENTRY, NOTE = 600, 150
_WHITE_BYTES = WHITE.encode()


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _WHITE_BYTES)


#: Hash, content, and what is known of the records with it: a list that the first record brings and later ones are merged into.
Record = tuple[int, bytes, list]


class ContentTable:
    """Open addressing with linear probing; an entry is found by hash, then by comparing its content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.entries: list[Record] = []
        self.bytes = 0

    def find(self, record: Record) -> list | None:
        """What the entry of the record's content holds, or None: then the record is the entry."""
        h, content, _ = record
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (entry := slots[at]) >= 0:
            other = self.entries[entry]
            if other[0] == h and other[1] == content:
                return other[2]
            at = (at + 1) & mask
        slots[at] = len(self.entries)
        self.entries.append(record)
        if 2 * len(self.entries) > len(slots):
            self._grow()
        return None

    def _grow(self) -> None:
        slots, mask = [-1] * (4 * len(self.slots)), 4 * len(self.slots) - 1
        for entry, (h, _, _) in enumerate(self.entries):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = entry
        self.slots = slots


def spill_folder() -> tempfile.TemporaryDirectory:
    """A folder for spill files of this task alone, on the disks that Spark itself spills to."""
    homes = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return tempfile.TemporaryDirectory(prefix="grace-", dir=homes[os.getpid() % len(homes)] if homes else None)


def grace_groups(records: Iterable[Record], merge: Callable[[list, list], int], budget: int = BUDGET, fanout: int = FANOUT, level: int = 0, held: Callable[[Record], int] = lambda r: ENTRY + len(r[1])) -> Iterator[tuple[bytes | None, list, list]]:
    """(content, entry, entry) for each distinct content, and before it (None, entry, record) for each record that was merged into an entry.

    merge(entry, other) takes a record's list into the entry's and returns the bytes that this adds; `held`
    says what a new entry takes. A bucket is split again by other bits of the hash while it is over budget
    and its bits are not used up (contents that share all 64 bits stay together in one table, and are told
    apart by comparing).
    """
    table, records = ContentTable(), iter(records)
    most = 64 // (fanout.bit_length() - 1)
    for record in records:
        entry = table.find(record)
        if entry is None:
            table.bytes += held(record)
        else:
            table.bytes += merge(entry, record[2])
            yield None, entry, record[2]
        if table.bytes > budget and len(table.entries) > 1 and level < most:
            break
    else:
        for _, content, entry in table.entries:
            yield content, entry, entry
        return
    shift = 64 - (level + 1) * (fanout.bit_length() - 1)
    with spill_folder() as folder:
        files = [open(os.path.join(folder, str(k)), "wb") for k in range(fanout)]  # noqa: SIM115
        try:
            for record in table.entries:
                pickle.dump(record, files[(record[0] >> shift) % fanout])
            del table
            for record in records:
                pickle.dump(record, files[(record[0] >> shift) % fanout])
        finally:
            for f in files:
                f.close()
        for f in files:
            yield from grace_groups(_spilled(f.name), merge, budget, fanout, level + 1, held)
            os.unlink(f.name)


def _spilled(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _order(points: int, doc_id: Any, key: int) -> tuple:
    """Best first: most code points, smallest id (nulls last), first row."""
    return (-points, doc_id is None, 0 if doc_id is None else doc_id, key)


def _batches(rows: Iterable[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, each with its bytes, as batches."""
    out, size = [], 0
    for row, n in rows:
        out.append(row)
        size += n + 100
        if size > OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _better(entry: list, other: list) -> bool:
    """Takes another record's (points, id, key, ...) for the entry's own if it is better."""
    if _order(*other[:3]) < _order(*entry[:3]):
        entry[: len(other)] = other
        return True
    return False


def _local(docs: DataFrame, id_col: str, text_col: str, budget: int) -> DataFrame:
    """A row for each row of docs: id, key and `rep`, the key of the first of its equals in the partition. That row has what is known of them: n, the best one's points, id and key, and the content."""
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = T.StructType.fromDDL(f"id {id_type}, key long, rep long, n long, points long, best_id {id_type}, best long, content binary")
    schema = to_arrow_schema(kind)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        seen = 0
        for batch in batches:
            for key, doc_id, text in zip(row_keys(batch.num_rows, seen).tolist(), batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                content = normalised(text)
                yield xxhash.xxh3_64_intdigest(content), content, [len(text or ""), doc_id, key, 1, doc_id, key]
            seen += batch.num_rows

    def merge(entry: list, other: list) -> int:
        entry[3] += other[3]
        _better(entry, other[:3])
        return 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for content, entry, other in grace_groups(records(batches), merge, budget):
            if content is None:
                yield (other[4], other[5], entry[5], None, None, None, None, None), 0
            else:
                points, best_id, best, n, doc_id, key = entry
                yield (doc_id, key, key, n, points, best_id, best, content), len(content)

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(lambda batches: _batches(rows(batches), schema), kind)


def _across(reps: DataFrame, budget: int) -> DataFrame:
    """For each partition's row of a content (rep, n, points, best_id, best, content): the best of all, its id, the group's size and digest."""
    schema = f"rep long, keep long, keep_id {reps.schema['best_id'].dataType.simpleString()}, group_size long, sha256 string"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        for batch in batches:
            *slim, content = [batch.column(k) for k in range(6)]
            for (rep, n, points, best_id, best), own in zip(zip(*[c.to_pylist() for c in slim], strict=True), content, strict=True):
                own = own.as_py()
                yield xxhash.xxh3_64_intdigest(own), own, [points, best_id, best, n, [rep]]

    def merge(entry: list, other: list) -> int:
        _better(entry, other[:3])
        entry[3] += other[3]
        entry[4] += other[4]
        return NOTE

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for content, entry, _ in grace_groups(records(batches), merge, budget):
            if content is not None:
                sha = hashlib.sha256(content).hexdigest()
                for rep in entry[4]:
                    yield (rep, entry[2], entry[1], entry[3], sha), 0

    return reps.mapInArrow(lambda batches: _batches(rows(batches), arrow), schema)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """Per row of docs: its id, keep_id, group_size, kept, text_sha256. What is computed is written to the shared folder."""
    rows = written(_local(docs, id_col, text_col, budget), "grace-rows")
    # dealt by a hash of the content, so that equal texts meet
    reps = rows.where("n is not null").select("rep", "n", "points", "best_id", "best", "content").repartition(F.xxhash64("content"))
    groups = written(_across(reps, budget), "grace-groups")
    # no key is hot: rows of one `rep` come from one input partition
    return rows.select("id", "key", "rep").join(groups, "rep").select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("key") == F.col("keep")).alias("kept"), F.col("sha256").alias("text_sha256"))


def _best_rows(docs: DataFrame, budget: int, first: bool, id_at: int, text_at: int) -> DataFrame:
    """docs (doc: a struct of all columns, key long): of equal texts in a partition the best row. first: keys are given here."""
    schema, names = to_arrow_schema(docs.schema), docs.schema["doc"].dataType.names

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        seen = 0
        for batch in batches:
            keys = row_keys(batch.num_rows, seen).tolist() if first else batch.column(1).to_pylist()
            seen += batch.num_rows
            for key, row in zip(keys, zip(*[c.to_pylist() for c in batch.column(0).flatten()], strict=True), strict=True):
                content = normalised(row[text_at])
                yield xxhash.xxh3_64_intdigest(content), content, [len(row[text_at] or ""), row[id_at], key, row]

    def merge(entry: list, other: list) -> int:
        before = entry[0]
        return 4 * (entry[0] - before) if _better(entry, other) else 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for content, entry, _ in grace_groups(records(batches), merge, budget, held=lambda r: ENTRY + len(r[1]) + 4 * r[2][0]):
            if content is not None:
                yield (dict(zip(names, entry[3], strict=True)), entry[2]), len(content)

    return docs.mapInArrow(lambda batches: _batches(rows(batches), schema), docs.schema)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of docs that stay, with docs' own columns: one shuffle of what the partitions keep, and no written table."""
    at = docs.columns.index(id_col), docs.columns.index(text_col)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.lit(None).cast("long").alias("key"))
    some = _best_rows(keyed, budget, True, *at)
    # dealt by a hash of the normalised text, so that equal texts meet
    some = some.repartition(F.xxhash64(F.translate(F.coalesce(F.col("doc")[text_col], F.lit("")), WHITE, "")))
    return _best_rows(some, budget, False, *at).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
