"""Byte-level BPE encoding and decoding with a published rank file.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that is one token as a
whole; any other is merged from its bytes, lowest rank first and leftmost among equals, with a heap
over a linked list. Null texts are encoded as empty; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
_STEP, _MUL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys to n slots; keys outside are recognised by comparing.

    Groups of keys get the first displacement that sends all of them to free slots; groups of one
    are sent to a free slot directly, kept as a negative displacement.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.groups = max(1, n // 2)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        group = (hashes % np.uint64(self.groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(self.groups + 1))
        sizes = np.diff(bounds)
        self.shift = [0] * self.groups
        self.keys: list[bytes] = [b""] * n
        self.slot_of = np.empty(n, np.int64)
        free = np.ones(n, bool)
        tries = np.arange(256, dtype=np.uint64)
        for g in np.argsort(-sizes, kind="stable"):
            members = order[bounds[g] : bounds[g + 1]]
            if len(members) < 2:
                break
            first = 0
            while True:
                slots = self._slots(hashes[members][:, None], tries[None, :] + np.uint64(first))
                good = free[slots].all(axis=0)
                for t in np.flatnonzero(good):
                    if len(set(slots[:, t].tolist())) == len(members):
                        break
                else:
                    first += len(tries)
                    continue
                free[slots[:, t]] = False
                self.slot_of[members] = slots[:, t]
                self.shift[g] = first + int(t)
                break
        left = iter(np.flatnonzero(free).tolist())
        for g in np.flatnonzero(sizes == 1):
            slot = next(left)
            self.slot_of[order[bounds[g]]] = slot
            self.shift[g] = -slot - 1
        for k, slot in zip(keys, self.slot_of.tolist(), strict=True):
            self.keys[slot] = k

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = h + shift * np.uint64(_STEP)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(_MUL)
        x = x ^ (x >> np.uint64(32))
        return (x % np.uint64(self.n)).astype(np.int64)

    def find(self, key: bytes) -> int:
        """The key's slot, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        shift = self.shift[h % self.groups]
        if shift < 0:
            slot = -shift - 1
        else:
            x = (h + shift * _STEP) & _MASK
            x = ((x ^ (x >> 29)) * _MUL) & _MASK
            slot = (x ^ (x >> 32)) % self.n
        return slot if self.keys[slot] == key else -1


class Vocabulary:
    """Ranks of a tiktoken-style file. Its size bounds what each worker holds."""

    #: Pairs of tokens whose merged rank is remembered; emptied when full.
    PAIRS = 400_000

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
        self.pattern = pattern
        self.hash = PerfectHash([k for k, _ in pairs])
        self.rank_at = [0] * len(pairs)
        for slot, (_, rank) in zip(self.hash.slot_of.tolist(), pairs, strict=True):
            self.rank_at[slot] = rank
        self.bytes_of = {rank: k for k, rank in pairs}
        self.rank_of_byte = [self.rank(bytes([b])) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}

    def rank(self, piece: bytes) -> int:
        slot = self.hash.find(piece)
        return -1 if slot < 0 else self.rank_at[slot]

    def rank_of_pair(self, pair: tuple[int, int]) -> int:
        """Of the two tokens' bytes together, or -1."""
        if (rank := self.merged.get(pair)) is None:
            if len(self.merged) >= self.PAIRS:
                self.merged.clear()
            rank = self.merged[pair] = self.rank(self.bytes_of[pair[0]] + self.bytes_of[pair[1]])
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of a piece that is not itself in the vocabulary.

        The parts are a linked list by start; the heap holds (rank, start, end) of neighbours that may
        merge, and an entry whose parts have changed since is passed over.
        """
        n = len(piece)
        part = [self.rank_of_byte[b] for b in piece]
        if -1 in part:
            raise ValueError(f"byte {piece[part.index(-1)]} is not in the vocabulary")
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known, look = self.merged.get, self.rank_of_pair
        heap = []
        for i in range(n - 1):
            pair = (part[i], part[i + 1])
            r = known(pair)
            if r is None:
                r = look(pair)
            if r >= 0:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i, end = pop(heap)
            if part[i] < 0:
                continue
            j = after[i]
            if j >= n or after[j] != end:
                continue
            part[i], part[j], after[i] = rank, -1, end
            if end < n:
                before[end] = i
                pair = (rank, part[end])
                r = known(pair)
                if r is None:
                    r = look(pair)
                if r >= 0:
                    push(heap, (r, i, after[end]))
            p = before[i]
            if p >= 0:
                pair = (part[p], rank)
                r = known(pair)
                if r is None:
                    r = look(pair)
                if r >= 0:
                    push(heap, (r, p, end))
        return [p for p in part if p >= 0]

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.rank(piece)
        return [rank] if rank >= 0 else self.merge(piece)


class _Recent(dict):
    """Packed ids of the strings met lately. When full, they become the older ones, of which those that are met again come back."""

    FULL, LONG = 200_000, 64

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        packed = self.older.get(key)
        if packed is None:
            packed = self.make(key)
        if len(key) <= self.LONG:
            if len(self) >= self.FULL:
                self.older = dict(self)
                self.clear()
            self[key] = packed
        return packed


class Encoder:
    """Encodes texts to packed little-endian 32-bit ids and decodes them.

    Where no space stands between other white space, the pattern never joins what a space divides, but
    for the space itself and what follows. Such texts are cut at their spaces first, and each stretch
    is split by the pattern once.
    """

    AT_ONCE = 1 << 16

    def __init__(self, vocabulary: Vocabulary) -> None:
        import regex

        self.pattern = regex.compile(vocabulary.pattern)
        self.unsafe = re.compile(r"\s (?:\s|\Z)")
        self.pieces = _Recent(lambda piece: struct.pack(f"<{len(ids := vocabulary.encode_piece(piece.encode()))}I", *ids))
        self.stretches = _Recent(lambda rest: self._split(" " + rest))
        ranks = sorted(vocabulary.bytes_of)
        self.length = np.zeros(ranks[-1] + 1 if ranks else 1, np.int64)
        for rank in ranks:
            self.length[rank] = len(vocabulary.bytes_of[rank])
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(vocabulary.bytes_of[r] for r in ranks), np.uint8)

    def _split(self, text: str) -> bytes:
        get = self.pieces.__getitem__
        if len(text) <= 1 << 20:
            return b"".join(map(get, self.pattern.findall(text)))
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while part := list(islice(found, self.AT_ONCE)):
            out.append(b"".join(map(get, part)))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.unsafe.search(text):
            return self._split(text)
        first, *rest = text.split(" ")
        return self._split(first) + b"".join(map(self.stretches.__getitem__, rest))

    def decode(self, packed: bytes) -> bytes:
        out = []
        for at in range(0, len(packed), 4 * self.AT_ONCE):
            ids = np.frombuffer(packed[at : at + 4 * self.AT_ONCE], "<u4")
            length = self.length[ids]
            ends = np.cumsum(length)
            out.append(self.flat[np.repeat(self.start[ids] - ends + length, length) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


_OUT_BYTES = 8 << 20


def tokenize(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Per row: its id, `n_tokens`, `ids` (packed little-endian unsigned 32-bit) and, if asked for, `decoded` bytes.

    Each row is whole and alone: nothing is shuffled. Nulls give no tokens; repeated ids give a row each;
    an empty table gives none. The vocabulary is read and its hash built once on the driver.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary_path, pattern))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids binary" + ", decoded binary" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at, size, ids, back = 0, 0, [], []

            def flush(end: int) -> pa.RecordBatch:
                arrays = [keys.slice(at, end - at), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                names = [id_col, "n_tokens", "ids"]
                if decoded:
                    arrays, names = [*arrays, pa.array(back, pa.binary())], [*names, "decoded"]
                return pa.RecordBatch.from_arrays(arrays, names)

            for i in range(len(texts)):
                packed = encoder.encode(texts[i].as_py() or "")
                ids.append(packed)
                size += len(packed)
                if decoded:
                    back.append(encoder.decode(packed))
                    size += len(back[-1])
                if size >= _OUT_BYTES:
                    yield flush(i + 1)
                    at, size, ids, back = i + 1, 0, [], []
            if ids:
                yield flush(len(texts))

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
