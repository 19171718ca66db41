"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its shingles of SHINGLE words (letters A-Z lower-cased; of a shorter text
all words are one shingle): how often it has one, times its inverse document frequency. Frequencies
are counted over all documents in a table of TABLE counters. Rarity ends at 1 document in RARE, so what
else falls on a counter (documents times shingles of a document / TABLE, a fixed share of the documents
however many there are) stays below that for documents of up to TABLE / RARE shingles on average.
Samples are banded; a link is a weighted Jaccard similarity of LEAST or more, and classes are the
connected components.

Every two members of a bucket of a band are compared or found in one class. First each is compared with
the bucket's leader, the text whose shingles are most common. Of buckets that still hold several classes,
all members of different classes are compared, in cells of two parts of a bucket each: rows moved and
comparisons grow with the square of what such a bucket holds, the rows in steps of CELL bytes.

Texts of equal words are one text from the start. Texts without words are equal. Null texts are empty;
rows with equal ids or without an id are rows of their own; all columns of the input are kept.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.llm.common import blocks, by_keys, fresh_path, join_groups, mix64, row_keys, text_buffer, word_hashes, written
from pulsegrid.llm.components import components

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 12, 3
#: Bytes of text in a part of a bucket (a text counts as LIGHT at least), and shared shingles that are multiplied out at once.
CELL, LIGHT, TILE = 1 << 18, 1 << 10, 2048
#: Members of a leader that are compared with one copy of its text.
LED = 512
#: Counters of document frequencies, and how many of them go in one row.
TABLE, PACK = 1 << 20, 1 << 14
#: A shingle in one of RARE documents or fewer weighs 1 + LIFT, one in all documents 1.
RARE, LIFT = 1000, 0.25
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Each row's distinct shingles in order of their hash, how often it has them, its number of shingles, and a print of its words."""
    words, bounds = word_hashes(raw, offsets)
    n = np.diff(bounds)
    prints = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), count)
    if not len(row):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(n), np.int64), prints
    at = bounds[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n[row], SHINGLE)
    h = np.zeros(len(row), np.uint64)
    for j in range(SHINGLE):
        has = size > j
        h[has] = (h[has] + words[at[has] + j] + np.uint64(j + 1)) * _STEP
    h = mix64(h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return h[first], np.diff(np.append(first, len(h))), np.bincount(row[first], minlength=len(n)), prints


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Of the one string column of texts: the number of texts, and for each counter how many shingles of texts fall on it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(TABLE, np.uint32), 0
        for batch in batches:
            n += batch.num_rows
            raw, offsets = text_buffer(batch.column(0))
            for lo, hi in blocks(offsets):
                h, *_ = shingles(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                table += np.bincount((h % np.uint64(TABLE)).astype(np.int64), minlength=TABLE).astype(np.uint32)
        packs = [(-1, np.array([n], np.int64))] + [(k, table[k * PACK : (k + 1) * PACK].astype(np.int64)) for k in range(TABLE // PACK)]
        packs = [(k, zlib.compress(x.tobytes(), 1)) for k, x in packs if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in packs], pa.int32()), pa.array([x for _, x in packs], pa.binary())], ["pack", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(x), np.int64)
                sums[k] = sums[k] + counts if k in sums else counts
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["pack", "counts"])

    kind = "pack int, counts binary"
    out, n = np.zeros(TABLE, np.int64), 0
    # TABLE counters at most come to the driver
    for k, x in texts.mapInArrow(count, kind).repartition(TABLE // PACK, "pack").mapInArrow(add, kind).collect():
        counts = np.frombuffer(zlib.decompress(x), np.int64)
        if k < 0:
            n = int(counts[0])
        else:
            out[k * PACK : (k + 1) * PACK] = counts
    return n, out


@dataclass
class Sampler:
    """idf: each counter's weight. The other tables give a hash's share of gamma and uniform variates."""

    idf: np.ndarray
    bands: int = BANDS
    rows: int = ROWS

    def __post_init__(self) -> None:
        rng = np.random.default_rng(20)
        self.r = rng.gamma(2, 1, 1 << 16).astype(np.float32) + np.float32(1e-3)
        self.per_r = (1 / self.r).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32)
        self.seeds = rng.integers(1, 1 << 63, self.bands * self.rows, dtype=np.uint64) | np.uint64(1)

    @classmethod
    def of(cls, n: int, frequencies: np.ndarray, lift: float = LIFT, **more: int) -> Sampler:
        rarity = np.log(np.clip(n / np.maximum(frequencies, 1), 1, RARE)) / np.log(RARE)
        return cls((1 + lift * rarity).astype(np.float32), **more)

    def weights(self, h: np.ndarray, times: np.ndarray) -> np.ndarray:
        return times.astype(np.float32) * self.idf[(h % np.uint64(TABLE)).astype(np.int64)]

    def samples(self, h: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For rows with shingles: the least ln a of each sample. Equal only if shingle and step of the weight are, which is the sample."""
        log, starts = np.log(weights), np.cumsum(counts) - counts
        out = np.empty((len(self.seeds), len(counts)), np.float32)
        for k, seed in enumerate(self.seeds):
            x = h * seed
            x ^= x >> np.uint64(29)
            x *= _STEP
            x ^= x >> np.uint64(32)
            low = (x & np.uint64(0xFFFF)).astype(np.int64)
            beta = ((x >> np.uint64(40)).astype(np.float32)) * np.float32(2**-24)
            a = np.floor(log * self.per_r[low] + beta)
            a -= beta
            a += 1
            a *= self.r[low]
            np.subtract(self.ln_c[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)], a, out=a)
            out[k] = np.minimum.reduceat(a, starts)
        return out

    def signatures(self, h: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each band of the rows with shingles."""
        bits = self.samples(h, weights, counts).view(np.uint32).astype(np.uint64).reshape(self.bands, self.rows, -1)
        out = np.empty((len(counts), self.bands), np.uint64)
        for b in range(self.bands):
            x = np.full(len(counts), b + 1, np.uint64)
            for j in range(self.rows):
                x = mix64(x * _STEP + bits[b, j])
            out[:, b] = x
        return out.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets, each as sorted hashes and weights; 0 if both are empty."""
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return common / (total - common)


def links_of_cell(sampler: Sampler, least: float, text: pa.Array, label: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, float]]:
    """Of rows of different labels, one of `left` and one of `right` (row numbers): the pairs of `least` similarity or more.

    The n-th occurrence of a shingle counts as a token, so what two texts have in common is a product of
    0/1 matrices over the tokens of several rows; what comes near `least` is computed anew, exactly.
    """
    h, times, counts, _ = shingles(*text_buffer(text))
    weights, bounds = sampler.weights(h, times), np.append(0, np.cumsum(counts))
    total = np.add.reduceat(weights.astype(np.float64), bounds[:-1])
    at = np.repeat(np.arange(len(h)), times)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    _, token, seen = np.unique(mix64(h[at] + nth.astype(np.uint64) * _STEP), return_inverse=True, return_counts=True)
    several = seen[token] > 1
    token, row, each = (np.cumsum(seen > 1) - 1)[token[several]], np.repeat(np.arange(len(counts)), counts)[at[several]], (weights / times)[at[several]]
    order = np.argsort(token, kind="stable")
    token, row, each = token[order], row[order], each[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int((seen > 1).sum()), TILE):
        lo, hi = np.searchsorted(token, (first, first + TILE))
        has, weight = np.zeros((len(counts), TILE), np.float32), np.zeros(TILE, np.float32)
        has[row[lo:hi], token[lo:hi] - first] = 1
        weight[token[lo:hi] - first] = each[lo:hi]
        common += (has[left] * weight) @ has[right].T
    like = common >= (least - 1e-3) * (total[left][:, None] + total[right][None, :] - common)
    out = []
    for i, j in zip(*np.nonzero(like & (label[left][:, None] != label[right][None, :])), strict=True):
        a, b = sorted((int(left[i]), int(right[j])))
        s = weighted_jaccard(*[(h[bounds[k] : bounds[k + 1]], weights[bounds[k] : bounds[k + 1]]) for k in (a, b)])
        if s >= least:
            out.append((a, b, s))
    return sorted(set(out))


class NearDuplicates:
    """Classes of near copies among docs. What is computed is written to the shared folder step by step.

    lift: how much more than a shingle of all documents a rare one weighs; math.log(RARE) is the undamped
    logarithm, at which many copies of one text stop being near copies for a few edits, as what they share
    is common by their own number.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, bands: int = BANDS, rows: int = ROWS, lift: float = LIFT) -> None:
        spark = docs.sparkSession
        self.columns, self.id_col, self.text_col, self.least, self.bands = docs.columns, id_col, text_col, least, bands
        self.n_rows, frequencies = document_frequencies(docs.select(text_col))
        self.sampler = spark.sparkContext.broadcast(Sampler.of(self.n_rows, frequencies, lift, bands=bands, rows=rows))
        self.signed = self._sign(docs)
        doc_id = F.col("doc")[id_col]
        best = F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("id"), F.col("key").alias("key"))
        groups = self.signed.groupBy("print").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))
        self.groups = written(groups, "near-groups")
        self.links, labels = self._link()
        self.texts = self._classes(labels)

    def _sign(self, docs: DataFrame) -> DataFrame:
        """Each row of docs with its key, the print of its words, the mean and the sum of its shingles' weights, its bytes and its bands."""
        kind = T.StructType([T.StructField("doc", docs.schema), *T.StructType.fromDDL("key long, print binary, common float, weight double, bytes long, bands array<long>").fields])
        schema, shared = to_arrow_schema(kind), self.sampler
        text_at = self.columns.index(self.text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sampler, seen = shared.value, 0
            for batch in batches:
                raw, offsets = text_buffer(batch.column(0).field(text_at))
                keys = row_keys(batch.num_rows, seen)
                seen += batch.num_rows
                for lo, hi in blocks(offsets):
                    h, times, counts, prints = shingles(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    weights, has = sampler.weights(h, times), counts > 0
                    bands = np.zeros((hi - lo, sampler.bands), np.int64)
                    common, total = np.zeros(hi - lo, np.float32), np.zeros(hi - lo)
                    if has.any():
                        bands[has] = sampler.signatures(h, weights, counts[has])
                        starts = np.cumsum(counts[has]) - counts[has]
                        common[has] = np.add.reduceat((weights / times).astype(np.float64), starts) / counts[has]
                        total[has] = np.add.reduceat(weights.astype(np.float64), starts)
                    sizes = np.where(has, sampler.bands, 0)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(bands[has].reshape(-1), pa.int64()))
                    docs_part = batch.column(0).slice(lo, hi - lo).cast(schema.field(0).type)
                    columns = [docs_part, pa.array(keys[lo:hi]), pa.array(prints, pa.binary()), pa.array(common), pa.array(total), pa.array(np.diff(offsets[lo : hi + 1])), lists.cast(schema.field(6).type)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

        path = fresh_path(docs.sparkSession, "near-signed")
        signed = docs.select(F.struct(*[F.col(f"`{c}`") for c in self.columns]).alias("doc")).mapInArrow(run, kind)
        signed.write.option("compression", "zstd").parquet(path)
        return docs.sparkSession.read.schema(kind).parquet(path)

    def _link(self) -> tuple[DataFrame, DataFrame]:
        """Links (a, b, similarity) and what they connect (key, label)."""
        several = self.groups.where("n > 1").select("print", "rep", "n")
        repeated = join_groups(self.signed.select("key", "print"), several, "print", "n", self.n_rows).where("key <> rep").select("key")
        repeated = written(repeated, "near-repeated")
        rows = by_keys(self.signed.select("key", "common", "weight", "bytes", F.explode("bands").alias("bucket")), repeated, "key", "left_anti")
        total = self.groups.count() * self.bands
        heads = rows.groupBy("bucket").agg(F.min(F.struct("common", "key", "weight")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
        heads = written(heads, "near-heads")
        members = written(join_groups(rows.select("key", "weight", "bytes", "bucket"), heads, "bucket", "n", total), "near-members")
        # the lighter text can't have more in common with the other than its own weight
        able = F.least("weight", "head.weight") >= (self.least - 1e-6) * F.greatest("weight", "head.weight")
        pairs = written(self._pairs(members.where(able).select("key", F.col("head.key").alias("leader"))), "near-pairs")
        links = written(self._verify(pairs), "near-links")
        rest = written(self._rest(members, components(links), total), "near-links")
        links = links.union(rest)
        return links, components(links)

    def _rest(self, members: DataFrame, labels: DataFrame, total: int) -> DataFrame:
        """Links between classes that share a bucket, of all members. Of buckets with the same members one is taken."""
        own = members.join(labels, "key", "left").select("key", "bucket", "bytes", F.coalesce("label", "key").alias("label"))
        own = written(own, "near-own")
        same = [F.bit_xor(F.xxhash64("key", F.lit(seed))).alias(f"members{seed}") for seed in (1, 2)]
        mixed = own.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n"), F.sum(F.greatest("bytes", F.lit(LIGHT))).alias("bytes"), *same)
        # the members of a bucket of two have been compared
        mixed = mixed.where("x <> y and n > 2").groupBy("n", "bytes", "members1", "members2").agg(F.min("bucket").alias("bucket"))
        mixed = written(mixed.select("bucket", "n", F.ceil(F.col("bytes") / CELL).alias("parts")), "near-heads")
        placed = join_groups(own, mixed, "bucket", "n", total).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
        placed = placed.select("key", "label", "bucket", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        cells = written(placed.select("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "key", "label"), "near-cells")
        dealt = cells.join(self._texts(cells.select("key").distinct()), "key").select("bucket", "low", "high", "part", "key", "label", "text")
        dealt = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
        shared, least = self.sampler, self.least

        def links(cell: pa.Table) -> pa.RecordBatch:
            low, high, part, key, label = (cell.column(c).to_numpy() for c in ("low", "high", "part", "key", "label"))
            text = pa.concat_arrays(cell.column("text").chunks)
            found = links_of_cell(shared.value, least, text, label, np.flatnonzero(part == low), np.flatnonzero(part == high))
            pairs = [(*sorted((int(key[a]), int(key[b]))), s) for a, b, s in found]
            return pa.RecordBatch.from_arrays([pa.array([p[j] for p in pairs], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_, of = [], None
            for batch in batches:
                places = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
                starts = np.append(np.append(0, np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1), len(places)) if len(places) else np.zeros(1, int)
                for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    if open_ and tuple(places[lo]) != of:
                        yield links(pa.Table.from_batches(open_))
                        open_ = []
                    open_.append(batch.slice(lo, hi - lo))
                    of = tuple(places[lo])
            if open_:
                yield links(pa.Table.from_batches(open_))

        return dealt.mapInArrow(run, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))

    @staticmethod
    def _pairs(led: DataFrame) -> DataFrame:
        """Distinct pairs a < b of (key, leader), and whether a leads."""
        known = led.where("leader is not null and leader <> key")
        return known.groupBy(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).agg(F.max(F.col("leader") < F.col("key")).alias("a_leads"))

    def _texts(self, keys: DataFrame, most: int | None = None) -> DataFrame:
        """Texts (key, text) of the keys, of which there are `most` at most."""
        return by_keys(self.signed.select("key", F.col("doc")[self.text_col].alias("text")), keys, "key", "left_semi", most)

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of `least` similarity or more. Each leader's shingles are made once for the pairs of it that follow each other.

        A leader's text is copied once for each LED members, which are dealt to the copies: no task has to take all members of one.
        """
        texts = self._texts(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), 2 * pairs.count())
        led = pairs.select(F.when(F.col("a_leads"), F.col("a")).otherwise(F.col("b")).alias("leader"), F.when(F.col("a_leads"), F.col("b")).otherwise(F.col("a")).alias("member"))
        copies = led.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).select("leader", "n", F.ceil(F.col("n") / LED).alias("copies"))
        copies = written(copies, "near-leaders")
        led = join_groups(led, copies, "leader", "n", pairs.count()).select("leader", "member", F.pmod(F.xxhash64("member"), F.col("copies")).alias("copy"))
        leaders = texts.join(copies, F.col("key") == F.col("leader")).select("leader", F.col("text").alias("leader_text"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
        with_member = led.join(texts.select(F.col("key").alias("member"), F.col("text").alias("member_text")), "member")
        both = with_member.join(leaders, ["leader", "copy"])
        shared, least = self.sampler, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sampler, last, of_last = shared.value, None, None

            def weighted(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
                h, times, _, _ = shingles(*text_buffer(text))
                return h, sampler.weights(h, times)

            for batch in batches:
                out: list[tuple[int, int, float]] = []
                leaders, members = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i, (leader, member) in enumerate(zip(leaders, members, strict=True)):
                    if leader != last:
                        last, of_last = leader, weighted(batch.column(3).slice(i, 1))
                    s = weighted_jaccard(weighted(batch.column(2).slice(i, 1)), of_last)
                    if s >= least:
                        out.append((min(leader, member), max(leader, member), s))
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

        return both.select("leader", "member", "member_text", "leader_text").mapInArrow(run, "a long, b long, similarity double")

    def _classes(self, labels: DataFrame) -> DataFrame:
        """Per distinct text: its print, how many rows have it, its class and the class's first row, size, texts."""
        texts = self.groups.join(labels, F.col("rep") == F.col("key"), "left").withColumn("label", F.coalesce("label", "rep")).drop("key")
        classes = texts.groupBy("label").agg(F.min("best").alias("first"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("class_texts"))
        texts, classes = written(texts.select("print", "n", "label"), "near-texts"), written(classes, "near-classes")
        total = texts.count()
        joined = join_groups(texts, classes, "label", "class_texts", total)
        return written(joined.select("print", "n", "label", F.col("first.id").alias("class_id"), F.col("first.key").alias("keep"), "class_size", "class_texts"), "near-classed")

    def classes(self) -> DataFrame:
        """Per row of docs: its id, class_id (the least id of its class), class_size (rows), class_texts (different texts)."""
        rows = self.signed.select(F.col("doc")[self.id_col].alias(self.id_col), "print")
        return join_groups(rows, self.texts.drop("label", "keep"), "print", "n", self.n_rows).select(self.id_col, "class_id", "class_size", "class_texts")

    def kept(self) -> DataFrame:
        """One row of each class, that with the least id, with docs' own columns. The rows that go are looked up, not those that stay."""
        slim = self.signed.select("key", "print")
        gone = join_groups(slim, self.texts.select("print", "n", "keep"), "print", "n", self.n_rows).where("key <> keep").select("key")
        return by_keys(self.signed, written(gone, "near-gone"), "key", "left_anti").select(*[F.col("doc")[c].alias(c) for c in self.columns])
