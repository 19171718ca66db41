"""From raw documents to token ids: bad documents and copies go, sources are mixed, texts are encoded.

Null texts are empty: they are scored like any other text, equal each other and blank ones, and have no
words to mix. Repeated rows are copies. An empty table gives none. Columns keep their names and any name
may be among them, until the last stage.

A stage's docs are a table that has been written: each stage first deletes what the one before made on
its way in the shared folder, so disk holds one stage's tables at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, gracededup, icws, mil, mixing
from pulsegrid.llm.common import delete, noted, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_made: list[str] = []


def _stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _made:
            delete(spark, _made.pop())
        with noted() as paths:
            out = f(spark, docs, sf_dir)
        _made.extend(paths)
        return out

    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the classifier learns from labelled rows of docs outside the held-out fold."""
    return mil.keep_good(docs, mil.train(docs, table(spark, sf_dir, "labels")))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that only white space sets apart, the one that stays."""
    return gracededup.kept(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of near copies."""
    return icws.NearDuplicates(docs).kept()


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, none more than twice."""
    return mixing.repeat_rows(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit) and the digest of the decoded bytes."""
    out = bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("encode", encode)]

#: The classifier and the weighted samples are not for SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with noted() as paths:
            docs = written(out, name)
        if before is not None:
            delete(spark, before)
        before = paths[0]
    return STAGES[-1][1](spark, docs, sf_dir)
