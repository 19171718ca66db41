import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
import pytest
from pyspark.sql import functions as F
from tests.llm.test_mixing import brute_targets
from tests.llm.test_near import brute_classes, edited, words
from tests.llm.texts import TEXTS
from tests.llm.texts import docs as made

import __spark_entry__
import corpus_pipeline
from pulsegrid.llm import gracededup, icws, mil
from pulsegrid.llm.common import held_out, table


def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_stages_in_order(spark, sf_dir):
    columns = table(spark, sf_dir, "documents").columns
    model = mil.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        ids = [r.doc_id for r in docs.collect()]
        old = {r.doc_id for r in before.collect()}
        assert set(ids) <= old
        if name == "quality":
            assert set(ids) == {r.doc_id for r in mil.score(before, model).collect() if r.score >= 0.3}
        elif name == "exact_dedup":
            texts = [gracededup.normalised(r.text) for r in before.collect()]
            assert len(ids) == len(set(texts)) == len({gracededup.normalised(r.text) for r in docs.collect()})
        elif name == "near_dedup":
            classes = {r.class_id for r in icws.NearDuplicates(before).classes().collect()}
            assert sorted(ids) == sorted(classes)
        elif name == "mix":
            assert max(ids.count(i) for i in set(ids)) <= 2
    enc = encoding()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    want = sorted((r.doc_id, np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes()) for r in docs.collect())
    assert sorted((r.doc_id, bytes(r.ids)) for r in out) == want


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_held_out_fold(spark):
    rows = spark.range(100).select("id", held_out(F.col("id"))).collect()
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)


def saved(spark, folder, texts, labels):
    made(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_against_brute_force(spark, tmp_path):
    good = [" ".join(words(60, 300 + f)) for f in range(24)]
    texts = [(f, t) for f, t in enumerate(good)]
    texts += [(100 + f, edited(good[f].split(), 0.01, f)) for f in range(8)] + [(200 + f, good[f].replace(" ", "  ")) for f in range(4, 12)]
    texts += [(300 + f, "### $$$ %%% ||| <<< " * (5 + f)) for f in range(24)]
    folder = saved(spark, tmp_path, texts, [(i, int(i < 300), 0) for i, _ in texts])
    out = corpus_pipeline.run(spark, folder).collect()
    source = {i: None if n % 7 == 3 else f"s{n % 3}" for n, (i, _) in enumerate(texts)}
    # the learned model is the only part that is shared
    table_of = table(spark, folder, "documents")
    score = {r.doc_id: r.score for r in mil.score(table_of, mil.train(table_of, table(spark, folder, "labels"))).collect()}
    stays = [(i, t) for i, t in texts if score[i] >= 0.3]
    assert {i for i, _ in stays} == {i for i, _ in texts if i < 300}
    exact = {}
    for i, t in stays:
        best = exact.get("".join(t.split()))
        exact["".join(t.split())] = min(best or (0, 0, ""), (-len(t), i, t)) if best else (-len(t), i, t)
    left = sorted((i, t) for _, i, t in exact.values())
    classes = brute_classes(left)
    ids = {r.doc_id for r in out}
    assert len(classes) < len(left) and ids <= {i for i, _ in left}
    near = {r.doc_id for r in corpus_pipeline.near(spark, spark.createDataFrame(left, "doc_id long, text string"), folder).collect()}
    assert len(near) == len(classes) and ids <= near
    # words of each source come near its target, by documents of up to 60 words
    text, sizes = dict(left), Counter()
    for i in near:
        sizes[source[i]] += len(text[i].split())
    times = Counter(r.doc_id for r in out)
    taken = Counter()
    for i, k in times.items():
        taken[source[i]] += k * len(text[i].split())
    want = brute_targets(dict(sizes))
    assert max(times.values()) <= 2 and all(abs(taken[s] - want[s]) <= 61 for s in want)
    enc = encoding()
    for r in out:
        assert list(np.frombuffer(bytes(r.ids), "<u4")) == enc.encode_ordinary(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("texts", [TEXTS, []])
def test_awkward_and_empty_tables(spark, tmp_path, texts):
    # without labels nothing is rejected
    out = corpus_pipeline.run(spark, saved(spark, tmp_path, texts, [(99, None, 0)] if texts else [])).collect()
    assert bool(out) == bool(texts) and len(out) <= 2 * len(texts)
    copies = [{1, 2, 3}, {6, 7, 8, 9}, {10, 11}]
    assert all(len({r.doc_id for r in out} & same) <= 1 for same in copies)
