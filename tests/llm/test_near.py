import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.texts import TEXTS, docs

from pulsegrid.llm import icws
from pulsegrid.llm.common import text_buffer
from pulsegrid.llm.components import components
from pulsegrid.llm.icws import RARE, Sampler, NearDuplicates, document_frequencies, shingles, weighted_jaccard


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(n)]


def edited(base, rate, seed):
    rng = random.Random(seed)
    return " ".join(f"new{rng.random()}" if rng.random() < rate else w for w in base)


def brute_sets(texts):
    out = []
    for _, t in texts:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        out.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    df = Counter(s for c in out for s in c)
    weight = {s: 1 + 0.25 * np.log(min(max(len(texts) / n, 1), RARE)) / np.log(RARE) for s, n in df.items()}
    return out, weight


def similarity(a, b, weight):
    common = sum(min(a[s], b[s]) * weight[s] for s in a.keys() & b.keys())
    total = sum(v * weight[s] for c in (a, b) for s, v in c.items())
    return common / (total - common) if total else 1.0


def brute_classes(texts):
    sets, weight = brute_sets(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or similarity(sets[i], sets[j], weight) >= 0.8:
                parent[root(i)] = root(j)
    return Counter(root(i) for i in range(len(texts)))


def family_texts():
    texts, n = [], 0
    for f in range(12):
        base = words(120 + 20 * f, f)
        for k in range(4):
            texts.append((n, edited(base, 0.0 if k == 0 else 0.01 * k, 100 * f + k)))
            n += 1
    shared = " ".join(words(60, 999))
    for k in range(40):
        texts.append((n, " ".join(words(150, 2000 + k)) + " " + shared))
        n += 1
    return texts


def test_classes_equal_brute_force(spark):
    texts = family_texts()
    got = NearDuplicates(docs(spark, texts)).classes().collect()
    assert sorted(Counter(r.class_id for r in got).values()) == sorted(brute_classes(texts).values())
    assert all(r.class_id <= r.doc_id for r in got)


def test_awkward_rows(spark):
    got = NearDuplicates(docs(spark)).classes().collect()
    assert len(got) == len(TEXTS)
    of = {r.doc_id: (r.class_id, r.class_size) for r in got if r.doc_id is not None}
    assert of[1] == of[2] == of[3] == (1, 3)
    assert of[6] == of[7] == of[8] == of[9] and of[6][1] == 5 and of[10] == of[11]
    assert all(of[i][0] == i for i in (4, 5, 12, 13, 14, 15, 16, 17, 18))
    assert {r.class_size for r in got if r.doc_id is None} == {2}


def test_kept_rows_and_empty_table(spark):
    table = docs(spark)
    kept = NearDuplicates(table).kept()
    assert kept.columns == table.columns and kept.exceptAll(table).isEmpty()
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "10", "12", "13", "14", "15", "None", "16", "17", "18"])
    assert NearDuplicates(docs(spark, [])).classes().collect() == []


def test_large_group_of_near_copies_is_one_class(spark):
    base = words(200, 5)
    texts = [(i, edited(base, 0.0 if i == 37 else 0.012, i)) for i in range(240)] + [(1000 + i, " ".join(words(80, 50 + i))) for i in range(120)]
    got = NearDuplicates(docs(spark, texts)).classes().collect()
    largest = max(brute_classes(texts).values())
    # copies are 0.79 alike on average here: what no leader is like may stay apart
    assert max(r.class_texts for r in got) >= 0.9 * largest


def test_every_pair_of_a_bucket_is_compared(spark, monkeypatch):
    monkeypatch.setattr(icws, "CELL", 1 << 14)  # several parts in a bucket
    shared, base = " ".join(words(100, 999)), words(200, 5)
    pairs = [(2 * f + k, shared + " " + edited(words(40, f), 0.0 if k == 0 else 0.08, 5000 + f)) for f in range(60) for k in (0, 1)]
    family = [(1000 + i, edited(base, 0.0 if i == 37 else 0.012, i)) for i in range(240)]
    for texts in (pairs, family):
        got = NearDuplicates(docs(spark, texts)).classes().collect()
        assert sorted(Counter(r.class_id for r in got).values()) == sorted(brute_classes(texts).values())


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_samples_agree_as_often_as_weights_overlap(share):
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 63, 1000, dtype=np.uint64)
    sampler = Sampler(np.ones(1 << 20, np.float32), bands=200, rows=3)
    n = int(1000 * share)
    a, b = np.sort(h[: 500 + n // 2]), np.sort(h[500 - n // 2 :])
    wa, wb = (1 + x % np.uint64(3) for x in (a, b))
    same = (sampler.samples(a, wa.astype(np.float32), np.array([len(a)])) == sampler.samples(b, wb.astype(np.float32), np.array([len(b)]))).mean()
    assert abs(same - weighted_jaccard((a, wa), (b, wb))) < 0.07


def test_frequencies_count_documents(spark):
    df = spark.createDataFrame([("a b c d e f",), ("A B C D E f g a b c d e",), (None,)], "text string").repartition(3)
    n, table = document_frequencies(df)
    h, _, _, _ = shingles(*text_buffer(pa.array(["a b c d e"])))
    assert n == 3 and table[int(h[0] % np.uint64(len(table)))] == 2 and table.sum() == 2 + 7


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.key: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[301] == 300 and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
