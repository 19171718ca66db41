import hashlib
import tracemalloc
from collections import defaultdict

import pytest
import xxhash
from tests.llm.texts import TEXTS, docs

from pulsegrid.llm.gracededup import decisions, grace_groups, kept, normalised


def brute(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[normalised(t)].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in texts:
        best = min(groups[normalised(t)])
        out.append((i, None if best[1] else best[2], len(groups[normalised(t)]), hashlib.sha256(normalised(t)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [96 << 20, 2000])
def test_decisions_equal_brute_force(spark, budget):
    got = decisions(docs(spark), budget=budget).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(TEXTS)
    assert sum(r.kept for r in got) == len({normalised(t) for _, t in TEXTS})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("budget", [96 << 20, 2000])
def test_kept_rows_are_those_of_the_decisions(spark, budget):
    table = docs(spark)
    got = kept(table, budget=budget)
    assert got.columns == table.columns and "Join" not in got._jdf.queryExecution().toString()
    rows = got.collect()
    assert sorted(normalised(r.text) for r in rows) == sorted({normalised(t) for _, t in TEXTS})
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in decisions(table, budget=budget).where("kept").collect())
    assert got.exceptAll(table).isEmpty()


def grouped(records, **how):
    """Numbers of the records of each content, by merging lists."""

    def merge(entry, other):
        entry += other
        return 8

    return [(c, p) for c, p, _ in grace_groups(records, merge, **how) if c is not None]


def test_spills_recursively_and_compares_content():
    contents = [f"text {i % 700}".encode() for i in range(5000)]
    records = [(xxhash.xxh3_64_intdigest(c), c, [i]) for i, c in enumerate(contents)]
    got = {c: sorted(p) for c, p in grouped(records, budget=30_000, fanout=4)}
    want = defaultdict(list)
    for i, c in enumerate(contents):
        want[c].append(i)
    assert got == dict(want)
    # one hash for all: nothing can be split, contents are told apart
    same = [(7, f"{i % 50}".encode(), [i]) for i in range(500)]
    assert sorted(len(p) for _, p in grouped(same, budget=100)) == [10] * 50


def test_memory_does_not_follow_the_copies():
    hot, n = b"x" * 10_000, 100_000

    def records():
        for i in range(n):
            text = hot if i % 10 else b"%d" % i + hot[:1000]
            yield xxhash.xxh3_64_intdigest(bytes(text)), bytes(bytearray(text)), [i]

    def merge(entry, other):
        entry[0] = min(entry[0], other[0])
        return 0

    tracemalloc.start()
    merged = groups = 0
    for content, _, _ in grace_groups(records(), merge, budget=4 << 20):
        merged, groups = merged + (content is None), groups + (content is not None)
    assert merged == n - n // 10 - 1 and groups == n // 10 + 1
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()


def test_hot_group_and_empty_table(spark):
    texts = [(i, "hot text here" if i % 3 == 0 else f"cold {i}") for i in range(300)]
    got = decisions(docs(spark, texts, 8)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(texts)
    assert decisions(docs(spark, [])).collect() == [] and kept(docs(spark, [])).collect() == []
