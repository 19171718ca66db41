import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from tests.llm.texts import TEXTS, docs

from pulsegrid.llm import merkle
from pulsegrid.llm.merkle import COLUMNS, Manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """All levels, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, i):
    """Each level's siblings of leaf i (left, right)."""
    out = []
    for level in levels[:-1]:
        run = level[i - i % 2 : i - i % 2 + 2]
        out.append(("".join(run[: i % 2]), "".join(run[i % 2 + 1 :])))
        i //= 2
    return out


def brute(rows, tampered=lambda r: r):
    """rows: (doc_id, source, lang, n_chars, text). Returns the rows that verified() should give."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), leaf_of(tampered(r)), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, _, leaf, now, doc_id) in enumerate(sorted(groups[g])):
            path = climb(trees[g], i) + climb(top, k)
            folded = now
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def collected(manifest):
    return sorted((tuple(r) for r in manifest.verified().collect()), key=str)


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)


def bump(r):
    if r[0] is None or r[3] is None or zlib.crc32(str(r[0]).encode()) % 7:
        return r
    return (*r[:3], r[3] + 1, r[4])


def bumped():
    return {"n_chars": F.col("n_chars") + F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0).cast("int"), F.lit(0))}


@pytest.mark.parametrize("tier", [2, 8])
def test_all_sizes_equal_brute_force(spark, monkeypatch, tier):
    monkeypatch.setattr(merkle, "TIER", tier)
    sizes = {None: 1, "": 2, "a": 3, "ab": 5, "b": 8, "c": 17, "é": 33, "z": 70}
    rows = [(1000 * k + (7 * i) % n, f"s{i % 3}", g, None if i % 5 == 4 else i, f"text {i}") for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    got = collected(Manifest(table_of(spark, rows), tampered=bumped()))
    want = brute(rows, bump)
    assert got == want and 0 < sum(not r[-1] for r in want) < len(want)


def test_awkward_rows(spark):
    table = docs(spark)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in table.collect()]
    rows += [rows[0], (None, None, None, None, None), (None, None, None, None, None), (1, "", "", 0, ""), (1, None, "", 0, "")]
    got = collected(Manifest(table_of(spark, rows)))
    assert got == brute(rows) and all(r[-1] for r in got) and len(got) == len(TEXTS) + 5


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = [(k, "s", None if k else "x", k, "t") for k in range(n)]
    manifest = Manifest(table_of(spark, rows))
    assert collected(manifest) == brute(rows)
    assert (manifest.root() is None) == (n == 0)


def test_other_columns_and_groups(spark):
    table = docs(spark).withColumn("tree", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("place", F.lit(2))
    got = Manifest(table, group="source", columns=("doc_id", "text")).verified().collect()
    assert {r.leaf for r in got} == {leaf_of(t) for t in TEXTS} and all(r.verified for r in got) and len({r.subroot for r in got}) == 4


def test_a_changed_column_is_seen_in_its_rows_alone(spark):
    rows = [(k, "s", f"l{k % 3}", k, f"text {k}") for k in range(50)]
    got = Manifest(table_of(spark, rows), tampered={"text": F.when(F.col("doc_id") == 17, F.concat("text", F.lit(" "))).otherwise(F.col("text"))}).verified()
    assert [r.doc_id for r in got.where("not verified").collect()] == [17]


def test_fields_can_not_be_shifted_between_columns(spark):
    rows = [(1, "ab", "c", None, "1:x"), (1, "a", "bc", None, "1:x"), (1, "-", None, None, "")]
    got = {r.leaf for r in Manifest(table_of(spark, rows)).verified().collect()}
    assert got == {leaf_of(r) for r in rows} and len(got) == 3 and len(COLUMNS) == 5
