import re
from collections import defaultdict

from tests.llm.texts import SCHEMA, TEXTS, docs

from pulsegrid.llm import mixing
from pulsegrid.llm.mixing import mixed, n_words, repeat_rows, sainte_lague, targets


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > repeats * sizes[s]]
        if not over:
            return out | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            out[s] = repeats * sizes[s]
            free.discard(s)
    return out


def test_targets_are_shared_anew_until_none_is_above(spark):
    for sizes in ({"a": 10, "b": 500, "c": 300, "": 70, None: 4, "é": 10}, {"x": 5}, {"a": 0, "b": 0}, {"a": 0, "b": 100, "c": 1, "d": 1000}):
        rows = spark.createDataFrame([(s, v, 1) for s, v in sizes.items()], "source string, source_size long, n_docs long")
        got = {r.source: r.target for r in targets(rows).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def highest_quotients(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats if any(weights) else 0):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_apportionment_equals_highest_quotients(spark):
    cases = [([53, 24, 23], 7), ([1000, 1, 1, 1, 1, 1, 1], 20), ([5, 5, 5, 5], 6), ([0, 3, 0], 4), ([1] * 30, 7), ([90, 7, 3], 100), ([0, 0], 3), ([10**9, 3, 2], 17), ([3, 2], 0)]
    rows = [(g, i, float(w), s) for g, (ws, s) in enumerate(cases) for i, w in enumerate(ws)]
    got = sainte_lague(spark.createDataFrame(rows, "g int, p int, w double, seats long"), ["g"], "p", "w", "seats").collect()
    for g, (ws, seats) in enumerate(cases):
        assert [r.quota for r in sorted((r for r in got if r.g == g), key=lambda r: r.p)] == highest_quotients(ws, seats), g


def test_caps_hand_seats_on(spark):
    cases = [([53, 24, 23], 17, [3, 99, 4]), ([10, 10, 10], 12, [1, 1, 50]), ([5, 4], 20, [3, 2]), ([8, 1, 1, 0], 10, [6, 9, 9, 9])]
    rows = [(g, i, float(w), s, c) for g, (ws, s, cs) in enumerate(cases) for i, (w, c) in enumerate(zip(ws, cs, strict=True))]
    got = sainte_lague(spark.createDataFrame(rows, "g int, p int, w double, seats long, most long"), ["g"], "p", "w", "seats", "most").collect()
    for g, (ws, seats, caps) in enumerate(cases):
        won = [0] * len(ws)
        for _ in range(min(seats, sum(c for w, c in zip(ws, caps, strict=True) if w))):
            won[max((i for i in range(len(ws)) if won[i] < caps[i]), key=lambda i: (ws[i] / (2 * won[i] + 1), -i))] += 1
        assert [r.quota for r in sorted((r for r in got if r.g == g), key=lambda r: r.p)] == won, g


def check(rows, texts, tolerance):
    size = {}
    by_source = defaultdict(lambda: [0, 0, 0.0])
    for n, (_, t) in enumerate(texts):
        size[n] = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r.size for r in rows) == sorted(size.values())
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    for r in rows:
        s = by_source[r.source_size]
        s[0] += r.size
        s[1] += r.taken
        s[2] = r.target
    for taken, target in ((s[1], s[2]) for s in by_source.values()):
        assert abs(taken - target) <= max(tolerance * target, 2), (taken, target)


def test_mix_comes_near_its_targets_and_repeats(spark):
    texts = [(i, "w " * (1 + i % 37)) for i in range(600)]
    table = docs(spark, texts)
    first = sorted(mixed(table).collect(), key=str)
    check(first, texts, 0.03)
    assert first == sorted(mixed(table.repartition(5)).collect(), key=str)


def test_reruns_agree_with_repeated_and_missing_ids(spark):
    texts = [(None if i % 5 == 0 else i % 40, "w " * (1 + i % 53)) for i in range(400)] + [(None, "same text here")] * 150
    table = docs(spark, texts).repartition(3)
    first = sorted(mixed(table).collect(), key=str)
    check(first, texts, 0.03)
    assert first == sorted(mixed(table.repartition(7)).collect(), key=str)
    ids = [sorted(map(str, repeat_rows(table.repartition(k)).select("doc_id", "text").collect())) for k in (2, 7)]
    assert ids[0] == ids[1]


def test_no_block_is_lost_where_a_source_is_wanted_in_full(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)  # several shards
    texts = [(i, "w " * (1 + i % 90)) for i in range(900)]
    rows = [(i, t, "en", "a" if i % 30 == 0 else "b", len(t), "k", i, [i]) for i, t in texts]
    got = mixed(spark.createDataFrame(rows, SCHEMA)).collect()
    small = [r for r in got if r.doc_id % 30 == 0]
    # 5 parts of 8 are more than twice what it has
    assert small[0].target == 2 * small[0].source_size and sum(r.taken for r in small) == small[0].target
    check(got, texts, 0.01)


def test_no_python_runs(spark):
    for out in (mixed(docs(spark)), repeat_rows(docs(spark))):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString().replace("RDD Scan", ""))


def test_awkward_rows_and_empty_table(spark):
    got = mixed(docs(spark)).collect()
    assert len(got) == len(TEXTS)
    check(got, TEXTS, 0.05)
    assert mixed(docs(spark, [])).collect() == []
    assert {r.taken for r in mixed(docs(spark, [(1, None), (2, "")])).collect()} == {0}


def test_repeated_rows_keep_their_columns(spark):
    table = docs(spark)
    out = repeat_rows(table)
    assert out.columns == table.columns
    assert out.distinct().exceptAll(table.distinct()).isEmpty()
    words = sum(r[0] for r in table.select(n_words(table.text)).collect())
    assert 0.8 * words < sum(r[0] for r in out.select(n_words(out.text)).collect()) < 2.01 * words
