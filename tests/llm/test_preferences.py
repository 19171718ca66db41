from pulsegrid.llm.preferences import format_preferences, neighbours, paired

ROWS = [
    (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello"),
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "go away"), (1, 3, "user", "why"),
    (2, 5, None, None), (2, 5, None, None), (3, 1, "", ""), (3, 2, None, ""),
    (4, 0, "user", "alone"), (None, 0, "user", "no id"), (6, 0, "user", "x" * 100_000), (7, 0, "user", "y"), (8, None, "assistant", "a"), (8, 0, "user", "b"), (9, 0, "assistant", "a"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, c int, n int").repartition(3)


def brute(chosen, rejected):
    order = lambda rows: [(r or "", t or "") for _, r, t in sorted(((-1 if k is None else k), r or "", t or "") for k, r, t in rows)]
    c, r = order(chosen), order(rejected)
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    show = lambda rows: "".join(f"<|start|>{a}\n{b}<|end|>\n" for a, b in rows)
    mask = lambda rows: [x for a, b in rows for x in ((len(f"<|start|>{a}\n"), False), (len(f"{b}<|end|>\n"), a == "assistant"))]
    return n, show(c[:n]), show(c[n:]), mask(c[n:]), show(r[n:]), mask(r[n:])


def test_equals_brute_force(spark):
    got = {r.pair_id: r for r in format_preferences(neighbours(table(spark))).collect()}
    assert set(got) == {0, 1, 3, 4}
    for k, r in got.items():
        side = [[x[1:] for x in ROWS if x[0] == 2 * k + j] for j in (0, 1)]
        assert (r.chosen_id, r.rejected_id) == (2 * k, 2 * k + 1)
        assert (r.n_prompt_turns, r.prompt, r.chosen, [tuple(m) for m in r.chosen_mask], r.rejected, [tuple(m) for m in r.rejected_mask]) == brute(*side)
        assert sum(m.length for m in r.chosen_mask) == len(r.chosen)
    assert got[1].chosen == "" and got[1].rejected == ""


def test_pairs_that_share_a_conversation(spark):
    pairs = spark.createDataFrame([("p", 0, 1), ("q", 0, 7), ("r", 0, 99)], "pair_id string, chosen_id long, rejected_id long")
    got = {r.pair_id: r.n_prompt_turns for r in format_preferences(paired(table(spark), pairs)).collect()}
    assert got == {"p": 2, "q": 0}


def test_empty_table(spark):
    assert format_preferences(neighbours(table(spark, []))).collect() == []


def test_no_python_in_the_plan(spark):
    plan = format_preferences(neighbours(table(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
