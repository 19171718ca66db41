import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from tests.llm.texts import CLEAN, TEXTS, docs

from pulsegrid.llm import bytecnn, crf, mil
from pulsegrid.llm.common import text_buffer


def labelled(n=160, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = lambda k: [rng.choice("the of and river stone house light under walking green quiet morning letter across".split()) for _ in range(k)]  # noqa: E731, B023
        good = "\n".join(" ".join(words(14)) + "." for _ in range(6))
        bad = words(3)[0] + " intro line here.\n" + " | ".join(words(90)) + "\n" + " ".join(w + "###" for w in words(60))
        rows.append((i, good if i % 2 else bad, i % 2))
    return rows


def tables(spark):
    rows = labelled()
    return docs(spark, [r[:2] for r in rows]), spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (5, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int"), {i: y for i, _, y in rows}


def test_mil_learns_and_scores_awkward_rows(spark):
    table, labels, truth = tables(spark)
    model = mil.train(table, labels)
    got = mil.score(table, model).collect()
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    odd = mil.score(docs(spark), model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.score <= 1 for r in odd)
    kept = mil.keep_good(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score >= 0.3}
    assert mil.score(docs(spark, []), model).collect() == []


def test_mil_gradient_of_attention():
    x, counts, y = np.random.default_rng(0).normal(size=(12, mil.WIDTH)).astype(np.float32), np.array([3, 1, 5, 3]), np.array([0.0, 1, 1, 0])
    model = mil.fit(x, counts, y, epochs=200)
    assert (np.abs(model.scores(x, counts) - y) < 0.2).all()
    assert mil.fit(x, counts, np.ones(4)).scores(x, counts).tolist() == [1.0] * 4
    assert mil.fit(x[:0], counts[:0], y[:0]).scores(x, counts).tolist() == [0.5] * 4


def test_passages_of_a_long_row_do_not_hang_on_blocks():
    text = CLEAN * 9000
    raw, offsets = text_buffer(pa.array([None, text, "", "ab"]))
    features, counts = mil.passages(raw, offsets)
    assert counts.tolist() == [1, -(-len(text) // mil.PASSAGE), 1, 1] and len(features) == counts.sum()
    alone, _ = mil.passages(*text_buffer(pa.array([text[mil.PASSAGE * 10 : mil.PASSAGE * 11]])))
    assert np.allclose(features[11, :-2], alone[0, :-2])


def test_cnn_learns_languages(spark):
    rng = random.Random(2)
    langs = {"en": "the and with house over river", "de": "der und mit haus über fluß", "fr": "le et avec maison où été"}
    texts = [(i, " ".join(rng.choices(langs[k].split(), k=rng.randint(4, 90)))) for i, k in zip(range(300), itertools.cycle(langs), strict=False)]
    rows = [(i, t, list(langs)[i % 3], "s", 1) for i, t in texts] + [(900, None, "en", "s", 1), (901, "123 !!", None, "s", 1), (902, "", "zz", "s", 1), (None, "the and with house", "en", "s", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    got = {r.doc_id: r for r in bytecnn.predict(table, bytecnn.train(table)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].lang_pred == list(langs)[i % 3] for i in range(300)) >= 290
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert all(r.lang_pred == "und" for r in bytecnn.predict(docs(spark), bytecnn.Model([])).collect())


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_crf_base_counts_and_verdicts(spark):
    table, labels, truth = tables(spark)
    field = crf.train(table, labels)
    got = crf.judge(docs(spark), field).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == sorted(((i, *brute_base(t)) for i, t in TEXTS), key=str)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    judged = crf.judge(table, field).collect()
    assert sum(r.kept == bool(truth[r.doc_id]) for r in judged if not r.base_failed) >= 0.97 * sum(not r.base_failed for r in judged)
    assert crf.judge(docs(spark, []), field).collect() == []


def test_viterbi_equals_trying_all():
    rng = np.random.default_rng(4)
    for n in range(1, 9):
        field, gains = crf.Field(np.zeros(crf.WIDTH), rng.normal(size=2), rng.normal(size=(2, 2))), rng.normal(size=n) * 2
        total = lambda y: field.start[y[0]] + sum(g for g, k in zip(gains, y, strict=True) if k) + sum(field.step[a, b] for a, b in zip(y[:-1], y[1:], strict=True))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=n), key=total)
        assert tuple(map(int, field.viterbi(gains))) == best


def test_no_labels_keep_what_passes_the_base_rules(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept != r.base_failed for r in crf.judge(docs(spark), crf.train(docs(spark), none)).collect())
    assert {r.score for r in mil.score(docs(spark), mil.train(docs(spark), none)).collect()} == {0.5}


def test_cnn_convolution_and_pooling_by_hand():
    rng = np.random.default_rng(5)
    model = bytecnn.fit(rng.integers(0, 256, (8, 20)).astype(np.uint8), np.arange(8) % 2, ["a", "b"], epochs=1)
    window = rng.integers(0, 256, (1, 20)).astype(np.uint8)
    pooled = [max(sum(tables[j][window[0, i + j], f] for j in range(len(tables))) for i in range(20 - len(tables) + 1)) for tables in model.filters for f in range(bytecnn.FILTERS)]
    top, _ = model.pooled(window)
    assert np.allclose(top[0], np.array(pooled) + model.bias, atol=1e-5) and np.allclose(model.highest(window), top)
    logits = np.maximum(top[0], 0) @ model.dense + model.dense0
    assert np.allclose(model.probabilities(window)[0], np.exp(logits) / np.exp(logits).sum(), atol=1e-5)


def test_trained_cnn_on_awkward_rows_and_empty_table(spark):
    rng = np.random.default_rng(6)
    model = bytecnn.fit(rng.integers(97, 123, (60, bytecnn.WINDOW)).astype(np.uint8), np.arange(60) % 2, ["a", "b"], epochs=2)
    got = bytecnn.predict(docs(spark), model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    unlettered = {i for i, t in TEXTS if not any(map(str.isalpha, t or ""))}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == unlettered and {r.lang_pred for r in got} <= {"a", "b", "und"}
    assert bytecnn.predict(docs(spark, []), model).collect() == []


def test_mil_score_by_hand():
    rng = np.random.default_rng(9)
    counts, x = np.array([3, 1, 2]), rng.random((6, mil.WIDTH)).astype(np.float32)
    model = mil.fit(x, counts, np.array([1.0, 0.0, 1.0]), epochs=3)
    w, at = model.weights, 0
    for n, score in zip(counts, model.scores(x, counts), strict=True):
        h = np.tanh((x[at : at + n] - model.mean) / model.scale @ w["enc"] + w["enc0"])
        e = np.array([(np.tanh(v @ w["att"]) / (1 + np.exp(-(v @ w["gate"])))) @ w["out"] for v in h])
        a = np.exp(e) / np.exp(e).sum()
        z = sum(p * v for p, v in zip(a, h, strict=True))
        assert abs(score - 1 / (1 + np.exp(-(z @ w["cls"] + w["cls0"][0])))) < 1e-6
        at += n


def test_texts_that_a_cnn_is_fitted_on(spark):
    rows = [(9, f"the same id {k}", "en") for k in range(20_000)] + [(k, f"d'autres mots {k}", "fr") for k in range(100, 3100)] + [(10_000 + k, f"text {k}", f"l{k // 40}") for k in range(3000)] + [(5, "123", "de"), (6, None, "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = bytecnn.fit_texts(table, 50, 400).collect()
    by = Counter(r.lang for r in got)
    assert by["en"] == 1 and len(by) == 77 and set(by.values()) <= {1, 5} and "de" not in by  # 400 // 77
    assert sorted(map(tuple, bytecnn.fit_texts(table.repartition(2), 50, 400).collect())) == sorted(map(tuple, got))
    # more languages than texts that fit: one of each
    assert Counter(Counter(r.lang for r in bytecnn.fit_texts(table, 50, 30).collect()).values()) == {1: 77}
