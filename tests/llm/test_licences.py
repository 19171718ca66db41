import math
import re
import time

from tests.llm.texts import TEXTS, docs

from pulsegrid.llm.licences import AGREE, RARE, TEMPLATES, Template, by_rarity, needed, scan, vocabulary

MORE = [
    (30, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), (31, "mit license apache license general public license " * 300), (32, "Licensed under CC BY-NC 4.0."), (33, "Licensed under cc by something nc 4 0"),
    (34, "MIT License"), (35, "mit-license; licensed"), (36, "... Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files ..."),
    (37, "Permission is hereby granted"), (38, "public license"), (39, "license"), (40, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: no"), (41, "general public license at the very end of the gnu general public license"),
]
ALL = TEXTS + MORE


WHOLE = [
    (50, "/* " + TEMPLATES[1].text + " */"), (51, " ".join(t.text for t in TEMPLATES)), (52, TEMPLATES[1].text.replace("conditions", "terms").replace("express", "given")), (53, TEMPLATES[1].text[40:]),
    (54, "once " + TEMPLATES[13].text + " and again " + TEMPLATES[13].text.upper()), (55, TEMPLATES[13].text.replace("restriction", "limits")), (56, "\n".join(reversed(TEMPLATES[3].text.split()))),
]
ALL += WHOLE


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(text):
    w = split(text)
    found = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def matched(texts):
    """Labels and score of each text, by laying every template on every place."""
    sets = [set(split(t)) for _, t in texts]
    counts = {w: sum(w in own for own in sets) for w in vocabulary()}
    for i, text in texts:
        w, (_, n_base, _, _, base) = split(text), brute(text)
        labels, best = set(filter(None, base.split(","))), 1.0 if n_base else 0.0
        have = set(w)
        for t in TEMPLATES:
            key = t.key_phrase.split()
            chosen = sorted(have & set(t.words), key=lambda x: (counts[x], x))[:RARE]
            rare = [j for j, x in enumerate(t.words) if x in chosen]
            at = next(j for j in range(len(t.words)) if t.words[j : j + len(key)] == key)
            for begin in range(-len(t.words), len(w)) if set(key) <= have else ():
                stands = lambda j, x: 0 <= begin + j < len(w) and w[begin + j] == x  # noqa: B023, E731
                if sum(stands(j, t.words[j]) for j in rare) >= max(1, math.ceil(AGREE * len(rare))) and all(stands(at + j, x) for j, x in enumerate(key)):
                    labels.add(t.label)
                    best = max(best, sum(stands(j, x) for j, x in enumerate(t.words)) / len(t.words))
        yield i, ",".join(sorted(labels)), round(best, 6)


def test_labels_and_score_equal_brute_force(spark):
    got = scan(docs(spark, ALL)).collect()
    assert sorted(((r.doc_id, r.labels, r.score) for r in got), key=str) == sorted(matched(ALL), key=str)
    of = {r.doc_id: r for r in got}
    assert of[50].labels == "apache" and of[50].score == 1 and len(of[51].labels.split(",")) == len({t.label for t in TEMPLATES})
    assert of[54].labels == "mit" and of[55].labels == "" and of[56].labels == "" and 0.9 < of[52].score


def test_base_equals_brute_force_and_the_method_adds_labels(spark):
    got = scan(docs(spark, ALL)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in ALL), key=str)
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[30] == ("apache,mit", 1.0) and labels[32] == ("cc-by-nc", 1.0) and labels[33] == ("", 0.0)
    assert labels[36][0] == "mit" and labels[37] == ("", 0.0) and labels[40] == ("bsd", 1.0) and labels[1] == ("", 0.0)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_words_that_are_looked_up():
    counts = {"mit": 1, "released": 2, "under": 900, "the": 1000, "license": 800}
    assert by_rarity(counts, Template("mit", "released under the mit license", "mit license")) == ["mit", "released", "license", "under", "the"]
    assert by_rarity({"b": 3, "a": 3}, Template("x", "b a c b", "a")) == ["c", "a", "b"]
    assert [needed(k, 0.75) for k in (0, 1, 2, 3, 4, 5)] == [1, 1, 2, 3, 3, 4]
    assert all(t.key_phrase in " ".join(t.words) for t in TEMPLATES)


def test_a_long_text_takes_time_in_proportion(spark):
    def took(n):
        rows = [(1, "released under the mit license " * n), (2, TEMPLATES[1].text * (n // 80))]
        began = time.perf_counter()
        got = {r.doc_id: r for r in scan(docs(spark, rows, 1)).collect()}
        assert got[1].n_base == n and got[1].last_word == 5 * n - 2 and got[1].score == 1
        assert got[2].labels == "apache" and got[2].n_words == (n // 80) * len(TEMPLATES[1].words)
        return time.perf_counter() - began

    took(400)
    short, long = took(4000), took(32_000)  # 1 MB
    assert long < 16 * max(short, 2)


def test_empty_table_and_no_python(spark):
    out = scan(docs(spark, []))
    assert out.collect() == []
    assert "Python" not in (plan := scan(docs(spark))._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
