"""Licence scans with a positional rare-token index, with DataFrame functions only.

All words of the templates are posted with their places. Each text is split into words once, and the number of
the template word at each place, 0 for others, is kept (`located`). A template is looked at in the files that
have all words of its mandatory key phrase. There, of its words that the file has, the RARE of highest inverse
document frequency (over all documents) are looked up; each place of one and each posting of it give a place
where the template would begin, and where AGREE of these postings meet, the key phrase is compared word by word.
The score is the share of the template's words that stand where they should. Each file is handled in its own
row: nothing but the counts of the templates' words is shuffled.

Null and empty texts have no words: no labels (an empty string), score 0. Repeated rows and ids are files
of their own; of several places of a label the best counts; an empty table gives none. Other columns aren't
read. A text's time grows with its words and those of the templates, and no place is compared with all
others: what is at a place is read from the numbers by index. Its numbers are held in memory, 4 bytes a word.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base rules and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words of a template that are looked up in a file, the rarest that it has, and the share of their postings that has to meet.
RARE, AGREE = 4, 0.75


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrase: str

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())


#: Notices of public licences, in the words they are commonly given in.
TEMPLATES = (
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template(
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
        copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under
        the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
        "except in compliance with the license",
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template(
        "bsd",
        """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution.""",
        "must retain the above copyright notice",
    ),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
        "for any purpose with or without fee",
    ),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template(
        "mit",
        """to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
        "to deal in the software without restriction",
    ),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def words(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), _BETWEEN), "")


def vocabulary(templates: Sequence[Template] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.words} | {w for p, _ in PHRASES for w in p.split()})


def located(docs: DataFrame, id_col: str, text_col: str, vocab: Sequence[str]) -> DataFrame:
    """id and `at`: for each word of the text its number in the vocabulary, from 1, or 0."""
    own = F.array(*map(F.lit, vocab))
    split = docs.select(F.col(f"`{id_col}`").alias("id"), words(F.col(f"`{text_col}`")).alias("words"))
    number = lambda word: F.when(word.isin(list(vocab)), F.array_position(own, word).cast("int")).otherwise(F.lit(0))
    return written(split.select("id", F.transform("words", number).alias("at")), "located")


def document_frequencies(found: DataFrame, vocab: Sequence[str]) -> tuple[int, dict[str, int]]:
    """The number of documents, and for each template word how many have it. Only template words, a fixed number, come to the driver."""
    own = F.array_union(F.array(F.lit(0)), F.array_distinct("at"))
    counts = {r[0]: r[1] for r in found.select(F.explode(own).alias("word")).groupBy("word").count().collect()}
    return counts.get(0, 0), {w: counts.get(k + 1, 0) for k, w in enumerate(vocab)}


def by_rarity(counts: dict[str, int], template: Template) -> list[str]:
    """A template's words, those of highest inverse document frequency first; of equals the first by name."""
    return sorted(set(template.words), key=lambda w: (counts.get(w, 0), w))


def needed(postings: int, agree: float) -> int:
    """How many of a number of postings have to meet."""
    return max(1, math.ceil(round(postings * agree, 6)))


def _fixed(values: list, kind: str) -> Column:
    """Numbers, or lists of numbers, as one constant."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES, rare: int = RARE, agree: float = AGREE) -> DataFrame:
    """Per row of docs: its id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocab = vocabulary(templates)
    number, base = {w: k + 1 for k, w in enumerate(vocab)}, len(vocab) + 1
    found = located(docs, id_col, text_col, vocab)
    _, counts = document_frequencies(found, vocab)
    at = F.col("at")

    # place * base + number of each template word, in order
    hit = F.array_compact(F.transform("at", lambda v, i: F.when(v > 0, i.cast("long") * base + v)))
    seen = found.select("id", "at", F.size("at").cast("long").alias("n_words"), F.array_distinct("at").alias("own"), hit.alias("hits"))

    def stand(phrase: list[int], begin: Column) -> Column:
        """Whether the numbers stand from a place on."""
        return functools.reduce(lambda a, b: a & b, [F.get(at, begin.cast("int") + k) == v for k, v in enumerate(phrase)])

    def starts(phrase: str) -> Column:
        first, *more = [number[w] for w in phrase.split()]
        places = F.transform(F.filter("hits", lambda v: v % base == first), lambda v: F.floor(v / base).cast("long"))
        return F.filter(places, lambda p: F.coalesce(stand(more, p + 1), F.lit(False)))

    based = seen.select("*", *[starts(p).alias(f"_p{j}") for j, (p, _) in enumerate(PHRASES)])
    base_labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"_p{j}") > 0, F.lit(label)) for j, (_, label) in enumerate(PHRASES)]))))
    based = based.select("id", "at", "n_words", "own", "hits", F.concat(*[f"_p{j}" for j in range(len(PHRASES))]).alias("_starts"), base_labels.alias("_base"))

    # of each template: its postings (place * base + number), its words by rarity, and its key phrase's postings
    lists, number_lists = "array<array<bigint>>", "array<array<int>>"
    posted = _fixed([[i * base + number[w] for i, w in enumerate(t.words)] for t in templates], lists)
    ranked = _fixed([[number[w] for w in by_rarity(counts, t)] for t in templates], number_lists)
    keys, phrases = [], [t.key_phrase.split() for t in templates]
    for t, key in zip(templates, phrases, strict=True):
        first = next(i for i in range(len(t.words)) if t.words[i : i + len(key)] == key)
        keys.append([(first + i) * base + number[w] for i, w in enumerate(key)])
    key_words, keys = _fixed([[number[w] for w in key] for key in phrases], number_lists), _fixed(keys, lists)
    needs = _fixed([needed(k, agree) for k in range(1 + max(len(t.words) for t in templates))], "array<int>")
    labels = F.array(*[F.lit(t.label) for t in templates])

    def meets(t: Column) -> Column:
        """Where a template may begin: the differences of places and postings of its rarest words here that come up often enough, each once."""
        looked_up = F.slice(F.filter(F.get(ranked, t), lambda w: F.array_contains("own", w)), 1, rare)

        def begins(postings: Column) -> Column:
            each = lambda q: F.transform(F.filter("hits", lambda v: v % base == q % base), lambda v: F.floor(v / base).cast("long") - F.floor(q / base).cast("long"))
            need = F.get(needs, F.size(postings))
            often = lambda votes: F.filter(votes, lambda x, i: ((i == 0) | (F.get(votes, i - 1) != x)) & F.coalesce(F.get(votes, i + need - 1) == x, F.lit(False)))
            return _let(F.array_sort(F.flatten(F.transform(postings, each))), often)

        return _let(looked_up, lambda own: _let(F.filter(F.get(posted, t), lambda q: F.array_contains(own, (q % base).cast("int"))), begins))

    def standing(postings: Column, begin: Column) -> Column:
        """How many of the postings stand in a template that begins at a place."""
        return F.aggregate(postings, F.lit(0), lambda n, q: n + F.coalesce((F.get(at, (begin + F.floor(q / base)).cast("int")) == q % base).cast("int"), F.lit(0)))

    def matched(t: Column) -> Column:
        own, key = F.get(posted, t), F.get(keys, t)
        whole = F.filter(meets(t), lambda b: standing(key, b) == F.size(key))
        return F.transform(whole, lambda b: F.struct(F.get(labels, t).alias("label"), (standing(own, b) / F.size(own)).alias("score")))

    able = F.filter(F.sequence(F.lit(0), F.lit(len(templates) - 1)), lambda t: F.forall(F.get(key_words, t), lambda w: F.array_contains("own", w)))
    checked = based.select("id", "n_words", "_starts", "_base", F.flatten(F.transform(able, matched)).alias("_more"))
    score = F.when(F.size("_starts") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("_more.score")), F.lit(0.0)))
    return checked.select(
        F.col("id").alias(id_col), "n_words", F.size("_starts").cast("long").alias("n_base"), F.array_min("_starts").alias("first_word"), F.array_max("_starts").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("_base", F.col("_more.label"))), ",").alias("labels"), F.round(score, 6).alias("score"),
    )
