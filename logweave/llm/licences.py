"""Licence scan by a positional index of rare licence words, in built-in expressions only.

Each template is a short notice with mandatory key phrases. How many documents have each licence word is counted over the
whole table; the two words of highest inverse document frequency of every template's leading phrase are its postings. A
file's words are looked up there; what the first words' postings and the second ones' say about (template, place) is
intersected, so a candidate has both words at their distance. Then the phrase is verified word by word, the other
mandatory phrases within SLACK words of their place. All of that happens inside the document's row: nothing is shuffled
but the counts of licence words, of which there are as many as the templates have.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import texts

# Label, notice, mandatory phrases of the notice (the leading one first).
#: Phrases that name a licence by themselves.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Words of public licence texts and of the notices that they ask for.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses license 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    ("bsd-3", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products", "without specific prior written permission"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee is hereby granted"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["without any express or implied warranty", "will the authors be held liable"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software", "released into the public domain"]),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", ["under the terms of the gnu general public license"]),
    ("gpl-2", "gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "gnu affero general public license", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("epl", "eclipse public license", ["eclipse public license"]),
    ("bsl-1", "boost software license version 1 0", ["boost software license version 1 0"]),
    ("cc0", "cc0 1 0 universal", ["cc0 1 0 universal"]),
    ("cc-by", "creative commons attribution 4 0 international", ["creative commons attribution 4 0 international"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international", ["creative commons attribution sharealike 4 0 international"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international", ["creative commons attribution noncommercial 4 0 international"]),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international", ["creative commons attribution noderivatives 4 0 international"]),
    ("cc-by", "cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "cc by sa", ["cc by sa"]),
    ("cc-by-nd", "cc by nd", ["cc by nd"]),
]
#: Words by which a word or a further phrase may be off its place, and the share of a notice's weight that its label needs.
SLACK, LEAST_SHARE = 3, 0.5
LARGE, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: A candidate is a number: template times TEMPLATE, plus PLACE, plus the phrase's place.
TEMPLATE, PLACE = 1 << 40, 1 << 10


class Template(NamedTuple):
    label: str
    base: bool
    words: list[str]
    #: (place in the notice, words) of the mandatory phrases, the leading one first.
    phrases: list[tuple[int, list[str]]]


def template(label: str, notice: str, phrases: list[str], base: bool = False) -> Template:
    words = notice.split()
    found = []
    for p in map(str.split, phrases):
        places = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        if len(p) < 2 or not places or len(words) >= PLACE:
            raise ValueError(f"{label}: a phrase has two words or more and stands in its notice: {' '.join(p)}")
        found.append((places[0], p))
    return Template(label, base, words, found)


TEMPLATES = [*(template(label, phrase, [phrase], True) for label, phrase in BASE), *(template(*x) for x in NOTICES)]


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, LARGE, SMALL), APART), "")


def word_weights(docs: DataFrame, templates: list[Template] = TEMPLATES) -> dict[str, int]:
    """Each licence word's inverse document frequency over all documents, in thousandths of a nat and at least 1."""
    known = sorted({w for t in templates for w in t.words})
    own = texts(docs).select(F.array_distinct(F.filter(split_words(F.col("text")), lambda w: w.isin(known))).alias("words"))
    # one row more than there are licence words; the empty string counts all documents
    every = own.select(F.explode(F.concat("words", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = {r["word"]: r["n"] for r in every.collect()}
    n = found.get("", 0)
    return {w: math.floor(1000 * math.log((n + 1) / (found.get(w, 0) + 1))) + 1 for w in known}


def postings(templates: list[Template], weights: dict[str, int]) -> tuple[dict[str, list[int]], dict[str, list[int]]]:
    """For the rarest and the second rarest word of each leading phrase: what to add to the word's place for a candidate."""
    out: tuple[dict, dict] = {}, {}
    for k, t in enumerate(templates):
        phrase = t.phrases[0][1]
        rare = sorted(range(len(phrase)), key=lambda i: (-weights[phrase[i]], i))[:2]
        for index, i in zip(out, rare, strict=True):
            index.setdefault(phrase[i], []).append(k * TEMPLATE + PLACE - i)
    return out


def constants(templates: list[Template], weights: dict[str, int]) -> Column:
    """The templates as one constant array of structures."""
    text = lambda ws: F.array(*map(F.lit, ws))
    rest = lambda ps: F.array(*[F.struct(F.lit(at).alias("at"), text(ws).alias("words")) for at, ws in ps]) if ps else F.array().cast("array<struct<at:int,words:array<string>>>")
    one = lambda t: F.struct(
        F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.phrases[0][0]).alias("at"), text(t.phrases[0][1]).alias("lead"), text(t.words).alias("words"),
        F.array(*[F.lit(weights[w]) for w in t.words]).alias("weights"), F.lit(sum(weights[w] for w in t.words)).alias("whole"), rest(t.phrases[1:]).alias("rest"),
    )
    return F.array(*map(one, templates))


def candidates(words: Column, index: dict[str, list[int]]) -> Column:
    """What the words that are in an index say about templates and places."""
    held = F.create_map(*[x for w, codes in sorted(index.items()) for x in (F.lit(w), F.array(*[F.lit(c).cast("long") for c in codes]))])
    hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(sorted(index)), F.struct(w.alias("w"), i.alias("i")))))
    return F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(held, h["w"]), lambda c: c + h["i"])))


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, least: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    n_base: places where a base phrase stands, of all base phrases together and overlaps included; first_word and
    last_word: the least and largest of them in words from 0, null for none. labels: base_labels, and those of notices
    whose phrases all stand within SLACK words of their places, as words do that make up `least` of the weight, sorted.
    score: the largest such share of weight where a leading phrase stands, 0 for none. Null and empty
    texts have no words; repeated rows are scanned one by one; no documents, no rows; other columns are not read.
    """
    weights = word_weights(docs, templates)
    first, second = postings(templates, weights)
    words, known = F.col("words"), constants(templates, weights)
    same = lambda at, phrase: (at >= 0) & (F.slice(words, F.greatest(at, F.lit(0)) + 1, F.size(phrase)) == phrase)
    df = texts(docs).select("doc_id", split_words(F.col("text")).alias("words"))
    df = df.select("doc_id", "words", F.size("words").alias("n"), candidates(words, first).alias("one"), candidates(words, second).alias("two"))
    df = df.withColumn("both", F.array_intersect("one", "two"))
    told = F.transform("both", lambda c: F.struct(F.floor(c / TEMPLATE).cast("int").alias("k"), (F.pmod(c, F.lit(TEMPLATE)) - PLACE).cast("int").alias("p")))
    df = df.withColumn("told", F.filter(told, lambda x: same(x["p"], F.get(known, x["k"])["lead"])))

    def judged(x: Column) -> Column:
        t = F.get(known, x["k"])
        start = x["p"] - t["at"]
        low = lambda j: F.greatest(start + j - SLACK, F.lit(0))
        near_by = lambda j: F.slice(words, low(j) + 1, F.greatest(start + j + SLACK + 1 - low(j), F.lit(0)))
        here = F.transform(t["words"], lambda w, j: F.when(F.array_contains(near_by(j), w), F.get(t["weights"], j)).otherwise(0))
        share = F.aggregate(here, F.lit(0), lambda acc, y: acc + y) / t["whole"]
        near = lambda ph: F.exists(F.sequence(F.lit(-SLACK), F.lit(SLACK)), lambda off: same(start + ph["at"] + off, ph["words"]))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), x["p"].alias("p"), share.alias("share"), (t["base"] | (share >= least) & F.forall(t["rest"], near)).alias("holds"))

    df = df.withColumn("found", F.transform("told", judged))
    names = lambda keep: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("found", keep), lambda x: x["label"]))), ",")
    df = df.withColumn("at", F.transform(F.filter("found", lambda x: x["base"]), lambda x: x["p"].cast("long")))
    return df.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").alias("first_word"),
        F.array_max("at").alias("last_word"),
        names(lambda x: x["base"]).alias("base_labels"),
        names(lambda x: x["holds"]).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
