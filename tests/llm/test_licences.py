"""The licence scan against a plain search through the words, with nulls, empty and repeated rows and clashing columns."""

import math
import re
from collections import Counter

import pytest

from logweave.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICE = {t.label: " ".join(t.words) for t in licences.TEMPLATES if not t.base}
TEXTS = [
    None, "", " .,;", "Released under the MIT License.", "UNDER THE MIT LICENSE under the mit license and CC BY-NC 4.0", "apache license version",
    "Licensed under the Apache License, Version 2.0.", "the MİT license, under the mıt license", NOTICE["bsd"], NOTICE["mit"].replace("of charge to any", "of charge, that is, to any").upper(),
    NOTICE["bsd-3"].replace("promote products", "promote the products"), NOTICE["mit"].split(" deal ")[0], "deal in the software without restriction " + NOTICE["mit"].split(" to deal ")[0],
    "redistribution and use in source and binary forms " + "filler " * 40 + "provided that the following conditions are met", "gnu general public license version 3, or gnu general public license version 2",
    "cc by nc by nc cc by nc sa cc by sa 4 0 cc by 4 0", "license " * 3000 + "cc by nc", "ünder the mit license", "conditions are met: redistribution and use in source and binary forms",
]


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, templates=licences.TEMPLATES, slack=licences.SLACK, least=licences.LEAST_SHARE):
    split = [words(t) for t in texts]
    df = Counter(w for ws in split for w in set(ws))
    weight = lambda w: math.floor(1000 * math.log((len(texts) + 1) / (df[w] + 1))) + 1
    out = []
    for ws in split:
        at = lambda p, phrase, ws=ws: p >= 0 and ws[p : p + len(phrase)] == phrase
        places, base, labels, score = [], set(), set(), 0.0
        for t in templates:
            for p in range(len(ws)):
                if not at(p, t.phrases[0][1]):
                    continue
                start = p - t.phrases[0][0]
                share = sum(weight(w) for j, w in enumerate(t.words) if start + j + slack >= 0 and w in ws[max(start + j - slack, 0) : start + j + slack + 1]) / sum(map(weight, t.words))
                score = max(score, share)
                if t.base:
                    places.append(p)
                    base.add(t.label)
                if t.base or share >= least and all(any(at(start + r + o, ph) for o in range(-slack, slack + 1)) for r, ph in t.phrases[1:]):
                    labels.add(t.label)
        out.append((len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return out


def test_scan(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[3]), (3, TEXTS[3]), (3, TEXTS[3])]
    docs = spark.createDataFrame([(i, t, "k", 1, True) for i, t in rows], "doc_id long, text string, words string, n int, found boolean").repartition(3)
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True)), key=repr)
    got = sorted(map(tuple, licences.scan(docs).collect()), key=repr)
    assert got == want
    by_id = {x[0]: x for x in want}
    assert by_id[8][6] == "bsd" and by_id[9][6] == "mit" and by_id[10][6] == "" and by_id[11][6] == "" and by_id[12][6] == "" and by_id[13][6] == ""
    assert by_id[14][6] == "gpl-2,gpl-3" and by_id[4][2:5] == (3, 0, 9) and by_id[16][3] == 3000


def test_no_documents(spark):
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_phrase_must_stand_in_its_notice():
    for notice, phrases in (("a b c", ["a c"]), ("a b c", ["a"]), ("a b c", [])):
        with pytest.raises((ValueError, IndexError)):
            licences.template("x", notice, phrases).phrases[0]
