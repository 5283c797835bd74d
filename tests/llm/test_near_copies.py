"""The near-dedup stage of the pipeline against all pairs: five-word shingles, Jaccard similarity 0.8 or more."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.llm import simhash


def shingles(t: str) -> frozenset:
    w = t.split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_edited_copies_are_one_document(spark, monkeypatch, broadcast):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", broadcast)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(30):
        base = [word() for _ in range(rng.choice([40, 120, 400]))]
        rows.append(" ".join(base))
        for _ in range(8):
            copy = base[:]
            for _ in range(rng.randint(1, max(1, len(base) // 35))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    sets = [shingles(t) for t in rows]
    root = list(range(len(rows)))
    find = lambda a: a if root[a] == a else find(root[a])
    linked = 0
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                linked += sets[a] != sets[b]
                root[find(a)] = find(b)
    assert linked > 200
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert sorted(find(k) for k in kept) == sorted({find(k) for k in range(len(rows))})


def test_work_grows_with_a_group_not_its_square(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(400):
        copy = base[:]
        copy[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    compared = []
    real = simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, *more: compared.append(pairs.count()) or real(pairs, *more))
    assert simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1
    assert sum(compared) < 40 * len(rows)


def test_repeated_rows_and_columns_without_order(spark):
    rows = [(1, "one two three", {"a": 1}), (1, "one two three", {"a": 2}), (2, "one two three", None), (3, None, None), (4, "", None), (None, "only here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    got = simhash.one_of_each(docs).collect()
    assert len(got) == 3 and {r.text or "" for r in got} == {"one two three", "", "only here"}


def test_fingerprints_link_what_bands_do_not(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = [" ".join(base), " ".join([*base[:1500], "changed", *base[1501:]]), " ".join(base + base), " ".join(base[::-1])]
    # prints that repeats alone make alike, of different sets
    line = "one line that stands in both of these texts often and says nothing of them "
    rows += [line * 400 + " ".join(base[a : a + 20]) for a in (0, 40)]
    prints = [simhash.fingerprint(simhash.shingle_hashes(t, 3)) for t in rows]
    apart = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    assert apart(0, 1) <= 2 and apart(0, 2) <= 2 and apart(4, 5) <= 2 and apart(0, 3) > 2
    # no two sets share a band
    real = simhash.sketches
    monkeypatch.setattr(simhash, "sketches", lambda docs, k: real(docs, k).withColumn("bands", F.array("id")))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert len(kept) == 4 and {3, 4, 5} < kept
