"""Sharding, token counts and quality rules against brute force, with nulls, empty and repeated rows and clashing columns."""

import math
import random
import re
import struct
from collections import Counter

import public_tokenizers
import pytest
from xxhash import xxh64_intdigest

from logweave.llm import rules, sharding, unigram

TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h " * 4, "many plain words of no note that say little but are more than twenty in all so the rule of least words does not fail them",
    "same line\nsame line\nother\n \n \nsame line", "sym #*$ %&| <> x", "wide\x0bspaces\x0chere\r\nñandú 日本語 😀😀 zz", "  two  spaces   and\ttabs ", "qqqq" * 500, "ab" * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    words = ["there", "is", "some", "prose", "here", "café", "🜁", "x" * 40]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "one"), (3, "one")]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))) for i in range(40)]
    return spark.createDataFrame([(i, t, "k", "b", 1) for i, t in rows], "doc_id long, text string, hash string, bucket string, n int").repartition(3).cache()


def rows(docs) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def signed(v: int) -> int:
    return v - 2**64 if v >= 2**63 else v


def by_id(found) -> list[tuple]:
    return sorted((tuple(r) for r in found), key=repr)


def test_turns_fill_the_table():
    names, slots = [f"s{i}" for i in range(7)], 211
    table = sharding.fill(names, slots)
    want, turn = {}, 0
    orders = [[(a + k * b) % slots for k in range(slots)] for a, b in (sharding.preference(n, slots) for n in names)]
    while len(want) < slots:
        i = turn % len(names)
        want.setdefault(next(s for s in orders[i] if s not in want), i)
        turn += 1
    assert table == [want[s] for s in range(slots)]
    share = Counter(table).values()
    assert max(share) - min(share) <= 1
    fewer = [names[i] for i in sharding.fill(names[:-1], slots)]
    assert sum(names[a] != b for a, b in zip(table, fewer, strict=True) if a != 6) < slots // 4
    for bad in ((["a", "a"], 211), ([], 211), (["a"], 210)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_placement(docs):
    names = ["x", "y", "z"]
    table = sharding.fill(names, 101)
    slot = lambda i: 42 % 101 if i is None else signed(xxh64_intdigest(struct.pack("<q", i), 42)) % 101
    assert by_id(sharding.place(docs, names, 101).collect()) == by_id((i, slot(i), names[table[slot(i)]]) for i, _ in rows(docs))


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    sharding.write(docs, str(tmp_path / "out"), ["x", "y"], 101, 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert by_id(back.select("doc_id", "text").collect()) == by_id(docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_token_counts(docs, byte_fallback):
    from tokenizers import Tokenizer, models

    pieces, _ = unigram.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    tied = [("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁ab", -4.0), ("aba", -3.0), ("q", -1.5), ("qq", -3.0), ("o", -1.0), ("e", -1.0)]
    for vocabulary in (tied, pieces):
        octets = [(f"<0x{k:02X}>", 0.0) for k in range(256)] if byte_fallback else []
        plain = Tokenizer(models.Unigram([("<unk>", 0.0), *octets, *vocabulary], 0, byte_fallback))
        want = [(i, len(plain.encode("▁" + t.replace(" ", "▁")).ids) if t else 0) for i, t in rows(docs)]
        assert by_id(unigram.token_counts(docs, vocabulary, byte_fallback).collect()) == by_id(want)


def words(t: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0d]+", t)


def grams(t: str) -> list[int]:
    one = [signed(xxh64_intdigest(w.encode(), 42)) for w in words(t)]
    pair = lambda a, b: signed(xxh64_intdigest(struct.pack("<q", b), xxh64_intdigest(struct.pack("<q", a), 42)))
    return [h % rules.BUCKETS for h in one] + [pair(a, b) % rules.BUCKETS for a, b in zip(one, one[1:], strict=False)]


def test_rules(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 20 != 0), "k") for i in range(100, 140)] + [(102, None, "k"), (None, 1, "k"), (103, 0, "k"), (9999, 1, "k")], "doc_id long, quality int, text string")
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    raw, target = Counter(), Counter()
    for i, t in rows(docs):
        raw.update(grams(t))
        target.update(grams(t) if i in good else [])
    level = math.log((target.total() + rules.BUCKETS) / (raw.total() + rules.BUCKETS))
    want = []
    for i, t in rows(docs):
        w, g = words(t), grams(t)
        lines = [x for x in t.split("\n") if words(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        ratio = sum(math.log((target[b] + 1) / (raw[b] + 1)) - level for b in g) / len(g) if g else 0.0
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed, not failed and ratio >= rules.THRESHOLD, ratio))
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept ratio".split()
    got, want = by_id(rules.judge(docs, labels).select(*names).collect()), by_id(want)
    assert [g[:8] for g in got] == [w[:8] for w in want]
    assert all(abs(g[8] - w[8]) < 1e-9 for g, w in zip(got, want, strict=True))
    assert {w[7] for w in want} == {True, False}
    joined = rules.ratios(docs, labels, most=0).first().ratios
    assert joined == rules.ratios(docs, labels).first().ratios and len(joined) == rules.BUCKETS


def test_good_ids_of_any_size_and_sign(spark):
    ids = [-70_000, -1, 0, 1, 8, 32_768, 32_769, 2**40, None]
    docs = spark.createDataFrame([(i, "x") for i in [*ids, -2, 2, 7, 9, 2**40 + 1]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids] + [(2, 0), (7, None)], "doc_id long, quality int")
    for most in (rules.BITMAPS, 0):
        got = {r.doc_id for r in rules.good_documents(docs, labels, most).collect() if r.good}
        assert got == set(ids) - {None}


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert sharding.place(docs).count() == unigram.token_counts(docs, [("a", -1.0)]).count() == rules.judge(docs, labels).count() == 0
