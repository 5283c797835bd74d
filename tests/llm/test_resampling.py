"""Importance resampling against plain counting, with nulls, ties, repeated rows, hot words and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from logweave.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(t, ngram):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return len(ws), [" ".join(ws[i : i + k]) for k in range(1, ngram + 1) for i in range(len(ws) - k + 1)]


def brute(rows, target, ngram, percent, least, seed, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [features(t, ngram) for _, t in rows]
    s, t = Counter(bucket(f) for _, fs in own for f in fs), Counter(bucket(f) for x in target for f in features(x, ngram)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (nt * 0.0 + ns + buckets) / ((s[b] + 1.0) * (nt + buckets))))
    scored = []
    for (i, _), (n, fs) in zip(rows, own, strict=True):
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n, None])
    fit = sorted((x for x in scored if x[4] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for place, x in enumerate(fit[: percent * len(fit) // 100]):
        x[5] = place + 1
    return sorted(((*x[:4], x[5]) for x in scored), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    common, rare = ["the", "The", "hot"], [f"w{i}" for i in range(300)] + ["café", "日本語", "x" * 3000, "ı", "İ"]
    made = [" ".join(rng.choice(common if rng.random() < 0.6 else rare) + rng.choice(["", ",", "\n", "\x00"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [(i, t) for i, t in enumerate(made)] + [(900, None), (901, ""), (902, " .;"), (None, made[3]), (5, made[5]), (5, made[5]), (903, "hot " * 50_000), (904, made[7])]


def frames(spark, rows, target):
    docs = spark.createDataFrame([(i, t, 1, "k", 2, 3) for i, t in rows], "doc_id long, text string, row int, feature string, n int, rank int").repartition(5)
    return docs, spark.createDataFrame([(t, 1) for t in target], "text string, bucket int").repartition(2)


@pytest.mark.parametrize(("ngram", "heavy", "percent", "least", "buckets"), [(1, 8192, 10, 20, 10_000), (1, 3, 50, 1, 97), (3, 10, 100, 0, 10_000), (2, 8192, 0, 20, 31)])
def test_resample(spark, rows, ngram, heavy, percent, least, buckets):
    target = ["The hot w1 w2 w3", None, "", "only here", "w1 w1 café"]
    got = resampling.resample(*frames(spark, rows, target), ngram, percent, least, 2024, buckets, heavy).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, target, ngram, percent, least, 2024, buckets)


def test_without_a_target_or_documents(spark, rows):
    got = resampling.resample(*frames(spark, rows[:30], [])).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows[:30], [], 1, 10, 20, 2024, 10_000)
    docs, target = frames(spark, [(1, "a")], ["a b"])
    assert resampling.resample(docs.limit(0), target).collect() == []


@pytest.mark.parametrize("ngram", [1, 2, 3, 5])
def test_words_across_chunks(ngram):
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["a", "B", " ", ",", "é", "日", "long" * 9]) for _ in range(rng.randint(0, 80)))
        for size in (1, 2, 7, 30, 1000):
            n, seen = resampling.feature_counts(text, ngram, size)
            want, names = features(text, ngram)
            assert (n, {k.decode(): v for k, v in seen.items()}) == (want, dict(Counter(names))), (text, size)
