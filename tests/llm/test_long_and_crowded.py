"""Texts beyond one slice, crowded groups, several shards, and the convolution against a loop over bytes."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

from pyspark.sql import functions as F

from logweave.llm import decontamination, packing, quality, simhash, suffix_dedup, unigram

BPE = public_tokenizers.path("word_bpe_49k.json")


def test_convolution_against_a_loop():
    rng = np.random.default_rng(4)
    net = quality.Network(rng.normal(size=(256, quality.EMBEDDING)), rng.normal(size=(quality.WIDTH, quality.EMBEDDING, quality.FILTERS)), rng.normal(size=quality.FILTERS), rng.normal(size=quality.FILTERS), 0.3)
    texts = [b"", b"a", bytes(rng.integers(0, 256, 255, dtype=np.uint8)), bytes(rng.integers(0, 256, 256, dtype=np.uint8)), bytes(rng.integers(0, 256, 513, dtype=np.uint8)), bytes(rng.integers(0, 256, 3000, dtype=np.uint8))]
    block = quality.BLOCK

    def naive(text: bytes) -> float:
        n = max(1, -(-len(text) // block))
        padded = text + bytes(n * block - len(text) + quality.WIDTH)
        chunks = [(k, k + 2) for k in range(n - 1)] or [(0, 1)]
        feature = np.zeros(quality.FILTERS)
        for a, b in chunks:
            best = np.full(quality.FILTERS, -np.inf)
            for p in range(a * block, b * block, quality.STEP):
                best = np.maximum(best, net.bias + sum(net.embedding[padded[p + w]] @ net.kernel[w] for w in range(quality.WIDTH)))
            feature += np.maximum(best, 0)
        return 1 / (1 + np.exp(-(feature / len(chunks) @ net.weight + net.offset)))

    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = quality.scores(net, np.frombuffer(b"".join(texts), np.uint8), at)
    assert np.abs(got - [naive(t) for t in texts]).max() < 1e-4


def test_training_sample_is_bounded_and_whole(spark):
    docs = spark.createDataFrame([(i, "w" * (10 + i)) for i in range(60)] + [(3, "a"), (5, "x" * (quality.TRAIN_BYTES + 1))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    got, share = quality.sample(docs, labels, 9)
    assert Counter(y for _, y in got)[0] == 9 and Counter(y for _, y in got)[1] == 9 and share == 0.5
    assert got == quality.sample(docs.repartition(7), labels.repartition(3), 9)[0]
    assert all(t in {b"a", *(b"w" * (10 + i) for i in range(60))} for t, _ in got)


def test_crowded_fingerprints_in_stars(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 3)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = {b ^ (1 << i) ^ (1 << j) for b in base for i in range(0, 40, 3) for j in range(1, 64, 7)} | {rng.getrandbits(64) for _ in range(50)}
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    for broadcast in (500_000, 0):
        monkeypatch.setattr(simhash, "BROADCAST_KEYS", broadcast)
        found = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")))
        root = {v: v for v in values} | {r.node: r.root for r in found.collect()}
        own = {v: v for v in values}
        find = lambda a: a if own[a] == a else find(own[a])
        for k, a in enumerate(values):
            for b in values[:k]:
                if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 and find(a) != find(b):
                    own[max(find(a), find(b))] = min(find(a), find(b))
        assert root == {v: find(v) for v in values}


def test_several_shards_and_ids(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["the", "river", "stone"]) for _ in range(rng.choice([5, 300, 6000])))) for i in range(60)] + [(None, ""), (None, None)], "doc_id long, text string")
    pieces = packing.cut(packing.tokenize_pieces(docs, BPE).withColumn("ids_crc32", packing.F.crc32("ids")).drop("ids"))
    got = packing.place(pieces, shard_pieces=20).collect()
    assert len(got) == pieces.count() and len({r.sequence_id >> 32 for r in got}) > 2
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 4096 and sorted(o for o, _ in p) == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] for p in by.values())
    for r in packing.pack_documents(docs, BPE).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_text_longer_than_two_slices(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    long = " ".join(rng.choice(words) for _ in range(1_400_000))
    assert len(long) > 9 << 20
    docs = spark.createDataFrame([(1, long[: 5 << 20] + "(" + passage + ")" + long[5 << 20 :]), (2, "start <" + passage + "> end"), (3, long[:4000])], "doc_id long, text string")
    spans = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert spans[1][1] == len(passage) + 4000 and spans[2][1] == len(passage) and spans[3][1] == 4000
    found = decontamination.contaminated(docs, spark.createDataFrame([(7, passage)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 7), (2, 7)}
    assert len({r.fp for r in simhash.fingerprints(docs).collect()}) == 3
    count = unigram.Counter(unigram.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))[0])
    assert {r.doc_id: r.n_tokens for r in unigram.token_counts(docs.where("doc_id > 1"), unigram.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))[0]).collect()} == {2: count("start <" + passage + "> end"), 3: count(long[:4000])}


def test_rows_that_repeat_fill_many_shards(spark):
    docs = spark.createDataFrame([(None, "")] * 400 + [(5, "same words")] * 300 + [(k, "x") for k in range(20)], "doc_id long, text string").repartition(5)
    pieces = packing.tokenize_pieces(docs, BPE).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    got = packing.place(pieces, shard_pieces=40).collect()
    shards = [r.sequence_id >> 32 for r in got]
    assert len(got) == 720 and len(set(shards)) == 18 and max(shards.count(s) for s in set(shards)) < 80
    assert packing.pack_documents(docs, BPE).groupBy("doc_id").count().where("count > 1").count() == 2
