"""The whole pipeline on a small folder, each stage's decisions against a plain reckoning of them."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from logweave.llm import quality

BPE = public_tokenizers.path("word_bpe_49k.json")
ITEM = "A farmer sold 14 crates of apples to 3 shops and kept 9 crates for winter, so how many crates went to each of them before noon"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, hash string"


def shingles(t: str) -> frozenset:
    w = t.lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rng = random.Random(12)
    good = lambda n=80: " ".join(rng.choice(["there", "is", "some", "plain", "prose", "here", "of", "seven", "quiet", "rivers", "meadow", "stone"]) for _ in range(n))
    bad = lambda: " ".join(rng.choice(["$$", "#1", "|>", "click", "%%%", "<<<"]) for _ in range(80))
    rows = [(i, good() if i % 2 else bad()) for i in range(240)]
    base = good(200).split()
    for k in range(6):
        copy = base[:]
        copy[10 * k] = "changed"
        rows.append((1000 + k, " ".join(copy)))
    rows += [(2000, rows[1][1]), (1, rows[1][1]), (2001, None), (2002, ""), (2003, None), (None, good()), (2004, good() + " " + ITEM + " " + good()), (2005, good() + " write to ann.lee@example.com " + good()), (2006, good(9000))]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "k", "r", "h") for i, t in rows], SCHEMA)
    docs.repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(240)] + [(None, 1, 0), (7, None, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, ITEM), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_every_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
            docs = corpus_pipeline.cut(docs)
        steps[name] = (before, docs.collect())
    texts = lambda rows: sorted((r.doc_id or -1, r.text or "") for r in rows)

    before, after = steps["quality_classifier"]
    net = quality.train(*quality.sample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")))
    score = lambda t: quality.scores(net, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    assert texts(after) == texts(r for r in before if score(r.text or "") >= quality.THRESHOLD)
    assert {r.doc_id for r in after} >= {i for i in range(240) if i % 2} and not {r.doc_id for r in after} & {i for i in range(0, 240, 2)}

    before, after = steps["simhash_near_dedup"]
    sets, root = [shingles(r.text or "") for r in before], list(range(len(before)))
    find = lambda a: a if root[a] == a else find(root[a])
    for a in range(len(before)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (not sets[a] and not sets[b]) or (both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)):
                root[find(a)] = find(b)
    group = {(r.doc_id, r.text or ""): find(k) for k, r in enumerate(before)}
    assert sorted(group[r.doc_id, r.text or ""] for r in after) == sorted(set(group.values())) and len(after) < len(before)

    before, after = steps["decontamination"]
    assert texts(after) == texts(r for r in before if ITEM not in (r.text or ""))

    before, after = steps["pii_pseudonyms"]
    hide = lambda t: re.sub(r"\S+@\S+", "?", t or "")
    assert sorted(hide(r.text) for r in before) == sorted(hide(r.text) for r in after) and not [r for r in after if "ann.lee@" in (r.text or "")]

    before, after = steps["best_fit_packing"]
    plain = Tokenizer.from_file(BPE)
    want = sum(len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r.length for r in after) == want
    places: dict[int, list] = {}
    for r in after:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-want // 4096) + 1


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
