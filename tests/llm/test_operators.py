"""The corpus operators against brute force on a small fixture with nulls, empty and repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from xxhash import xxh64_intdigest

from logweave.llm import attention_lm, decontamination, packing, pii, quality, simhash, suffix_dedup

BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, key string, hash string, row string"
PASSAGE = "The treaty of the northern river was signed by Anna in 1848 after 12 km of marching. It fixed the border and the price of salt for good"


def fixture() -> list[tuple]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "en", "ra", "mi", "ó", "q"]) for _ in range(rng.randint(1, 3)))
    docs = [(i, " ".join(word() for _ in range(rng.choice([3, 30, 200]))) + rng.choice([".", "\n", ""])) for i in range(40)]
    shared = " ".join(word() for _ in range(80))
    docs += [(100, "a b c " + shared), (101, shared + " tail"), (102, "x" + shared), (103, shared + shared), (104, "\x0b" * 3)]
    docs += [(200, None), (201, ""), (202, " \n\t"), (None, "only words here"), (203, docs[2][1]), (204, docs[2][1])]
    docs += [(205, "ab" * 3000), (206, "z"), (206, "z"), (300, f"Before. {PASSAGE}. After"), (301, PASSAGE.lower().replace("\n", " "))]
    docs += [(304, "special <|endoftext|> strings<|startoftext|>inside"), (305, "x" * 5000 + " y")]
    docs += [(302, PASSAGE.replace("1848", "1912").replace("Anna", "Berta").replace("12", "90")), (303, "the price of salt for good and the border")]
    return [(i, t, "k", "h", "r") for i, t in docs]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA).repartition(3).cache()


def fold(i) -> int | None:
    return None if i is None else zlib.crc32(str(i).encode()) % 5


def words(t: str) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0d]+", t.encode().translate(simhash._LOWER))


def test_repeats(docs):
    texts = [(i, (t or "").encode()) for i, t, *_ in fixture()]
    seen = Counter(b[k : k + 200] for _, b in texts for k in range(len(b) - 199))
    want = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    for settings in ({}, {"broadcast_anchors": 0}, {"anchor_bytes": 1}):
        got = suffix_dedup.remove_repeats(docs, **settings).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr) == sorted(want, key=repr)


def test_language_model(docs, monkeypatch):
    monkeypatch.setattr(attention_lm, "PILOT", 40)
    rows = [(i, t or "") for i, t, *_ in fixture()]
    count = Counter(w for i, t in rows if fold(i) != 1 for w in [*words(t), b" "])
    n, v = sum(count.values()), len(count)
    want = [(i, fold(i) == 1, len(words(t)) + 1, sum(w in count for w in [*words(t), b" "]), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), b" "]), 6)) for i, t in rows]
    for head in (200_000, 5):
        got = attention_lm.score_texts(docs, BPE, head).collect()
        assert sorted(((*r[:5], round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_network_gradients_and_scores():
    rng = np.random.default_rng(1)
    symbols = attention_lm.Symbols(rng.integers(0, 50, 301).astype(float))
    counts = rng.integers(0, 4, (attention_lm.SYMBOLS, attention_lm.GROUPS)) * (rng.random((attention_lm.SYMBOLS, attention_lm.GROUPS)) < 0.1)
    pairs = attention_lm.Pairs(symbols, counts.astype(float))
    model = attention_lm.Model(symbols, pairs)
    # groups after each symbol, and ids inside each group, are distributions
    p_group = np.exp(pairs.within + pairs.prior[:, pairs.klass])
    assert abs(p_group.sum(axis=1) - 1).max() < 1e-4
    assert abs(np.bincount(symbols.group, np.exp(symbols.inside), attention_lm.GROUPS) - 1)[np.bincount(symbols.group, minlength=attention_lm.GROUPS) > 0].max() < 1e-9
    p = {k: v.astype(np.float64) for k, v in attention_lm.initial().items()}
    ids = rng.integers(0, 300, 70).astype(np.uint16)
    x, first, y, _ = model.windows(ids, np.array([0, 70]))
    goal = np.where(y >= 0, model.klass[np.maximum(y, 0)], -1).reshape(-1, attention_lm.STRIDE)
    loss, g = attention_lm.gradients(p, pairs.prior.astype(float), attention_lm.doubled(x), first, goal)
    for name in attention_lm.NAMES:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        moved = {k: w.copy() for k, w in p.items()}
        moved[name][at] += 1e-4
        assert abs((attention_lm.gradients(moved, pairs.prior.astype(float), attention_lm.doubled(x), first, goal)[0] - loss) / 1e-4 - g[name][at]) < 1e-3, name
    # batched scoring of several texts equals the loss of each and what its ids add within their classes
    data = np.concatenate([ids, ids[:5], ids[:16]])
    got = attention_lm.Scorer(p, model).texts(data, np.array([0, 70, 70, 75, 91]))
    within = model.within[x[attention_lm.STRIDE :][y >= 0], y[y >= 0]].sum() + model.inside[ids].sum() + model.inside[model.end]
    assert abs(got[0] - (-loss * 71 + within)) < 1e-2
    # causal: what comes later changes nothing earlier, nor do other texts of the batch
    alone = [attention_lm.Scorer(p, model).texts(part, np.array([0, len(part)]))[0] for part in (ids, ids[:0], ids[:5], ids[:16])]
    assert np.abs(got - alone).max() < 1e-3


def test_model_beats_word_counts_on_held_out_prose(spark):
    rng = random.Random(7)
    langs = [[f"{a}{b}" for a in x for b in y] for x, y in ((["th", "re", "wo"], ["and", "ing", "ter"]), (["sch", "ver", "ge"], ["ung", "lich", "keit"]))]
    rows = [(i, " ".join(rng.choice(langs[i % 2]) for _ in range(60))) for i in range(400)]
    got = [r for r in attention_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), BPE).collect() if r.held_out]
    assert len(got) > 40 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_fingerprints_and_components(docs):
    def fp(t):
        w = words(t)
        grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, fp(t or "")) for i, t, *_ in fixture()]
    root = list(range(len(rows)))
    find = lambda a: a if root[a] == a else find(root[a])
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(math.inf if i is None else i)
    want = [(i, f"{f:016x}", None if min(least[find(k)]) == math.inf else min(least[find(k)])) for k, (i, f) in enumerate(rows)]
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr) == sorted(want, key=repr)


def test_one_of_each_keeps_columns_and_singles(docs):
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    texts = Counter(r.text for r in got.collect())
    assert max(texts.values()) == 1 and texts[fixture()[2][1]] == 1 and texts["only words here"] == 1


@pytest.mark.parametrize("broadcast_windows", [2_000_000, 0])
def test_contamination(spark, docs, broadcast_windows):
    bench = spark.createDataFrame([(1, PASSAGE, "x"), (2, PASSAGE, "x"), (3, None, "x"), (4, "", "x"), (5, "z", "x"), (None, "z", "x")], "item_id long, text string, hash string")
    got = decontamination.contaminated(docs, bench, broadcast_windows=broadcast_windows, broadcast_rows=broadcast_windows).collect()
    # verbatim, in lower case, and with other numbers and another name; a reordered sentence is not the passage
    assert sorted((r.doc_id, r.item_id) for r in got) == [(206, 5), (300, 1), (301, 1), (302, 1)]
    kept = decontamination.decontaminate(docs, bench, broadcast_windows=broadcast_windows, broadcast_rows=broadcast_windows)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5


def test_slots_must_stand_for_one_value(spark):
    item = " then ".join(f"take 3 of the {w} and 5 of that" for w in ["red", "blue", "green", "black", "white"])
    same, mixed = item.replace("3", "8"), item
    for k in range(5):
        mixed = mixed.replace("take 3", f"take {20 + k}", 1)
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 9)]


def test_packing(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    want = []
    for i, t, *_ in fixture():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want.append((i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())))
    got = packing.pack_documents(docs, BPE, with_ids=False).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(x[3] for x in want) // 4096) + 1


def test_classifier_learns_and_keeps_columns(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["there", "is", "some", "plain", "prose", "here"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["$$", "#1", "|>", "click", "%%%"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad(), "k") for i in range(300)] + [(900, None, "k"), (901, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (fold(r.doc_id) == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert held and all(r.predicted == r.doc_id % 2 for r in held)
    net = quality.train(*quality.sample(docs, labels))
    kept = quality.keep(docs, net)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.predicted)


def test_pseudonyms_keep_format_and_link(spark):
    text = "Mail ann.lee@example.com or 10.1.2.3 on 2020-02-29, card 4111 1111 1111 1111, not 999.1.1.1 or 2021-02-30."
    docs = spark.createDataFrame([(1, text, "a"), (2, "again ann.lee@example.com", "b"), (3, None, "c")], "doc_id long, text string, found string")
    one, two, none = (r for r in pii.pseudonymise_column(docs).orderBy("doc_id").collect())
    mail = re.search(r"[^ ]+@[^ ]+", one.text)[0]
    assert mail != "ann.lee@example.com" and mail in two.text and "999.1.1.1" in one.text and "2021-02-30" in one.text
    assert "4111 1111 1111 1111" not in one.text and re.search(r"card 4\d{3} \d{4} \d{4} \d{4}", one.text)
    digits = [int(c) for c in re.search(r"card ([\d ]+)", one.text)[1] if c.isdigit()]
    assert sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    assert none.text is None and one.found == "a"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert attention_lm.score_texts(docs, BPE).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert decontamination.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert packing.pack_documents(docs, BPE, with_ids=False).count() == 0
    assert quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
