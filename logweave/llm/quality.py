"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes slide over the text with a step of STEP bytes. Their rectified responses are max-pooled
over chunks of 2 * BLOCK bytes that overlap by BLOCK and cover the whole document; the mean over a document's chunks goes
through one logistic unit. Training reads whole texts of a bounded sample of labelled rows: at most TRAIN_DOCS ids of each
class, those with the least hash, and of them the ones of at most TRAIN_BYTES bytes. Scoring reads everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import byte_view, fold, slices, texts

WIDTH, STEP, BLOCK = 6, 2, 256
FILTERS, EMBEDDING = 16, 8
#: Bounds of the training sample: labelled ids of each class, and bytes of a text in it (192 MB in all at the very most).
TRAIN_DOCS, TRAIN_BYTES = 1500, 1 << 16
EPOCHS, BATCH, RATE = 8, 32, 0.01
THRESHOLD = 0.3
SEED = 7
#: Text bytes that are cut into blocks at a time, and those of them whose responses are held at a time.
SLICE, WORK = 1 << 20, 1 << 17


@dataclass
class Network:
    embedding: np.ndarray  # 256 x EMBEDDING
    kernel: np.ndarray  # WIDTH x EMBEDDING x FILTERS
    bias: np.ndarray  # FILTERS
    weight: np.ndarray  # FILTERS
    offset: float

    def tables(self) -> np.ndarray:
        """What each byte at each place of a filter adds to the filters' responses."""
        return np.einsum("be,wef->wbf", self.embedding, self.kernel).astype(np.float32)


def responses(blocks: np.ndarray, following: np.ndarray, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(blocks, places, FILTERS): responses at each place; `following` has the WIDTH - 1 bytes after each block."""
    wide = np.concatenate([blocks, following], axis=1)
    n = BLOCK // STEP
    out = np.repeat(bias[None, None, :].astype(np.float32), len(blocks), axis=0) + np.zeros((1, n, 1), np.float32)
    for w in range(WIDTH):
        out += tables[w][wide[:, w : w + BLOCK : STEP]]
    return out


def blocks_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as zero-padded blocks, the bytes that follow each block in its text, and each text's first block."""
    size = np.diff(at)
    count = np.maximum(1, -(-size // BLOCK))
    first = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros(int(first[-1]) * BLOCK + BLOCK, np.uint8)
    begin = at[0]
    for to, a, b in zip((first[:-1] * BLOCK).tolist(), (at[:-1] - begin).tolist(), (at[1:] - begin).tolist(), strict=True):
        flat[to : to + b - a] = data[a:b]
    blocks = flat[:-BLOCK].reshape(-1, BLOCK)
    following = flat[BLOCK:].reshape(-1, BLOCK)[:, : WIDTH - 1].copy()
    following[first[1:] - 1] = 0
    return blocks, following, first


def chunk_features(peaks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean over each text's chunks (pairs of neighbouring blocks; a single block alone) of the rectified maxima."""
    last = np.zeros(len(peaks), bool)
    last[first[1:] - 1] = True
    paired = np.maximum(peaks, np.concatenate([peaks[1:], peaks[-1:]]))
    single = np.diff(first) == 1
    use = np.where(last[:, None], peaks, paired) * ~(last & ~np.repeat(single, np.diff(first)))[:, None]
    return np.add.reduceat(np.maximum(use, 0), first[:-1], axis=0) / np.maximum(1, np.diff(first) - 1)[:, None]


def scores(net: Network, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text; an empty text is one block of zeros."""
    tables = net.tables()
    blocks, following, first = blocks_of(data, at)
    step = WORK // BLOCK
    peaks = np.concatenate([responses(blocks[k : k + step], following[k : k + step], tables, net.bias).max(axis=1) for k in range(0, len(blocks), step)])
    z = chunk_features(peaks, first).astype(np.float64) @ net.weight + net.offset
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(samples: list[tuple[bytes, int]], share: float, seed: int = SEED) -> Network:
    """Fit on (bytes, label) samples with both classes weighing the same; share: the score where only one class is there."""
    rng = np.random.default_rng(seed)
    p = {
        "embedding": rng.normal(0, 0.5, (256, EMBEDDING)),
        "kernel": rng.normal(0, 0.3, (WIDTH, EMBEDDING, FILTERS)),
        "bias": np.zeros(FILTERS),
        "weight": rng.normal(0, 0.3, FILTERS),
        "offset": np.zeros(1),
    }
    y = np.array([label for _, label in samples], float)
    ones = int(y.sum())
    if not samples or ones in (0, len(y)):
        level = min(max(share, 0.01), 0.99)
        return Network(p["embedding"], p["kernel"], p["bias"], np.zeros(FILTERS), float(np.log(level / (1 - level))))
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    steps = 0
    balance = np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * (len(y) - ones)))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(samples))
        for k in range(0, len(order), BATCH):
            mine = order[k : k + BATCH]
            data = np.frombuffer(b"".join(samples[i][0] for i in mine), np.uint8)
            at = np.concatenate([[0], np.cumsum([len(samples[i][0]) for i in mine])])
            blocks, following, first = blocks_of(data, at)
            wide = np.concatenate([blocks, following], axis=1)
            tables = np.einsum("be,wef->wbf", p["embedding"], p["kernel"]).astype(np.float32)
            r = responses(blocks, following, tables, p["bias"])
            where = r.argmax(axis=1)
            peaks = np.take_along_axis(r, where[:, None, :], 1)[:, 0, :]
            size = np.diff(first)
            left = np.concatenate([np.arange(a, max(a + 1, b - 1)) for a, b in zip(first[:-1], first[1:], strict=True)])
            owner = np.repeat(np.arange(len(mine)), np.maximum(1, size - 1))
            right = np.minimum(left + 1, first[owner + 1] - 1)
            second = peaks[right] > peaks[left]
            block = np.where(second, right[:, None], left[:, None])
            top = np.take_along_axis(peaks, block, 0)
            feature = np.zeros((len(mine), FILTERS))
            chunks = np.maximum(1, size - 1)
            np.add.at(feature, owner, np.maximum(top, 0))
            feature /= chunks[:, None]
            z = feature @ p["weight"] + p["offset"]
            dz = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[mine]) * balance[mine] / len(mine)
            g = {"weight": feature.T @ dz, "offset": np.array([dz.sum()])}
            dtop = (dz[:, None] * p["weight"] / chunks[:, None])[owner] * (top > 0)
            g["bias"] = dtop.sum(axis=0)
            place = np.take_along_axis(where, block, 0) * STEP
            filt = np.broadcast_to(np.arange(FILTERS), place.shape)
            dtables = np.zeros((WIDTH, 256, FILTERS))
            for w in range(WIDTH):
                np.add.at(dtables[w], (wide[block, place + w], filt), dtop)
            g["embedding"] = np.einsum("wbf,wef->be", dtables, p["kernel"])
            g["kernel"] = np.einsum("wbf,be->wef", dtables, p["embedding"])
            steps += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            for name, grad in g.items():
                m1[name] += 0.1 * (grad - m1[name])
                m2[name] += 0.001 * (grad**2 - m2[name])
                p[name] -= rate * m1[name] / (np.sqrt(m2[name]) + 1e-8)
    return Network(p["embedding"], p["kernel"], p["bias"].astype(np.float32), p["weight"], float(p["offset"][0]))


def sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[tuple[bytes, int]], float]:
    """The bounded sample and the share of label 1 among all rows that may be learned from (fold not 0, label known)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for label in (0, 1):
        own = known.where(F.col("label") == label).groupBy("doc_id", "label").count().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).select("doc_id", "label")
        picked = own if picked is None else picked.unionByName(own)
    # at most 2 * train_docs ids, one text of each: the least
    chosen = texts(docs).join(F.broadcast(picked), "doc_id").where(F.octet_length("text") <= TRAIN_BYTES)
    rows = chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    found = sorted((r["doc_id"], r["label"], r["text"].encode()) for r in rows)
    return [(b, label) for _, label, b in found], (count.get(1, 0) / max(1, sum(count.values())) if count else 0.5)


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; a null text counts as empty, a null id is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE):
                got = scores(net, *byte_view(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["doc_id", "score"])

    found = texts(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text (null: empty) scores at least the threshold."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = pa.RecordBatch.from_arrays([whole.column(at).fill_null("")], ["text"])
            good, done = [], 0
            for part in slices(batch, SLICE):
                good.append(scores(net, *byte_view(part.column(0))) >= threshold)
                done += part.num_rows
            yield whole.filter(pa.array(np.concatenate(good))) if done else whole

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labels (doc_id, quality) and score all docs.

    Without labels of both classes every document gets the share of label 1 (one half for no labels at all). An id is
    learned from once for each different label it has, by the least of its texts; labels without a document, with a null
    id or with another label than 0 or 1 are not used. Every row of docs is scored, repeated ones alike, a null text as an
    empty one; only doc_id and text are read.
    """
    net = train(*sample(docs, labels))
    return score(docs, net)
