"""Pattern packing: few-document length patterns, repeat counts by non-negative least squares, residuals by best fit.

One histogram of piece lengths (a fixed number of counters) goes to the driver, which fits how often each pattern of up
to MOST_PARTS length bins is to be used. Pieces are dealt by their row number to shards of about SHARD_PIECES; each shard scales the
fitted counts to its own pieces, rounds them, fills the patterns and packs what is left by best fit. A shard holds
lengths and ids of pieces only, never texts, and its size does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut, slices, texts
from logweave.llm.subwords import WordEncoder

CAPACITY = 4096
END_ID = 1
#: Length bins of a pattern. Patterns are the partitions of BINS into at most MOST_PARTS parts.
BINS = 64
MOST_PARTS = 4
SHARD_PIECES = 16_384

PIECES = "doc_id long, piece int, start long, length long, ids binary"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long"


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of documents; ids are little-endian unsigned 32-bit numbers.

    A document is its ids and then end_id; one longer than `capacity` is cut into pieces of it, the last one shorter.
    A null or empty text is the end id alone; repeated rows give repeated pieces; a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, wide = WordEncoder(tokenizer), np.uint32(end_id).tobytes(), 4 * capacity
        for whole in batches:
            for batch in slices(whole):
                doc, piece, start, length, ids = [], [], [], [], []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = encode(t) + end
                    for k in range(0, len(own), wide):
                        part = own[k : k + wide]
                        doc.append(d)
                        piece.append(k // wide)
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        ids.append(part)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return texts(docs).mapInArrow(run, PIECES)


def patterns(bins: int = BINS, most: int = MOST_PARTS) -> np.ndarray:
    """All partitions of `bins` into at most `most` parts, as rows of counts by part size (column b: parts of b + 1)."""
    found: list[list[int]] = []

    def grow(left: int, top: int, parts: list[int]) -> None:
        if left == 0:
            found.append(parts)
        elif len(parts) < most:
            for p in range(min(left, top), (left - 1) // (most - len(parts)), -1):
                grow(left - p, p, [*parts, p])

    grow(bins, bins, [])
    out = np.zeros((len(found), bins))
    for row, parts in zip(out, found, strict=True):
        for p in parts:
            row[p - 1] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a.T x - b|, by an active set of patterns; a has a row for each pattern."""
    x, used = np.zeros(len(a)), np.zeros(len(a), bool)
    tiny = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 4 * a.shape[1]):
        slope = a @ (b - a.T @ x)
        slope[used] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tiny:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            s = np.linalg.lstsq(a[at].T, b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            old = x[at]
            step = float(np.min(old[low] / np.maximum(old[low] - s[low], 1e-300)))
            x[at] = old + step * (s - old)
            used[at[low & (x[at] <= tiny)]] = False
            if not used.any():
                return np.zeros(len(a))
            x[~used] = 0
    return x


def fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Patterns that are used and how often, for a histogram by length (index 0: length 0), as shares of all pieces."""
    width = capacity // BINS
    binned = np.add.reduceat(lengths[1:], np.arange(0, capacity, width)).astype(float)
    total = binned.sum()
    if not total:
        return np.zeros((0, BINS)), np.zeros(0)
    table = patterns()
    x = nnls(table, binned / total)
    keep = x > 0
    return table[keep], x[keep]


def pack_shard(length: np.ndarray, table: np.ndarray, share: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of a shard.

    Patterns go first, largest parts first, each floor(share * pieces) times or until a bin is empty; the smallest part is
    the best fit to the room that is really left. What remains is packed by decreasing best fit into whatever has room.
    """
    n, width = len(length), capacity // BINS
    order = np.argsort(-length, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order.tolist():
        stacks[length[i]].append(i)
    have = 0  # bit L: some piece of length L is left
    for size, s in enumerate(stacks):
        if s:
            have |= 1 << size
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room: list[int] = []

    def take(most: int) -> int:
        """The longest piece left of at most `most` tokens, or -1."""
        nonlocal have
        low = have & ((2 << most) - 1)
        if not low:
            return -1
        size = low.bit_length() - 1
        i = stacks[size].pop()
        if not stacks[size]:
            have ^= 1 << size
        return i

    def put(i: int, s: int) -> None:
        sequence[i], offset[i] = s, capacity - room[s]
        room[s] -= int(length[i])

    plans = sorted(((np.repeat(np.arange(BINS), row.astype(int))[::-1].tolist(), int(c * n)) for row, c in zip(table, share, strict=True)), reverse=True)
    for parts, times in plans:
        for _ in range(times):
            if any(not have >> (b * width + 1) & ((1 << width) - 1) for b in parts[:-1]):
                break
            room.append(capacity)
            for k, b in enumerate(parts):
                i = take(min(room[-1], (b + 1) * width) if k < len(parts) - 1 else room[-1])
                if i < 0:
                    break
                put(i, len(room) - 1)
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for s, r in enumerate(room):
        opened[r].append(s)
        free |= 1 << r
    while have:
        i = take(capacity)
        size = int(length[i])
        fitting = free >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            s = opened[r].pop()
            if not opened[r]:
                free ^= 1 << r
        else:
            room.append(capacity)
            s = len(room) - 1
        put(i, s)
        opened[room[s]].append(s)
        free |= 1 << room[s]
    return sequence, offset


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces as a table with a row number each, which is written with them: pieces equal in all else have different ones."""
    return cut(pieces.withColumn("row", F.monotonically_increasing_id()))


def place(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Sequence and offset for narrow rows (doc_id, piece, start, length, ids_crc32, row); the input is a numbered() table,
    read twice, and becomes one where it has no row numbers. Shards are dealt by these, so copies spread like all others."""
    if "row" not in pieces.columns:
        pieces = numbered(pieces)
    counts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1)
    for r in counts:
        histogram[r["length"]] = r["count"]
    total = int(histogram.sum())
    table, share = fit(histogram, capacity)
    shards = max(1, -(-total // shard_pieces))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "length", "ids_crc32", "row"], kind="stable").reset_index(drop=True)
        s, at = pack_shard(part["length"].to_numpy(), table, share, capacity)
        return part.drop(columns="shard").assign(sequence_id=(int(key[0]) << 32) + s, offset=at)

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, with_ids: bool = True) -> DataFrame:
    """Documents as placed pieces, with their ids where asked: what a writer of training sequences needs.

    Empty tables give no rows. Within a sequence, pieces lie one after another from offset 0 without gaps. Repeated rows
    of one document are packed once each, wherever each falls.
    """
    pieces = tokenize_pieces(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids"))
    if not with_ids:
        return place(numbered(pieces.drop("ids"))).drop("row")
    pieces = numbered(pieces)
    return place(pieces.drop("ids")).join(pieces.select("row", "ids"), "row").drop("row")
