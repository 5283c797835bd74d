"""Exact removal of repeated byte strings by suffix arrays that are built in two stages.

Every window of WIDTH bytes is named by its anchor, the least hash among its GRAM-byte strings; equal windows have equal
anchors. A maximal run of windows of one anchor is a segment. Anchors that occur once in the corpus are dropped, the
segments of the others are shuffled by anchor, equal segments merged on the way, and each task builds suffix arrays over
the texts of whole anchors: only suffixes smaller than their successors are sorted directly, the others are induced by
scanning the buckets of first bytes upwards, and windows whose common prefix with a neighbour reaches WIDTH are repeated.
Their spans go back to the documents that hold the segments.

Nothing is capped. An anchor whose different segments have more than ANCHOR_BYTES is split into its single windows, each
named by its own hash, before it reaches a task; a run longer than MOST_WINDOWS is cut into several segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import binary_column, byte_view, cut, slices, texts

WIDTH, GRAM = 200, 32
MOST_WINDOWS = 4096
#: Bytes of the different segments of one anchor that still go into one suffix array.
ANCHOR_BYTES = 8 << 20
#: Anchors (8 bytes each) that are broadcast at the most; with more of them documents are joined to their anchors.
BROADCAST_ANCHORS = 4_000_000
#: Bytes of segments in one suffix array, if no single anchor has more.
CHUNK = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each string of `width` bytes, by doubling; mixed, so that its order says nothing of the text."""
    out, have, power = _BYTE[data], 1, _BASE
    parts: list[tuple[np.ndarray, int]] = []
    want = width
    total: np.ndarray | None = None
    length = 0
    while want:
        if want & 1:
            if total is None:
                total, length = out, have
            else:
                n = len(data) - length - have + 1
                total = total[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + out[length : length + n]
                length += have
        want >>= 1
        if want:
            n = len(out) - have
            if n <= 0:
                return np.zeros(0, np.uint64)
            out = out[:n] * np.uint64(power) + out[have : have + n]
            have *= 2
            power = power * power % (1 << 64)
    del parts
    h = total.copy()
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each `width` neighbours."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[:-rest], x[rest:]) if rest else x


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of grams, the anchor of the window that starts at each byte, and whether it lies within one text."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    gram = rolling(data, GRAM)
    anchor = sliding(gram, WIDTH - GRAM + 1, np.minimum)
    marks = np.zeros(len(anchor) + 1, np.int32)
    first, last = at[:-1], at[1:] - WIDTH + 1  # windows [first, last) of each text
    own = last > first
    np.add.at(marks, first[own], 1)
    np.add.at(marks, last[own], -1)
    return gram, anchor, np.cumsum(marks[:-1]) > 0


def anchor_grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the grams that are some window's anchor, one for each place."""
    gram, anchor, valid = windows(data, at)
    if not valid.any():
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(gram) + WIDTH - GRAM, np.uint64)
    padded[WIDTH - GRAM : WIDTH - GRAM + len(anchor)] = np.where(valid, anchor, 0)
    return gram[(sliding(padded, WIDTH - GRAM + 1, np.maximum)[: len(gram)] == gram) & (gram > 0)]


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each segment."""
    _, anchor, valid = windows(data, at)
    if not valid.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = valid.copy()
    start[1:] &= ~(valid[:-1] & (anchor[1:] == anchor[:-1]))
    start[at[:-1][(at[:-1] < len(valid)) & (np.diff(at) >= WIDTH)]] = True
    first = np.flatnonzero(start)
    ends = np.minimum(np.append(first[1:], len(valid)), np.searchsorted(np.flatnonzero(~valid), first).astype(np.int64))
    gaps = np.append(np.flatnonzero(~valid), len(valid))
    ends = np.minimum(np.append(first[1:], len(valid)), gaps[np.searchsorted(gaps, first)])
    size = ends - first
    if (size > MOST_WINDOWS).any():
        pieces = -(-size // MOST_WINDOWS)
        whole = np.repeat(first, pieces)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = whole + k * MOST_WINDOWS
        size = np.minimum(MOST_WINDOWS, np.repeat(ends, pieces) - first)
    return anchor[first], first, size


def direct_sort(text: np.ndarray, eight: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """Places `which` in order of their first `depth` bytes (at least), ties by place; eight: the 8 bytes at each place.

    The first eight bytes are sorted; then groups of ties look at the next eight, and are sorted only if these differ.
    """
    order = which[np.argsort(eight[which], kind="stable")]
    key = eight[order]
    group = np.concatenate([[True], key[1:] != key[:-1]]) if len(order) else np.zeros(0, bool)
    for d in range(8, depth, 8):
        ends = np.append(~group[1:], False) | ~group if len(order) else group
        tied = np.flatnonzero(ends)
        if not len(tied):
            break
        head = group[tied]
        key = eight[np.minimum(order[tied] + d, len(eight) - 1)]
        differs = np.concatenate([[False], key[1:] != key[:-1]]) & ~head
        number = np.cumsum(head) - 1
        mixed = np.zeros(number[-1] + 1, bool)
        mixed[number[differs]] = True
        again = np.flatnonzero(mixed[number])
        if len(again):
            k, g = key[again], number[again]
            inside = np.lexsort((k, g))
            order[tied[again]] = order[tied[again]][inside]
            k, g = k[inside], g[inside]
            group[tied[again]] = np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])
    return order


def suffix_array(text: np.ndarray, depth: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` bytes at least, and the eight bytes at each place as big-endian numbers."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[: len(padded) - 7].view(np.uint8), (n + depth + 8, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    if n < 2:
        return np.arange(n), eight
    # a suffix is smaller than its successor if the next different byte is larger; the last one never is
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    there = np.where(step != 0, np.arange(n - 1), n - 1)
    there = np.minimum.accumulate(there[::-1])[::-1]
    smaller = np.append(np.append(step, -1)[there] > 0, False)
    direct = direct_sort(text, eight, np.flatnonzero(smaller), depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = np.empty(n, np.int64)
    filled = 0
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        parts = []
        while len(wave):
            parts.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        parts.append(direct[cuts[c] : cuts[c + 1]])
        bucket = np.concatenate(parts)
        out[filled : filled + len(bucket)] = bucket
        filled += len(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        up = first > c
        before, first = before[up], first[up]
        by = np.argsort(first, kind="stable")
        before, ends = before[by], np.searchsorted(first[by], np.arange(257))
        for k in np.unique(first).tolist():
            waiting[k].append(before[ends[k] : ends[k + 1]])
    return out, eight


def repeated(data: np.ndarray, start: np.ndarray, count: np.ndarray, copies: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each byte of data, whether a window that starts there is one of a segment's and occurs more than once.

    Segment i has the windows start[i] .. start[i] + count[i] - 1 and stands for copies[i] equal segments.
    """
    marks = np.zeros(len(data) + 1, np.int32)
    np.add.at(marks, start, 1)
    np.add.at(marks, start + count, -1)
    inside = np.cumsum(marks[:-1]) > 0
    many = np.zeros(len(data) + 1, np.int32)
    np.add.at(many, start[copies > 1], 1)
    np.add.at(many, (start + count)[copies > 1], -1)
    again = np.cumsum(many[:-1]) > 0
    order, eight = suffix_array(data, width)
    order = order[inside[order]]
    # adjacent common prefixes, as far as the width
    left, right = order[:-1], order[1:]
    for d in [*range(0, width - 7, 8), width - 8]:
        same = eight[left + d] == eight[right + d]
        left, right = left[same], right[same]
    again[left] = True
    again[right] = True
    return again


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            h, n = np.unique(anchor_grams(*byte_view(batch.column(1))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])


def _anchors_by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            anchor, first, _ = segments(*(view := byte_view(batch.column(1))))
            row = np.searchsorted(view[1], first, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(anchor.view(np.int64))], ["key", "anchor"])


SEGMENT = "key binary, start long, anchor long, windows long, body binary"


def _cut_segments(batch: pa.RecordBatch, wanted) -> pa.RecordBatch:
    """Segments of a batch (key, text, ...) whose anchors are wanted(anchors, rows)."""
    data, at = byte_view(batch.column(1))
    anchor, first, size = segments(data, at)
    row = np.searchsorted(at, first, "right") - 1
    keep = wanted(anchor, row)
    anchor, first, size, row = anchor[keep], first[keep], size[keep], row[keep]
    bodies = np.concatenate([[0], np.cumsum(size + WIDTH - 1)])
    spread = np.arange(bodies[-1]) - np.repeat(bodies[:-1] - first, size + WIDTH - 1)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(row)), pa.array(first - at[row]), pa.array(anchor.view(np.int64)), pa.array(size.astype(np.int64)), binary_column(data[spread], bodies).cast(pa.binary())],
        ["key", "start", "anchor", "windows", "body"],
    )


def shared_segments(docs: DataFrame, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """Segments (SEGMENT columns) of the anchors that occur more than once in docs (key, text)."""
    anchors = cut(docs.mapInArrow(_count_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    if anchors.count() <= broadcast_anchors:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(anchors.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            these = known.value

            def wanted(anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
                return these[np.minimum(np.searchsorted(these, anchor), len(these) - 1)] == anchor if len(these) else np.zeros(len(anchor), bool)

            for whole in batches:
                for batch in slices(whole):
                    yield _cut_segments(batch, wanted)

        return docs.mapInArrow(pick, SEGMENT)
    own = docs.mapInArrow(_anchors_by_document, "key binary, anchor long").join(anchors, "anchor", "left_semi").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))

    def pick_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                lists = batch.column(2)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                pairs = {*zip(owner.tolist(), lists.flatten().to_numpy().view(np.uint64).tolist(), strict=True)}
                yield _cut_segments(batch, lambda anchor, row, pairs=pairs: np.array([p in pairs for p in zip(row.tolist(), anchor.tolist(), strict=True)], bool))

    return docs.join(own, "key").select("key", "text", "anchors").mapInArrow(pick_own, SEGMENT)


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, start, copies, body in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            bytes_ = np.frombuffer(body, np.uint8)
            n = len(bytes_) - WIDTH + 1
            view = np.lib.stride_tricks.sliding_window_view(bytes_, WIDTH)
            flat = pa.array([v.tobytes() for v in view], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([a] * n, pa.int64()), pa.array([b] * n, pa.int64()), pa.array(start + np.arange(n)), pa.array([copies] * n, pa.int64()), flat], ["a", "b", "start", "copies", "body"])


def _repeated_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, a, b, copies, body) in order of anchor; gives (a, b, from, to) of repeated windows' bytes."""
    held: list[pa.RecordBatch] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = byte_view(batch.column(4))
        count = np.diff(at) - WIDTH + 1
        again = repeated(data, at[:-1], count, batch.column(3).to_numpy())
        # windows of one segment alone; the last WIDTH - 1 bytes of each body start none, so runs never touch
        first, last = runs(again)
        row = np.searchsorted(at, first, "right") - 1
        which = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column(1).take(which), batch.column(2).take(which), pa.array(first - at[row]), pa.array(last - at[row] + WIDTH - 1)], ["a", "b", "from", "to"])

    size = 0
    for batch in batches:
        anchor = batch.column(0).to_numpy()
        at = byte_view(batch.column(4))[1]
        begin = 0
        for k in np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])).tolist() if batch.num_rows else []:
            there = size + int(at[k] - at[begin])
            new = k > 0 or not held or held[-1].column(0)[-1].as_py() != anchor[0]
            if there >= CHUNK and new:
                if k > begin:
                    held.append(batch.slice(begin, k - begin))
                if held:
                    yield work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, size, begin = [], 0, k
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
            size += int(at[-1] - at[begin])
    if held:
        yield work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for whole in batches:
        for batch in slices(whole):
            data, at = byte_view(batch.column(1))
            spans = batch.column(2)
            lengths = spans.value_lengths().fill_null(0).to_numpy()
            flat = spans.flatten()
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            marks = np.zeros(len(data) + 1, np.int32)
            np.add.at(marks, flat.field(0).to_numpy() + at[owner], 1)
            np.add.at(marks, flat.field(1).to_numpy() + at[owner], -1)
            gone = np.cumsum(marks[:-1]) > 0
            kept = np.concatenate([[0], np.cumsum(~gone)])[at]
            # a run that goes on over the border of two texts is two spans
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            edge[at[:-1][np.diff(at) > 0]] = gone[at[:-1][np.diff(at) > 0]]
            first = np.flatnonzero(edge)
            row = np.searchsorted(at, first, "right") - 1
            stops = np.append(np.flatnonzero(~gone), len(data))
            last = np.minimum(stops[np.searchsorted(stops, first)], at[row + 1])
            found = pa.StructArray.from_arrays([pa.array(first - at[row]), pa.array(last - at[row])], ["start", "end"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_column(data[~gone], kept).cast(pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), found).cast(kind), pa.array(np.diff(at))], ["doc_id", "kept", "spans", "n_bytes"])


def remove_repeats(docs: DataFrame, broadcast_anchors: int = BROADCAST_ANCHORS, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(doc_id, kept, spans, n_bytes): the bytes of each text without those under a string of WIDTH bytes that occurs twice.

    spans are the maximal removed runs as byte places of the input. A null text is empty. Repeated rows are documents of
    their own, so each repeats the other; texts shorter than WIDTH bytes are kept whole; a null doc_id is carried.
    """
    # 128 bits, since cutting another text's bytes must not happen however many texts there are
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))
    rows = texts(docs).withColumn("key", F.unhex(F.md5(name.cast("binary"))))
    parts = cut(shared_segments(rows.select("key", "text"), broadcast_anchors).withColumn("a", F.xxhash64("body")).withColumn("b", F.xxhash64(F.lit(1), "body")))
    different = parts.groupBy("anchor", "a", "b").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("copies"))
    different = cut(different)
    crowded = different.groupBy("anchor").agg(F.sum(F.length("body")).alias("n")).where(F.col("n") > anchor_bytes).select("anchor")
    if crowded.limit(1).count():
        alone = different.join(crowded, "anchor", "left_semi").select("a", "b", F.lit(0).cast("long").alias("start"), "copies", "body").mapInArrow(_single_windows, "a long, b long, start long, copies long, body binary")
        hot = cut(alone)
        twice = hot.groupBy(F.xxhash64("body").alias("anchor"), "body").agg(F.sum("copies").alias("copies"))
        named = twice.select("anchor", F.xxhash64("body").alias("a"), F.xxhash64(F.lit(1), "body").alias("b"), "copies", "body")
        found = named.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeated_spans, "a long, b long, from long, to long")
        back = hot.select(F.col("a").alias("sa"), F.col("b").alias("sb"), "start", F.xxhash64("body").alias("a"), F.xxhash64(F.lit(1), "body").alias("b"))
        hot_spans = back.join(found, ["a", "b"]).select(F.col("sa").alias("a"), F.col("sb").alias("b"), (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"))
        different = different.join(crowded, "anchor", "left_anti")
    else:
        hot_spans = None
    ordered = different.select("anchor", "a", "b", "copies", "body").repartition("anchor").sortWithinPartitions("anchor")
    spans = ordered.mapInArrow(_repeated_spans, "a long, b long, from long, to long")
    if hot_spans is not None:
        spans = spans.unionByName(hot_spans)
    placed = parts.select("key", "start", "a", "b").dropDuplicates(["key", "start"]).join(spans, ["a", "b"])
    by_text = placed.groupBy("key").agg(F.collect_list(F.struct((F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end"))).alias("spans"))
    return rows.join(by_text, "key", "left").select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, kept binary, spans array<struct<start:long,end:long>>, n_bytes long")
