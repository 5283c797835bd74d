"""Benchmark decontamination by template canonicalisation.

A text is cut into numbers and words. Numbers, unit words after a number and capitalised words inside a sentence become
typed placeholders, everything else its lower-case form; windows of WINDOW such tokens are hash-joined with those of the
benchmark. A capitalised word that begins a sentence may be a name or not, so windows with one are read both ways. A
window that keeps fewer than LEAST_WORDS plain words says too little as a template; the place is matched by the shortest
longer windows that keep so many, one that goes on behind it and one that begins before it. Every window may also be
matched by its values, so a change of case hides nothing.

Slot consistency: along one alignment (place in the document less place in the item) each benchmark value must stand for
one document value and the other way round; an alignment that breaks this counts only where the values themselves agree.
The reading with names at sentence starts is held to this by itself and takes nothing from the other one.
A document is contaminated by an item if such windows cover at least COVERAGE of the item's places, equal ones included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut, slices, texts

WINDOW, LEAST_WORDS, COVERAGE = 5, 2, 0.8
#: Different benchmark windows (8 bytes each) that are broadcast to filter documents' windows at the most, and rows of windows
#: with their slots (some 100 bytes each) that are broadcast to be joined; beyond that the joins shuffle.
BROADCAST_WINDOWS, BROADCAST_ROWS = 2_000_000, 200_000
#: Text bytes whose tokens are held at a time.
SLICE = 1 << 20
#: Distinct words that a task remembers.
REMEMBERED = 150_000
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week "
    "weeks month months year years percent dollar dollars cent cents euro euros degree degrees".split()
)
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?\n]+")
NUMBER, UNIT, NAME = 1, 2, 3  # the placeholders' token numbers; words have hashes far above
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Canonical(dict):
    """Codes of tokens, and for each code its number by value and its kind."""

    def __init__(self):
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.values, self.kinds = [], []

    def __missing__(self, token: str) -> int:
        """Kinds: 0 word, 1 number, 2 unit word, 3 capitalised word, 4 sentence end."""
        from xxhash import xxh64_intdigest

        lower = token.lower()
        if token[0] in ".!?\n":
            kind = 4
        else:
            kind = 1 if token[0].isdecimal() else 2 if lower in UNITS else 3 if token[0].isupper() else 0
        self.values.append(xxh64_intdigest(lower.encode()) | 1 << 32)
        self.kinds.append(kind)
        self[token] = len(self.kinds) - 1
        return self[token]

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All tokens; then for those that end no sentence: their place among all, their text, their number by value, their
        placeholder (0: a plain word) and their placeholder if capitalised words that begin a sentence are names."""
        if len(self) > REMEMBERED:
            self.start_anew()
        found: list[str] = []
        ends = []
        for t in texts:
            found.append(".")  # a text begins a sentence
            found += TOKEN.findall(t)
            ends.append(len(found))
        code = np.array(list(map(self.__getitem__, found)), np.int64)
        value, kind = np.array(self.values, np.uint64)[code], np.array(self.kinds, np.int8)[code]
        before = np.concatenate([[4], kind[:-1]])
        slot = np.where(kind == 1, NUMBER, np.where((kind == 2) & (before == 1), UNIT, np.where((kind == 3) & (before != 4), NAME, 0))).astype(np.int8)
        at = np.flatnonzero(kind != 4)
        named = np.where(kind == 3, NAME, slot).astype(np.int8)
        return found, at, np.searchsorted(ends, at, "right"), value[at], slot[at], named[at]


def window_hashes(numbers: np.ndarray, width: int) -> np.ndarray:
    n = len(numbers) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ numbers[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def span_hashes(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans numbers[start:end], the same wherever a span lies."""
    power = np.cumprod(np.full(len(numbers), _MIX, np.uint64))
    mixed = (numbers ^ (numbers >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(29))) * power)])
    back = np.cumprod(np.full(len(numbers), pow(int(_MIX), -1, 1 << 64), np.uint64))
    h = (sums[ends] - sums[starts]) * back[starts]
    h = (h ^ (ends - starts).astype(np.uint64)) * _MIX
    return h ^ (h >> np.uint64(29))


class Known:
    """A sorted array of hashes with a bitmap in front of it."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        bits = max(16, int(8 * max(1, len(hashes))).bit_length())
        self.low = np.uint64((1 << bits) - 1)
        self.there = np.zeros(1 << bits, bool)
        self.there[hashes & self.low] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """The places of h whose hashes are known."""
        near = np.flatnonzero(self.there[h & self.low])
        if not len(near):
            return near
        mine = h[near]
        return near[self.hashes[np.minimum(np.searchsorted(self.hashes, mine), len(self.hashes) - 1)] == mine]


VALUE, TEMPLATE, NAMED = 0, 1, 2  # readings: by values, as a template, as a template with names at sentence starts
HITS = "key long, hash long, place long, stands long, reading int, slots array<string>"


def _windows_of(keys: list[int], texts: list[str], canonical: Canonical, known: Known | None, window: int, out: list[list]) -> None:
    """Appends the windows of texts that are known (None: all of them); `stands` is the place that a window covers.

    A text of fewer tokens than a window is one window of its own width, so it only equals another whole short text.
    """
    found, at, row, value, slot, named = canonical(texts)
    count = np.bincount(row, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])

    def add(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, stands: np.ndarray, reading: int, slots_of: np.ndarray) -> None:
        which = np.arange(len(hashes)) if known is None else known.places(hashes)
        for h, i, e, p in zip(hashes[which].view(np.int64).tolist(), starts[which].tolist(), ends[which].tolist(), stands[which].tolist(), strict=True):
            slots = [] if reading == VALUE else [f"{int(slots_of[j])}:{found[at[j]].lower()}" for j in range(i, e) if slots_of[j]]
            begin = int(first[row[i]])
            for column, x in zip(out, (keys[row[i]], h, i - begin, p - begin, reading, slots), strict=True):
                column.append(x)

    if len(value) >= window:
        whole = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
        add(window_hashes(value, window)[whole], whole, whole + window, whole, VALUE, slot)
        differs = np.concatenate([[0], np.cumsum(slot != named)])
        for reading, these in ((TEMPLATE, slot), (NAMED, named)):
            numbers = np.where(these == 0, value, these.astype(np.uint64))
            new = (lambda s, e: differs[e] > differs[s]) if reading == NAMED else (lambda s, e: np.ones(len(s), bool))
            filled = np.concatenate([[0], np.cumsum(these > 0)])
            slots = filled[whole + window] - filled[whole]
            some = whole[(slots > 0) & (slots <= window - LEAST_WORDS)]
            some = some[new(some, some + window)]
            if len(some):
                add(window_hashes(numbers, window)[some], some, some + window, some, reading, these)
            dense = whole[slots > window - LEAST_WORDS]
            plain = np.flatnonzero(these == 0)
            if not len(dense) or len(plain) < LEAST_WORDS:
                continue
            # the plain words from the place on, and those up to the window's end
            ahead = np.searchsorted(plain, dense) + LEAST_WORDS - 1
            behind = np.searchsorted(plain, dense + window) - LEAST_WORDS
            fits, back = ahead < len(plain), behind >= 0
            starts = np.concatenate([dense[fits], plain[behind[back]]])
            ends = np.concatenate([plain[ahead[fits]] + 1, dense[back] + window])
            stands = np.concatenate([dense[fits], dense[back]])
            own = (row[starts] == row[ends - 1]) & new(starts, ends)
            if own.any():
                add(span_hashes(numbers, starts[own], ends[own]), starts[own], ends[own], stands[own], reading, these)
    for r in np.flatnonzero((count > 0) & (count < window)).tolist():
        here = first[r : r + 1]
        add(window_hashes(value[first[r] : first[r + 1]], int(count[r])), here, here + count[r], here, VALUE, slot)


def template_windows(rows: DataFrame, known=None, window: int = WINDOW) -> DataFrame:
    """Windows (HITS columns) of rows (key, text); `known`, a broadcast Known, keeps those in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical()
        these = None if known is None else known.value
        for whole in batches:
            for batch in slices(whole, SLICE):
                out: list[list] = [[], [], [], [], [], []]
                _windows_of(batch.column(0).to_pylist(), batch.column(1).to_pylist(), canonical, these, window, out)
                yield _batch(out)

    return rows.mapInArrow(run, HITS)


def _batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["key", "hash", "place", "stands", "reading", "slots"])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Windows (item, hash, at, covers, reading, item_slots), and (item, n_windows); items of one text are one, the least id."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), "text").where("item is not null and text is not null").groupBy("text").agg(F.min("item").alias("item"))
    found = cut(template_windows(items.select(F.col("item").alias("key"), "text"), None, window))
    places = found.select(F.col("key").alias("item"), "hash", F.col("place").alias("at"), F.col("stands").alias("covers"), "reading", F.col("slots").alias("item_slots"))
    size = places.where(F.col("reading") == VALUE).groupBy("item").agg(F.count(F.lit(1)).alias("n_windows"))
    return places, size


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(key, doc_id, item_id, n_windows, n_found, coverage) of each document and item it contains.

    key is xxhash64(doc_id, text): repeated rows are one row here. Null texts count as empty and match nothing, as do items
    without an id or a token; a null doc_id is carried. Only the named columns of either table are read.
    """
    rows = texts(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    items, size = benchmark_windows(benchmark, window)
    items = cut(items)
    hashes = items.select("hash").distinct()
    small = hashes.count() <= broadcast_windows
    known = None
    if small:
        column = np.array(hashes.toArrow().column(0).to_numpy(), np.int64)
        known = docs.sparkSession.sparkContext.broadcast(Known(column.view(np.uint64)))
    hits = template_windows(rows.select("key", "text"), known, window)
    hits = cut(hits if small else hits.join(hashes, "hash", "left_semi"))
    few = items.count() <= broadcast_rows
    side = F.broadcast(items) if few else items
    by_value = F.col("reading") == VALUE
    # by values a window needs no alignment, so one of equal windows of a document is enough
    same = hits.where(by_value).select("key", "hash").distinct().join(side.where(by_value).select("hash", "item", "covers"), "hash").select("key", "item", "covers")
    mine = hits.where(~by_value).select("key", "hash", "place", "slots", F.col("reading").alias("mine")).distinct()
    met = mine.join(side.where(~by_value), "hash").select("key", "item", (F.col("place") - F.col("at")).alias("shift"), "covers", F.greatest("mine", "reading").alias("reading"), "slots", "item_slots")
    met = cut(met)
    # each window is held to the reading it has, and one without a name at a sentence start to both
    held = met.withColumn("reading", F.explode(F.when(F.col("reading") == NAMED, F.array(F.lit(NAMED))).otherwise(F.array(F.lit(TEMPLATE), F.lit(NAMED)))))
    along = ["key", "item", "shift", "reading"]
    mapped = held.select(*along, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).select(*along, "s.item_slots", "s.slots").distinct()
    sizes = mapped.groupBy(*along).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_slots").alias("a"), F.count_distinct("slots").alias("b"))
    broken = sizes.where((F.col("n") != F.col("a")) | (F.col("n") != F.col("b"))).select(*along)
    templates = held.join(broken, along, "left_anti").select("key", "item", "covers")
    covered = templates.unionByName(same).distinct()
    counts = covered.groupBy("key", "item").agg(F.count(F.lit(1)).alias("n_found"))
    share = F.least(F.col("n_found") / F.col("n_windows"), F.lit(1.0))
    flagged = counts.join(F.broadcast(size) if few else size, "item").withColumn("coverage", share).where(F.col("coverage") >= coverage)
    ids = rows.select("key", "doc_id").distinct()
    return ids.join(flagged, "key").select("key", "doc_id", F.col("item").alias("item_id"), "n_windows", "n_found", "coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """docs, all columns, without the contaminated documents."""
    bad = contaminated(docs, benchmark, **settings).select("key").distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    return held.join(bad, "key", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
