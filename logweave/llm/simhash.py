"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves; of two fingerprints that differ in at most three bits, one half differs
in at most one. Each half is indexed under its 32 variants with one bit wildcarded, so such halves meet under an equal
key. Buckets of two are verified on the spot, larger ones by an equality join. A bucket of more than BUCKET different
fingerprints is never joined with itself: its members are indexed under their 65 whole-word variants with at most one
bit flipped. Members of such a bucket differ pairwise in at most two bits, so a star to its least member loses no
reachability; that way is exact for two bits and linear in the number of fingerprints.

one_of_each, the pipeline's stage, takes its candidates from these fingerprints and links, and verifies them by the exact
Jaccard similarity. Edited copies lie farther apart than fingerprints at few bits can tell; those come from bands of
least shingle hashes, joined by equality and verified alike, in addition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import byte_view, cut, slices, texts

SEED = 42
#: Words of the shingles that a fingerprint is made of.
WORDS = 3
#: Different fingerprints of one variant bucket that are still joined pair by pair.
BUCKET = 64
#: Keys of buckets (8 bytes each) that are broadcast at the most; with more of them the join shuffles.
BROADCAST_KEYS = 500_000
#: Shingle hashes whose bits are counted at a time.
BLOCK = 1 << 16
#: Bands and least hashes in each: of pairs of similarity 0.8, all but 5 in 100 million share a band.
BANDS, ROWS = 32, 4
#: Classes of hashes, powers of two, by which common shingles are counted: few while pairs are made, many for those made.
COARSE, CLASSES = 8, 128
#: Sets of undecided buckets that have a shingle in common for it to be a rare one, by which all of them are compared.
RARE = 16
#: Text bytes whose shingles a task holds at a time.
SLICE = 1 << 20
_COARSE = [f"c{c}" for c in range(COARSE)]
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_LOWER).split()


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; of the whole sequence if it is shorter; none for no words."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -k].tolist()]
    return np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, fp, hashes): fp is the fingerprint as a signed long; no words: zero; rows map one to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE):
                fps = np.array([fingerprint(shingle_hashes(t, k)) for t in batch.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b), a < b, between the different values of column fp; with them all pairs within `bits` are connected.

    Every pair within `bits` (at most three) that shares no over-full bucket is a row; members of over-full buckets are
    linked in stars, which needs bits = 2. fps is a table of different fingerprints.
    """
    if not 1 <= bits <= 3:
        raise ValueError("two halves with one wildcard find at most three differing bits")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    # key: half (bit 37), wildcard position (bits 32-36), the half with that bit cleared
    keys = [
        F.lit((half << 37) | (i << 32)).cast("long").bitwiseOR(value.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))))
        for half, value in ((0, low), (1, high))
        for i in range(32)
    ]
    variants = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    buckets = variants.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = cut(buckets)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    twos = buckets.where("n = 2").select("a", "b").where(near)
    size = buckets.agg(F.count_if((F.col("n") > 2) & (F.col("n") <= BUCKET)).alias("few"), F.count_if(F.col("n") > BUCKET).alias("full")).first()
    pick = lambda rows, n: F.broadcast(rows) if n <= BROADCAST_KEYS else rows
    several = variants.join(pick(buckets.where((F.col("n") > 2) & (F.col("n") <= BUCKET)).select("key"), size["few"]), "key")
    joined = several.select("key", F.col("fp").alias("a")).join(several.select("key", F.col("fp").alias("b")), "key").where(F.col("a") < F.col("b")).where(near).select("a", "b")
    full = variants.join(pick(buckets.where(F.col("n") > BUCKET).select("key"), size["full"]), "key").select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    flipped = full.select("fp", F.explode(flips).alias("near"))
    stars = flipped.join(flipped.groupBy("near").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near").where("a < fp").select("a", F.col("fp").alias("b"))
    return twos.unionByName(joined).unionByName(stars).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over pairs (a, b), for nodes that have a link.

    Rounds of large-star and small-star steps, each written to the shared folder; they end when nothing changes, in about
    the logarithm of the longest path. Each step groups by node with partial minima and never gathers a neighbourhood.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        after = cut(moved)
        if not after.exceptAll(edges).limit(1).count() and not edges.exceptAll(after).limit(1).count():
            return after.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = after


def near_duplicates(docs: DataFrame, k: int = WORDS, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the least doc_id reachable over links, itself included.

    A null text counts as empty (fingerprint zero, linked like any other); repeated rows and copies share a fingerprint
    and so a component; a null doc_id is carried, and is a component's least id only where there is no other.
    """
    rows = cut(fingerprints(docs, k))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(classes.select("fp"), bits)
    roots = cut(components(found))
    owner = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    owner = owner.join(owner.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(owner, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies by their shingles --------------------------------------------------------------------------------------


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each of BANDS bands of ROWS least hashes; sets of similarity s share a key with 1 - (1 - s^ROWS)^BANDS."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[k : k + 4096, None] * _MULTIPLIERS).min(axis=0), out=least)
    least = least.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = (h ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(key, id, n, fp, bands) of rows (key, text): id stands for the set of the text's shingles, n is its size, fp is the
    fingerprint of WORDS-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for batch in slices(whole, SLICE):
                read = batch.column(1).to_pylist()
                sets = [np.unique(shingle_hashes(t, k)) for t in read]
                fps = np.array([fingerprint(shingle_hashes(t, WORDS)) for t in read], np.uint64).view(np.int64)
                ids = np.array([xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                bands = np.array([band_keys(x) for x in sets]).view(np.int64).ravel()
                ends = np.arange(0, len(bands) + 1, BANDS, dtype=np.int32)
                columns = [batch.column(0), pa.array(ids), pa.array([len(x) for x in sets], pa.int64()), pa.array(fps), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "id", "n", "fp", "bands"])

    return docs.mapInArrow(run, "key long, id long, n long, fp long, bands array<long>")


def sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, hashes) of ids (id, key): the sorted set of each one's k-word shingles as packed unsigned 64-bit numbers."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE):
                found = [np.unique(shingle_hashes(t, k)).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "hashes"])

    ids = cut(ids)
    texts_of = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, "key").select("id", "text")
    return cut(texts_of.mapInArrow(sets, "id long, hashes binary").dropDuplicates(["id"]))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (a, b) of ids whose sets have at least the Jaccard similarity `least`, counted exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = cut(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = sets_of(classes.join(ids, "id").select("id", "key"), docs, k)
    one, two = found.select(F.col("id").alias("a"), F.col("hashes").alias("x")), found.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return cut(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def rare_shingles(sets: DataFrame, rare: int = RARE) -> DataFrame:
    """(id, h) of sets (id, hashes): the shingles h that at most `rare` of the sets have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_view(batch.column(1))
            owner = np.repeat(batch.column(0).to_numpy(), np.diff(at) // 8)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.frombuffer(data.tobytes(), np.int64))], ["id", "h"])

    every = cut(sets.mapInArrow(run, "id long, h long"))
    return cut(every.join(every.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") <= rare).select("h"), "h").select("id", "h"))


def common_classes(sets: DataFrame, rare: DataFrame) -> DataFrame:
    """(id, classes, coarse ones) of sets (id, hashes): how many of each one's shingles that are not in rare (id, h) are in each
    of CLASSES classes of hashes, and of COARSE. Two sets share no more common shingles than the lesser counts of all classes
    come to."""

    def counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hashes of rows of these sizes, one row after the other, counted by row and class."""
        place = np.repeat(np.arange(len(sizes)) * CLASSES, sizes) + (hashes & (CLASSES - 1))
        return np.bincount(place, minlength=len(sizes) * CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, SLICE, "hashes"):
                data, at = byte_view(batch.column(1))
                few = batch.column(2).fill_null([])
                common = counts(np.frombuffer(data[: at[-1]].tobytes(), np.int64), np.diff(at) // 8) - counts(few.flatten().to_numpy(), few.value_lengths().to_numpy())
                ends = np.arange(0, len(common) + 1, CLASSES, dtype=np.int32)
                coarse = common.reshape(batch.num_rows, -1, COARSE).sum(1)
                columns = [pa.array(coarse[:, c], pa.int32()) for c in range(COARSE)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(common, pa.int32())), *columns], ["id", "classes", *_COARSE])

    own = rare.groupBy("id").agg(F.collect_list("h").alias("few"))
    return sets.join(own, "id", "left").select("id", "hashes", "few").mapInArrow(run, "id long, classes array<int>, " + ", ".join(f"{c} int" for c in _COARSE))


def near_prints(rows: DataFrame, bits: int) -> DataFrame:
    """Candidates (id, n, other, m) of rows (id, n, fp), sets by what links their fingerprints: every set with the least one of
    its fingerprint, and of two linked fingerprints their least ones."""
    prints = cut(rows.select("id", "n", "fp").distinct())
    owners = cut(prints.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("l"), F.count(F.lit(1)).alias("c")))
    several = owners.where("c > 1").select("fp", "l")
    same = prints.join(F.broadcast(several) if several.count() <= BROADCAST_KEYS // 10 else several, "fp").select("id", "n", F.col("l.id").alias("other"), F.col("l.n").alias("m"))
    one, two = owners.select(F.col("fp").alias("a"), F.col("l").alias("x")), owners.select(F.col("fp").alias("b"), F.col("l").alias("y"))
    near = links(owners.select("fp"), bits).join(one, "a").join(two, "b").select("x.id", "x.n", F.col("y.id").alias("other"), F.col("y.n").alias("m"))
    return same.unionByName(near)


def near_copies(docs: DataFrame, k: int = 5, least: float = 0.8, bits: int = 2) -> DataFrame:
    """(key, root) of rows (key, text): root is the least key of the component over pairs of that Jaccard similarity.

    First candidates are texts whose fingerprints are the same or differ in at most `bits` bits. Pairs that these do not
    connect already are then candidates if they share one of the band keys and fit in size. The members of a bucket are compared with two of them, those of
    least and greatest hash, which a group of near copies has in common in most of its buckets; so a group takes work in
    proportion to its members. Buckets that then still hold several components are gone through in two exact ways: members
    that share a shingle that few of them have are compared; all others share common shingles alone, and where those that
    both can have, counted by classes of hashes, are too few for the similarity, as in copies with edits of their own, a
    pair is not even made.
    """
    rows = cut(sketches(docs, k))
    classes = cut(rows.groupBy("id").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    fits = F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9
    ordered = lambda p: p.where("id != other").where(fits).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    printed = verified(ordered(near_prints(rows.where("n > 0"), bits)), classes, docs, k, least)
    joined = cut(components(printed))
    every = classes.where("n > 0").select("id", "n", F.explode("bands").alias("band"))
    member, place = F.struct("id", "n"), F.xxhash64("id")
    buckets = cut(every.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min_by(member, place).alias("low"), F.max_by(member, place).alias("high")).where("c > 1"))
    side = F.broadcast(buckets) if buckets.count() <= BROADCAST_KEYS // 10 else buckets
    members = cut(every.join(side, "band"))
    led = members.select("id", "n", F.explode(F.array("low", "high")).alias("l")).select("id", "n", F.col("l.id").alias("other"), F.col("l.n").alias("m"))
    top = lambda end, name: joined.select(F.col("node").alias(end), F.col("root").alias(name))
    apart = ordered(led).join(top("a", "p"), "a", "left").join(top("b", "q"), "b", "left").where(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b")
    found = printed.unionByName(verified(apart, classes, docs, k, least))
    roots = cut(components(found))
    inside = members.where("c > 2").select("band", "id", "n").join(roots, F.col("id") == F.col("node"), "left").select("band", "id", "n", F.coalesce("root", "id").alias("root"))
    inside = cut(inside)
    tops = inside.groupBy("band", "root").count().groupBy("band").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("several"))
    mixed = cut(inside.join(tops.where("several > 1").drop("several"), "band"))
    nodes = cut(mixed.select("id", "n", "root").distinct())
    sets = sets_of(classes.join(nodes.select("id"), "id").select("id", "key"), docs, k)
    rare = rare_shingles(sets)
    total = lambda c: F.aggregate(c, F.lit(0), lambda acc, v: acc + v)
    # at most BANDS for each id
    shared_bands = mixed.groupBy("id").agg(F.collect_list("band").alias("bands"))
    common = cut(nodes.join(common_classes(sets, rare), "id").join(shared_bands, "id").withColumn("s", total("classes")))
    x = rare.join(common.drop("classes", "bands", *_COARSE), "id")
    y = x.select("h", F.col("id").alias("other"), F.col("n").alias("m"), F.col("root").alias("other_root"))
    shared = x.join(y, "h").where("id < other and root != other_root").select("id", "n", "other", "m")
    # a set whose common shingles are too few for itself is like none of the others
    inner = mixed.select("band", "id", "main").join(common.drop("classes").where(F.col("s") >= least * F.col("n") - 1e-9), "id")
    outer = inner.where("root != main").select("band", F.col("id").alias("other"), F.col("n").alias("m"), F.col("root").alias("other_root"), F.col("s").alias("t"), F.col("bands").alias("other_bands"), *[F.col(c).alias(f"o{c}") for c in _COARSE])
    reach = lambda most: most >= least * (F.col("n") + F.col("m") - most) - 1e-9
    # a pair is made once, in the first of the bands that both are in, and from its lesser id where either could be first
    once = ((F.col("root") == F.col("main")) | (F.col("id") < F.col("other"))) & (F.array_min(F.array_intersect("bands", "other_bands")) == F.col("band"))
    by_coarse = reduce(add, [F.least(c, f"o{c}") for c in _COARSE])
    without = ordered(inner.join(outer, "band").where(F.col("root") != F.col("other_root")).where(reach(F.least("s", "t")) & reach(by_coarse) & once).select("id", "n", "other", "m"))
    # the classes are looked at once a pair, and not once for each band that a pair shares
    side = lambda a, n, c: common.select(F.col("id").alias(a), F.col("n").alias(n), F.col("classes").alias(c))
    by_class = total(F.zip_with("classes", "other_classes", lambda a, b: F.least(a, b)))
    without = cut(without).join(side("a", "n", "classes"), "a").join(side("b", "m", "other_classes"), "b").where(reach(by_class)).select("a", "b")
    rest = cut(ordered(shared).unionByName(without).distinct())
    if rest.limit(1).count():
        roots = cut(components(found.unionByName(verified(rest, classes, docs, k, least))))
    owner = classes.join(roots, F.col("id") == F.col("node"), "left").select("id", "key", F.coalesce("root", "id").alias("top"))
    owner = owner.join(owner.groupBy("top").agg(F.min("key").alias("root")), "top").select("id", "root")
    return rows.select("key", "id").join(owner, "id").select("key", "root")


def one_of_each(docs: DataFrame, k: int = 5, least: float = 0.8, bits: int = 2) -> DataFrame:
    """docs, all columns, with one document of each component of near copies: the one of least (id, text) hash.

    Near copies are texts whose sets of k-word shingles have a Jaccard similarity of at least `least`; they are looked for by
    fingerprints at `bits` bits and by bands of least hashes. Rows that repeat an
    id with its text are one document, of which the row whose JSON form is least stays. A null text counts as
    empty, and texts without words are copies of each other; an empty table stays empty.
    """
    keys = [F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))), F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), keys[0].alias("key"), keys[1].alias("key2"))
    found = near_copies(docs.select(keys[0].alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text")), k, least, bits)
    stay = found.where("key = root").select("key").distinct()
    only = held.join(stay, "key").groupBy("key", "key2").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return only.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
