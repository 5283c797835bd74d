"""Importance resampling towards a target distribution, over a dictionary of distinct features.

Features are runs of consecutive words. Each document's distinct features are counted once and written; the dictionary
sums them over all texts, so that each distinct string is hashed to its bucket once. Buckets of corpus and target give
gains, and these come back to the documents' feature counts by an equality join on the string. Strings that are found in
more than one in HEAVY of all (document, feature) rows are at most HEAVY by that count: they are broadcast where they have
LONGEST characters at the most, so no other key of the shuffled join holds more than that share. Gains and the noise of one
hash are integers within some 130,000 of zero, so a table of rows by score is bounded, and its running sum places every
score in the global order without a global sort.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import cut, slices, texts

BUCKETS = 10_000
#: Longest run of words that is a feature, words a document needs to be drawn, share drawn in percent, and the noise's seed.
NGRAM, LEAST_WORDS, PERCENT, SEED = 1, 20, 10, 2024
#: Strings with more than this part of all (document, feature) rows are broadcast: at most so many, and none of more
#: characters than LONGEST, so at most some 20 MB. Longer ones that many documents have are left to the skew of the join.
HEAVY, LONGEST = 65_536, 64

_SMALL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("features", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


#: Bytes of one text whose words are held at a time.
CHUNK = 4 << 20


def word_lists(text: str, size: int = 0) -> Iterator[list[bytes]]:
    """The words of a text in lists, each of those that begin in some `size` bytes; a longer word makes its list longer."""
    small, size, start = text.encode().translate(_SMALL), size or CHUNK, 0
    while start < len(small):
        end = small.find(b" ", start + size)
        end = len(small) if end < 0 else end
        yield small[start:end].split()
        start = end


def feature_counts(text: str, ngram: int, size: int = 0) -> tuple[int, Counter]:
    """How many words a text has, and how often each run of up to `ngram` of them."""
    n, seen, last = 0, Counter(), []
    for own in word_lists(text, size):
        n += len(own)
        seen.update(own)
        # runs that began in the list before end in this one
        joined = last + own
        for k in range(2, ngram + 1):
            begin = max(0, len(last) - k + 1)
            seen.update(b" ".join(joined[i : i + k]) for i in range(begin, len(joined) - k + 1))
        last = joined[len(joined) - ngram + 1 :] if 1 < ngram <= len(joined) else joined if ngram > 1 else []
    return n, seen


def count_features(batches: Iterator[pa.RecordBatch], ngram: int) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n_words, n_features, features, counts): each text's distinct features and how often it has them."""
    for batch in batches:
        for part in slices(batch):
            sizes, names, counts = [], [], []
            for text in part.column("text").to_pylist():
                n, seen = feature_counts(text, ngram)
                sizes.append(n)
                names.append([x.decode() for x in seen])
                counts.append(list(seen.values()))
            totals = [sum(c) for c in counts]
            yield pa.record_batch([part.column("row"), part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], schema=COUNTED)


def counted(rows: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """Feature counts of rows (doc_id, text), written to the shared folder: one row for each, named by `row`."""
    kinds = "row long, doc_id long, n_words long, n_features long, features array<string>, counts array<long>"
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # the file keeps the names of rows: a task that runs again cannot give a row another one
    return cut(numbered.mapInArrow(lambda batches: count_features(batches, ngram), kinds))


def each_feature(texts_counted: DataFrame, *more: str) -> DataFrame:
    """(*more, feature, c), one row for each distinct feature of each row of counted()."""
    return texts_counted.select(*more, F.explode(F.arrays_zip("features", "counts")).alias("x")).select(*more, F.col("x.features").alias("feature"), F.col("x.counts").alias("c"))


def dictionary(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(feature, bucket, s, t, n): each distinct feature of two counted() tables, its bucket, its count in each, its rows in the first."""
    zero = F.lit(0).cast("long")
    # both sides are summed before they meet, so a frequent string sends one row a task
    own = each_feature(corpus).groupBy("feature").agg(F.sum("c").alias("s"), zero.alias("t"), F.count(F.lit(1)).alias("n"))
    theirs = each_feature(target).groupBy("feature").agg(zero.alias("s"), F.sum("c").alias("t"), zero.alias("n"))
    every = own.unionByName(theirs).groupBy("feature").agg(*[F.sum(x).alias(x) for x in ("s", "t", "n")])
    return every.select("feature", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int").alias("bucket"), "s", "t", "n")


def bucket_gains(words: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket that a dictionary() uses: floor of 1000 times the log ratio of smoothed shares."""
    held = words.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = Window.partitionBy()  # at most `buckets` rows
    whole_s, whole_t = (F.sum(x).over(every).cast("double") for x in ("s", "t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    return held.select("bucket", F.floor(1000 * F.log((t + 1) * (whole_s + buckets) / ((s + 1) * (whole_t + buckets)))).cast("long").alias("gain"))


def weights(corpus: DataFrame, words: DataFrame, gains: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight): the floored mean gain of each text's features, 0 without any."""
    gain_of = words.where("n > 0").join(F.broadcast(gains), "bucket").select("feature", "gain", "n")
    least = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] // heavy
    often = (F.col("n") > least) & (F.length("feature") <= LONGEST)
    common, rare = gain_of.where(often).drop("n"), gain_of.where(~often).drop("n")
    each = each_feature(corpus, "row")
    part = lambda df: df.groupBy("row").agg(F.sum(F.col("c") * F.col("gain")).alias("gain"))
    near = part(each.join(F.broadcast(common), "feature"))
    far = part(each.join(F.broadcast(common), "feature", "left_anti").join(rare, "feature"))
    held = ("doc_id", "n_words", "n_features")
    bare = [F.lit(None).cast("long").alias(x) for x in held]
    rows = corpus.select("row", *held, F.lit(0).cast("long").alias("gain")).unionByName(near.unionByName(far).select("row", *bare, "gain"))
    sums = rows.groupBy("row").agg(*[F.max(x).alias(x) for x in held], F.sum("gain").alias("g"))
    down = F.expr("(g - pmod(g, n_features)) div n_features")
    return sums.select("row", *held, F.when(F.col("n_features") > 0, down).otherwise(F.lit(0)).cast("long").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from a hash of seed and id (a null id: of the seed alone)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with rank: 1, 2, 3... of the floor(percent * N / 100) highest scores of the N rows with enough words, else null.

    Ties go to the smaller doc_id (null first), of rows equal in it to the smaller row.
    """
    fit = scored.where(F.col("n_words") >= least_words)
    by_score = fit.groupBy("score").agg(F.count(F.lit(1)).alias("here"))
    # one row a score
    up_to = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = by_score.select("score", F.coalesce(F.sum("here").over(up_to), F.lit(0)).alias("before"), F.expr(f"sum(here) over () * {percent} div 100").alias("drawn"))
    placed = scored.join(F.broadcast(places.where("before < drawn")), "score", "left")
    may = (F.col("n_words") >= least_words) & F.col("before").isNotNull()
    rank = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "row"))
    chosen = placed.where(may).withColumn("rank", rank.cast("long")).withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    return chosen.unionByName(placed.where(~may).withColumn("rank", F.lit(None).cast("long"))).drop("before", "drawn")


def resample(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document: which to draw so that they look like the benchmark.

    Null and empty texts have no features, weight 0, and are never drawn unless least_words is 0. Repeated rows are
    documents of their own. Without a benchmark text all shares of the target are the smoothing's. No documents, no rows;
    other columns of either table are not read.
    """
    own = counted(texts(docs), ngram)
    target = counted(benchmark.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), ngram)
    words = cut(dictionary(own, target, buckets))
    weighed = weights(own, words, bucket_gains(words, buckets), heavy)
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return draw(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")
