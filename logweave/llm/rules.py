"""Quality rules: word statistics, and a hashed n-gram log-likelihood ratio of trusted target to raw corpus.

Word unigrams and bigrams are hashed to BUCKETS counters. Two multinomials are counted over whole tables: all documents,
and the documents that a label calls good. A document's verdict is the mean over its n-grams of the smoothed
log-likelihood ratio, held against a fixed threshold, so the same text gets the same verdict wherever it lies. The table
of ratios is one row of BUCKETS numbers and enters the plan as a scalar subquery. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import texts

BUCKETS = 10_000
SMOOTHING = 1.0
#: Mean log-likelihood ratio from which on a document is kept.
THRESHOLD = -0.15
WINDOW = 8
SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Bitmaps of good ids (4 KB each, 64 MB in all) that are broadcast at the most; with more of them documents are joined.
BITMAPS = 16_384


def with_words(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more, words, n) of rows (doc_id, text, *more) without null texts."""
    return docs.select("doc_id", "text", *more).withColumn("words", F.array_remove(F.split("text", SPACE), "")).withColumn("n", F.size("words"))


def features(df: DataFrame) -> DataFrame:
    """Adds grams: the buckets of the unigrams, then of the bigrams."""
    hashed = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    pairs = F.when(F.col("n") > 1, F.sequence(F.lit(0), F.col("n") - 2)).otherwise(F.array().cast("array<int>"))
    one = F.transform("hashes", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.transform(pairs, lambda i: F.pmod(F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1)), F.lit(BUCKETS)).cast("int"))
    return hashed.withColumn("grams", F.concat(one, two))


def good_documents(docs: DataFrame, labels: DataFrame, most: int = BITMAPS) -> DataFrame:
    """docs with a column good: whether a label of quality 1 names the document (a null id: no).

    The good ids are sent as bitmaps of 32,768 ids each, 4 KB a bitmap, so that texts stay where they are. Their number is
    counted first; above `most` of them documents are joined with the ids instead, and then texts move once.
    """
    ids = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("id")).where("id is not null")
    part, place = F.bitmap_bucket_number(F.col("id")), F.bitmap_bit_position(F.col("id"))
    if ids.select(part.alias("part")).distinct().limit(most + 1).count() > most:
        return docs.join(ids.select(F.col("id").alias("doc_id"), F.lit(True).alias("good")).distinct(), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    maps = ids.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(place).alias("map"))
    own = docs.withColumn("part", F.bitmap_bucket_number("doc_id")).withColumn("bit", F.bitmap_bit_position("doc_id"))
    octet = F.conv(F.hex(F.substring(F.col("map"), F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = own.join(F.broadcast(maps), "part", "left")
    return marked.withColumn("good", F.coalesce(F.expr("(1 << cast(bit % 8 as int))").bitwiseAND(octet) != 0, F.lit(False))).drop("part", "bit", "map")


def ratios(docs: DataFrame, labels: DataFrame, most: int = BITMAPS) -> DataFrame:
    """One row, one column: the array of log-likelihood ratios by bucket. Both multinomials are counted in one reading."""
    grams = features(with_words(good_documents(texts(docs), labels, most), "good"))
    # explode() would bring a filter on the size of grams, and with it a second evaluation; null buckets find no partner
    seen = grams.select("good", F.explode_outer("grams").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("r"), F.count_if("good").alias("t"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(seen, "bucket", "left").select("bucket", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t"))
    packed = both.agg(F.sort_array(F.collect_list(F.struct("bucket", "r", "t"))).alias("c"), F.sum("r").alias("nr"), F.sum("t").alias("nt"))
    a = SMOOTHING
    level = F.log((F.col("nt") + a * BUCKETS) / (F.col("nr") + a * BUCKETS))
    return packed.select("c", level.alias("level")).select(F.transform("c", lambda x: F.log((x["t"] + a) / (x["r"] + a)) - F.col("level")).alias("ratios"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio) of every document.

    A null text has no words and fails the base rule; ratio is then 0. Without good labels all ratios are the smoothing's
    and the verdict rests on them; labels' repeated rows count once, labels without a document not at all.
    """
    table = ratios(docs, labels).scalar()
    df = features(with_words(texts(docs)))
    starts = F.when(F.col("n") >= WINDOW, F.sequence(F.lit(1), F.col("n") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    df = df.withColumn("again", F.size("windows") > F.size(F.array_distinct("windows")))
    # windows in order of hash and place; those equal to a neighbour are found twice or more
    df = df.withColumn("marked", F.when(F.col("again"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.transform("marked", lambda x, i: F.when((i > 0) & (F.get("marked", i - 1)["h"] == x["h"]) | (F.get("marked", i + 1)["h"] == x["h"]), x["i"]))
    df = df.withColumn("places", F.sort_array(F.array_compact(same)))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("lines", lines)
    ratio = F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(F.col("table"), b))
    out = df.withColumn("table", table).select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(F.col("n") > 0, ratio / F.size("grams")).otherwise(0.0).alias("ratio"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
