"""A store of profiles by their content's name: what is stored once is not stored again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from logweave.sources.exports import profile_key

KIND = "key string, blob binary, shard string"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(key, blob, shard) of a store; an empty one if nothing was stored there yet."""
    try:
        return spark.read.schema(KIND).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], KIND)


def store(rows: DataFrame, path: str) -> DataFrame:
    """Adds the blobs of rows (owner, record, blob) to the store at a path, and returns what records refer to: (owner, record,
    storage_key, byte_size, checksum).

    Keys are an owner's name for the content, so a blob that comes twice is one object and a repeated run adds nothing. A
    null blob is not stored and has no key. Objects lie in folders by the first two digits of their sum, so a look-up reads
    one of 256.
    """
    named = rows.withColumns({"storage_key": profile_key(F.col("owner"), F.col("blob")), "checksum": F.sha2("blob", 256)})
    new = named.where("storage_key is not null").groupBy(F.col("storage_key").alias("key")).agg(F.min("blob").alias("blob"), F.min(F.substring("checksum", 1, 2)).alias("shard"))
    new = new.join(stored(rows.sparkSession, path).select("key"), "key", "left_anti")
    if new.limit(1).count():
        new.repartition("shard").write.partitionBy("shard").mode("append").parquet(path)
    return named.select("owner", "record", "storage_key", F.length("blob").cast("long").alias("byte_size"), "checksum")


def fetched(spark: SparkSession, path: str, references: DataFrame) -> DataFrame:
    """references (storage_key, ...) with the stored blob; null where the store has none."""
    held = stored(spark, path).withColumnsRenamed({"key": "storage_key", "shard": "_shard"})
    asked = references.withColumn("_shard", F.substring(F.substring_index("storage_key", "/", -1), 1, 2))
    return asked.join(held, ["_shard", "storage_key"], "left").select(*references.columns, "blob")
