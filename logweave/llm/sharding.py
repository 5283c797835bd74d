"""Placement on shards by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a prime-sized table: slots offset, offset + skip, ... modulo
the size. Shards take turns claiming the next free slot of their order until the table is full, so shares differ by at
most one slot and a changed shard list moves few other slots. The table has SLOTS rows whatever the corpus holds; it is
broadcast, and placing a document is one hash and one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime, over a hundred times any shard count that is wanted.
SLOTS = 65_537
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's order; skip is never 0, so with a prime number of slots the order visits all."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the index of the shard that claims it. Names must be different and at least one."""
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("shard names must be different, and between one and the number of slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    order = [preference(n, slots) for n in names]
    at = [first for first, _ in order]
    table = [-1] * slots
    taken = 0
    while True:
        for i, (_, skip) in enumerate(order):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip) % slots
            table[at[i]] = i
            taken += 1
            if taken == slots:
                return table


def place(docs: DataFrame, names: list[str] = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """(key, slot, shard) of every row. Equal keys share a shard; a null key hashes like any value (to Spark's seed)."""
    claimed = docs.sparkSession.createDataFrame([(slot, names[i]) for slot, i in enumerate(fill(names, slots))], "slot int, shard string")
    keyed = docs.select(F.col(key).alias(key), F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int").alias("slot"))
    return keyed.join(F.broadcast(claimed), "slot").select(key, "slot", "shard")


def write(docs: DataFrame, path: str, names: list[str] = SHARDS, slots: int = SLOTS, files: int = 8) -> None:
    """Write documents in one folder for each shard; a shard's rows are spread over `files` tasks. Texts move once.

    The folders are named by column shard, or shard_ and so on where docs has that column itself. Nulls are kept as they are.
    """
    column = "shard"
    while column in docs.columns:
        column += "_"
    shard = F.get(F.array(*[F.lit(n) for n in names]), F.col("_claim.owner"))
    claimed = docs.sparkSession.createDataFrame([(slot, i) for slot, i in enumerate(fill(names, slots))], "slot int, owner int").select(F.struct("owner").alias("_claim"), F.col("slot").alias("_slot"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("_slot"), F.pmod(F.xxhash64("doc_id"), F.lit(files)).alias("file"))
    placed = own.join(F.broadcast(claimed), "_slot").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], shard.alias(column), F.col("file").alias("_file"))
    placed.repartition(len(names) * files, column, "_file").drop("_file").write.partitionBy(column).parquet(path)
