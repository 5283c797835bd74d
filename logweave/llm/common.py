"""What the corpus operators share: shared-folder tables, folds, byte and word views of Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task holds in its working arrays at a time; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or with a local master a temporary one if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        found = tempfile.mkdtemp(prefix="logweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and no row is computed twice."""
    path = f"{shared_dir(df.sparkSession)}/logweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5 (a null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null text as empty; other columns are left behind, so their names cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without nulls, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(at, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(offsets[-1])
    whole = np.frombuffer(data, np.uint8, size) if data is not None and size else np.zeros(0, np.uint8)
    return whole[offsets[0] :], offsets - offsets[0]


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about `most` text bytes at the most, a longer text alone."""
    if not batch.num_rows:
        return
    _, at = byte_view(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def binary_column(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column of rows data[at[i]:at[i + 1]]."""
    if at[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
