"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes held as Python objects at once inside a task.
SLICE_BYTES = 1 << 20


# Rows of an Arrow batch between the JVM and a worker; both sides hold whole batches of texts.
BATCH_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """Batches of at most ``BATCH_ROWS`` rows, unless the session asks for shorter ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold_of(col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold -1."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % folds, F.lit(-1))


def in_sample(col: str, wanted: int, rows: int) -> Column:
    """Whether the row's hash is among the least ``wanted / rows`` of all hashes: a share that never rounds to none."""
    share = min(1 << 64, -(-(wanted << 64) // max(rows, 1)))
    return F.xxhash64(col) <= F.lit(max(share, 1) - (1 << 63) - 1)


def slices(batch: pa.RecordBatch, col: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes in column ``col``.

    A single longer value makes a part of its own.
    """
    n = batch.num_rows
    if n == 0:
        return
    arr = batch.column(col)
    size = np.asarray(pc.fill_null(pc.binary_length(arr), 0), dtype=np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, col: int) -> list[str]:
    """Python strings of a column; null is the empty string."""
    return [t if t is not None else "" for t in batch.column(col).to_pylist()]


def bytes_of(batch: pa.RecordBatch, col: int) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    arr = batch.column(col)
    arr = arr.cast(pa.large_binary() if pa.types.is_large_string(arr.type) else pa.binary())
    return [t if t is not None else b"" for t in arr.to_pylist()]


def pack(texts: list[bytes]) -> list[bytes]:
    """Each text as a zstd frame behind its size: texts are what joins move most of."""
    codec = pa.Codec("zstd", compression_level=1)
    return [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) if t else b"" for t in texts]


def unpack(packed: bytes | None) -> bytes:
    """The text of a packed value; nothing unpacks to nothing."""
    if not packed:
        return b""
    return pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def bounded_file(path: str, limit: int = 64 << 20) -> bytes:
    """A driver-side vocabulary file whose size is checked before it is shipped."""
    with open(path, "rb") as f:
        data = f.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"{path} has more than {limit} bytes")
    return data


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file (the default of the path parameters)."""
    import public_tokenizers
    return public_tokenizers.path(name)
