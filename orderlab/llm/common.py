"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from orderlab.session import checkpoint_dir, cut_lineage

# Text handled by one numpy step inside a task; a longer text is a step of its own.
STEP_BYTES = 4 << 20

_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}
_BLANK = [0x20, *range(0x09, 0x0E)]


def byte_table(lower: bool, blank) -> bytes:
    """256-byte map: ``blank`` bytes become spaces, A-Z become a-z if ``lower``."""
    t = bytearray(range(256))
    for b in blank:
        t[b] = 0x20
    if lower:
        for b, low in _UPPER.items():
            t[b] = low
    return bytes(t)


# Words `[^\x20\x09-\x0D]+`, with and without lower-casing A-Z.
WORDS = byte_table(False, _BLANK)
WORDS_LOWER = byte_table(True, _BLANK)
# Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM_LOWER = byte_table(True, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Shuffle files of the queries run inside go when they end, not when the driver
    happens to collect garbage; what they wrote stands for itself."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared checkpoint folder: (the table read
    back, its path).  Lineage ends there, columns can be pruned, and a lost executor only
    costs a re-read."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, for a table that stays."""
    return written(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint without the shuffle files that led to it."""
    with shuffles_deleted(df.sparkSession):
        return cut_lineage(df)


def steps(batches, column: str = "text", max_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches so that each step holds about ``max_bytes`` of text
    (always at least one row), which bounds the memory of a task."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


class Words:
    """Words of a text column, tokenised by one byte map.

    doc      row index of each word
    code     index into ``vocab`` of each word
    vocab    distinct words (Arrow large_binary)
    bounds   word index range of row i is bounds[i]:bounds[i+1]
    raw      mapped bytes of all rows; ``offsets`` are the row limits in it
    starts, ends   byte range of each word in ``raw``
    """

    def __init__(self, column: pa.Array, table: bytes):
        col = pc.fill_null(column.cast(pa.large_binary()), b"")
        n = len(col)
        buf = col.buffers()
        off = np.frombuffer(buf[1], np.int64, n + 1, col.offset * 8)
        data = bytes(memoryview(buf[2])[off[0]:off[-1]]) if buf[2] is not None else b""
        self.offsets = off - off[0]
        self.raw = np.frombuffer(data.translate(table), np.uint8)
        inside = self.raw != 0x20
        size = len(inside)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        limits = self.offsets[:-1][self.offsets[:-1] < size]
        first[limits] = inside[limits]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        limits = self.offsets[1:][self.offsets[1:] > 0] - 1
        last[limits] = inside[limits]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(n), self.counts)
        ends = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=ends[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts),
                                      [None, pa.py_buffer(ends), pa.py_buffer(self.raw[inside])])
        enc = words.dictionary_encode()
        self.code = enc.indices.to_numpy()
        self.vocab = enc.dictionary
        self.inside = inside

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """Number of set bytes of ``mask`` in each row."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[self.offsets])


def covered(length: int, at: np.ndarray, width) -> np.ndarray:
    """Boolean mask of the positions inside the windows [at, at + width)."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c
                                       for c, f in zip(columns, schema, strict=True)], schema=schema)
