"""File sources and sinks: CSV of raw or clean lines (S1, S3), JSON (S4), file digests."""

from __future__ import annotations

import _hashlib
import ctypes
import re
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_SCHEMA = ("order_id bigint, order_date date, season string, year int, uniform_set string, "
                "product_category string, gender_age string, size string, color string, number string, "
                "quantity int, unit_price double")

# Raw storefront export columns read as text; coercion is the cleaner's job.
RAW_SCHEMA = ("`Order ID` string, `Created at` string, `Financial Status` string, `Lineitem name` string, "
              "`Lineitem variant` string, `Lineitem quantity` string, `Lineitem price` string")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with an explicit schema; quoted fields may span lines.

    A missing path raises (Spark's PATH_NOT_FOUND), as the reference does."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def read_raw_orders(spark: SparkSession, path: str) -> DataFrame:
    """S1 for the raw export (extra columns of the export are ignored by name)."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("inferSchema", False).csv(path))
    from orderlab.operators.clean import RAW
    return df.select(*[f"`{c}`" for c in RAW.values()])


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one file per task."""
    df.write.mode("overwrite").json(path)


WHOLE_BYTES = 128 << 20  # a longer file is hashed range by range
CHAINS = 4               # long files whose ranges are hashed at the same time


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of every Parquet file of a table (a file or a folder of part files)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    whole = files.where(F.col("length") <= WHOLE_BYTES).select("path", "length", F.sha2("content", 256).alias("sha"))
    long = files.where(F.col("length") > WHOLE_BYTES).select("path", "length").collect()  # names only
    if not long:
        return whole
    with ThreadPool(min(CHAINS, len(long))) as pool:
        shas = pool.map(lambda f: chained_sha256(spark, f.path, f.length), long)
    return whole.unionByName(spark.createDataFrame([(*f, sha) for f, sha in zip(long, shas, strict=True)],
                                                   "path string, length long, sha string"))


def chained_sha256(spark: SparkSession, path: str, length: int) -> str:
    """SHA-256 of one file whose ranges (input splits of ``spark.sql.files.maxPartitionBytes``) are
    hashed by one task each, one after the other: a task takes over the state of the chain from the
    one before it.  Ranges are read as lines that end with \\n alone, whose raw bytes Spark keeps."""
    state, hashed, end = b"", -1, -1  # no byte hashed yet, no range read
    lines = (spark.read.option("lineSep", "\n").text(re.sub(r"([\\{}\[\]*?])", r"\\\1", path))
             .select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("start")))

    def link(state, hashed):
        def run(batches):
            sha, done, start = Sha256(state), hashed, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                start = batch.column("start")[0].as_py()
                data = b"\n".join(batch.column("line").to_pylist())
                if done >= 0:  # lines before this one end here
                    sha.update(b"\n")
                sha.update(data)
                done += 1 + len(data)
            yield pa.RecordBatch.from_pydict({"state": [sha.state()], "hashed": [done], "start": [start]},
                                             pa.schema([("state", pa.binary()), ("hashed", pa.int64()), ("start", pa.int64())]))
        return run

    ranges = lines.rdd.getNumPartitions()
    for i in range(ranges):
        part = lines.mapInArrow(link(state, hashed), "state binary, hashed long, start long").rdd
        state, hashed, start = spark.sparkContext.runJob(part, list, [i])[0]
        state = bytes(state)
        if start is not None:  # None: a range without the beginning of a line
            if start <= end:
                raise RuntimeError(f"{path}: ranges are not in the order of the file")
            end = start
    sha = Sha256(state)
    if max(hashed, 0) == length - 1:
        sha.update(b"\n")
    elif max(hashed, 0) != length:
        raise RuntimeError(f"{path}: {hashed} of {length} bytes read")
    return sha.hexdigest()


class Sha256:
    """SHA-256 of OpenSSL, the library below hashlib, whose state (SHA256_CTX, 112 bytes) can go from task to task."""

    def __init__(self, state: bytes = b""):
        self.lib = ctypes.CDLL(_hashlib.__file__)  # names are looked up in the OpenSSL it is linked to
        self.context = ctypes.create_string_buffer(state, 112) if state else ctypes.create_string_buffer(112)
        if not state:
            self.lib.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.context, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, self.context)
        return out.raw.hex()
