"""a long file is hashed range by range, by tasks that hand the state of the chain on."""
import hashlib
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orderlab.plans import load_all
from orderlab.sources import files


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "10000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("data", [
    random.Random(1).randbytes(60_001), random.Random(2).randbytes(40_000) + b"\n", b"\n" * 20_000,
    b"PAR1" + b"x" * 30_000 + b"PAR1", b"\r\n\r" * 9_000, b"\n" + b"a" * 12_000 + b"\n\n", b"a", b"\n",
    (b"z" * 63 + b"\n") * 500, b"\xff\xfe\x00\n" * 5_000 + b"\xc3"])
def test_chain_equals_the_digest_of_the_whole(spark, small_ranges, tmp_path, data):
    path = tmp_path / "a [1]{x}.parquet"
    path.write_bytes(data)
    assert files.chained_sha256(spark, f"file:{path}", len(data)) == hashlib.sha256(data).hexdigest()


def test_no_task_reads_a_long_file_whole(spark, small_ranges, tmp_path, monkeypatch):
    data = random.Random(3).randbytes(60_000)
    (tmp_path / "t.parquet").write_bytes(data)
    seen = []
    monkeypatch.setattr(files, "WHOLE_BYTES", 10_000)
    monkeypatch.setattr(spark.sparkContext, "runJob",
                        lambda rdd, f, parts, run=spark.sparkContext.runJob: seen.append(parts) or run(rdd, f, parts))
    (row,) = files.file_digests(spark, str(tmp_path / "t.parquet")).collect()
    assert (row.length, row.sha) == (60_000, hashlib.sha256(data).hexdigest())
    assert [p for (p,) in seen] == list(range(len(seen))) and len(seen) >= 6


def test_fingerprint_of_files_above_the_limit_of_whole_reads(spark, tmp_path, monkeypatch):
    from orderlab.plans.queries_forecast import TABLES
    for t in TABLES:
        one = pa.table({"id": list(range(3000)), "name": [f"{t}-{i}" for i in range(3000)]})
        if t == TABLES[-1]:
            (tmp_path / f"{t}.parquet").mkdir()
            for i in range(2):
                pq.write_table(one.slice(i * 1500, 1500), tmp_path / f"{t}.parquet" / f"part-{i}.parquet")
        else:
            pq.write_table(one.slice(0, 10 if t == TABLES[0] else 3000), tmp_path / f"{t}.parquet")
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "8000")  # stands for the 2 GB of a whole read
    monkeypatch.setattr(files, "WHOLE_BYTES", 8000)
    try:
        got = {r.table_name: r for r in load_all()["file_fingerprint"].build(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)

    def sha(path):
        return hashlib.sha256(path.read_bytes()).hexdigest()

    assert len(got) == len(TABLES)
    for t, r in got.items():
        path = tmp_path / f"{t}.parquet"
        if path.is_dir():
            want = hashlib.sha256(",".join(sha(path / p) for p in sorted(os.listdir(path))).encode()).hexdigest()
        else:
            want = sha(path)
            assert r.bytes == path.stat().st_size
        assert r.sha256 == want and r.rows == (10 if t == TABLES[0] else 3000)
