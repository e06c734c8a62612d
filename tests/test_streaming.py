"""Streaming demand aggregation agrees with the batch aggregation on the fixture rows."""

from orderlab.operators.clean import clean_order_lines
from orderlab.operators.demand import demand_groups
from orderlab.sources.files import RAW_SCHEMA
from orderlab.streaming.demand_stream import start
from tests.test_clean import ROWS


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame(ROWS, RAW_SCHEMA)
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(str(src))
    q = start(spark, str(src), "demand_live", checkpoint=str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
        live = {tuple(r[:5]): r.demand for r in spark.sql("SELECT * FROM demand_live").collect()}
    finally:
        q.stop()
    batch = {tuple(r[:5]): r.demand for r in demand_groups(clean_order_lines(df)).collect()}
    assert live == batch and len(batch) > 0
