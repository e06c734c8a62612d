"""Demand aggregation (A1) as a Structured Streaming query.

New raw order-line files landing in a folder are cleaned with the same rule
expressions as the batch path and folded into running demand per group.
State is the group table only (bounded by items x years); the checkpoint
location must be a shared folder (``spark.checkpoint.dir`` by default).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlab.functions import rules as R
from orderlab.operators.clean import clean_order_lines
from orderlab.operators.demand import GROUP_KEYS
from orderlab.sources.files import RAW_SCHEMA


def demand_stream(spark: SparkSession, folder: str, file_format: str = "csv",
                  category_rules: R.CategoryRules = R.REFERENCE_CATEGORY_RULES) -> DataFrame:
    """Streaming DataFrame of demand per (year, season, category, gender, size)."""
    reader = spark.readStream.schema(RAW_SCHEMA)
    raw = (reader.option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
           if file_format == "csv" else reader.format(file_format).load(folder))
    lines = clean_order_lines(raw, category_rules)
    return (lines.dropna(subset=GROUP_KEYS).groupBy(*GROUP_KEYS)
            .agg(F.sum("quantity").alias("demand"), F.count(F.lit(1)).alias("lines")))


def start(spark: SparkSession, folder: str, sink_table: str, checkpoint: str | None = None, **kw):
    """Run the aggregation into an in-memory table (complete mode); returns the query."""
    from orderlab.session import checkpoint_dir
    ck = checkpoint or f"{checkpoint_dir(spark)}/stream-{sink_table}"
    return (demand_stream(spark, folder, **kw).writeStream.outputMode("complete").format("memory")
            .queryName(sink_table).option("checkpointLocation", ck).start())
