"""duplicates are counted by a row hash first, and in full only where it repeats."""
import datetime as dt

from pyspark.sql import functions as F

from orderlab.operators import profile as P


def test_counts_match_full_grouping(spark):
    day = dt.date(2020, 1, 2)
    rows = [(1, "a", 0.0, day), (1, "a", -0.0, day), (1, "a", float("nan"), None), (1, "a", float("nan"), None),
            (None, None, None, None), (None, None, None, None), (None, None, None, None), (2, "b", 1.0, day),
            (1, None, 1.0, day), (None, "1", 1.0, day)]
    df = spark.createDataFrame(rows, "`order id` long, name string, x double, d date")
    assert tuple(P.duplicate_profile(df).first()) == (10, 6, 4, 0.4)
    assert tuple(P.duplicate_profile(df.limit(0)).first()) == (None, 0, None, 0.0)
    twice = df.union(df).withColumn("m", F.create_map(F.lit("k"), F.lit(1))).withColumn("v", F.lit(None))
    assert tuple(P.duplicate_profile(twice).first()) == (20, 6, 14, 0.7)


def test_rows_with_equal_hash_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(P.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None)], "k long, s string")
    assert tuple(P.duplicate_profile(df).first()) == (4, 3, 1, 0.25)


def test_unique_rows_are_grouped_by_the_hash_alone(spark):
    df = spark.range(50).selectExpr("id", "concat('t', id) AS text")
    plan = P.duplicate_profile(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_h#" in plan and "LeftSemi" in plan
