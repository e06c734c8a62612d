"""Verification checks on the sandbox frames (FIXTURES F8) and profile operators."""

import datetime as dt

from pyspark.sql import functions as F

from orderlab.operators import profile as P

SCHEMA = "id int, name string, value double, date date"
ROWS = [(1, "Alice", 10.5, dt.date(2024, 1, 1)), (2, "Bob", 20.0, dt.date(2024, 2, 1)),
        (3, "Charlie", 30.5, dt.date(2024, 3, 1))]


def test_no_findings_on_subset(spark):
    inp = spark.createDataFrame(ROWS, SCHEMA)
    out, findings = P.verified_transform(inp, lambda d: d.filter("id <= 2"))
    assert findings.count() == 0 and out.count() == 2


def test_type_finding(spark):
    inp = spark.createDataFrame(ROWS, SCHEMA)
    out = inp.withColumn("value", F.lit("not_a_number"))
    tc = {r.column: r for r in P.type_consistency(inp, out).collect()}
    assert tc["value"].type_lost and tc["value"].unparsable_share == 1.0 and not tc["id"].type_lost


def test_fabrication_and_derived(spark):
    inp = spark.createDataFrame(ROWS, SCHEMA)
    fake = spark.createDataFrame([(99, "FakePerson", 999.0, dt.date(2024, 12, 31))], SCHEMA)
    fab = {r.column: r for r in P.no_fabrication(inp, inp.unionByName(fake)).collect()}
    assert set(fab) == {"id", "name", "value", "date"} and fab["name"].samples == "FakePerson"
    derived = inp.withColumn("value_doubled", F.col("value") * 2)
    assert P.no_fabrication(inp, derived).count() == 0


def test_profiles(spark):
    df = spark.createDataFrame(ROWS + [(4, None, None, None), (4, None, None, None)], SCHEMA)
    m = {r.column_name: r for r in P.manifest(df, "t").collect()}
    assert m["name"].nulls == 2 and m["id"].rows == 5 and m["date"].dtype == "date"
    prof = {r.column: r for r in P.column_profile(df).collect()}
    assert prof["id"].distinct == 4 and prof["value"].max_num == 30.5 and prof["name"].min_text == "Alice"
    dup = P.duplicate_profile(df).first()
    assert (dup.rows, dup.distinct_rows, dup.duplicate_rows) == (5, 4, 1)
    top = P.top_values(df, ["id"], 1).first()
    assert top.value == "4" and top["count"] == 2
    uv = P.unique_values(df, "name", 2).collect()
    assert [r.value for r in uv] == ["Alice", "Bob"] and uv[0].truncated
    red = {(r.key_a, r.key_b): r.a_determines_b for r in P.key_redundancy(df, ["id", "name"]).collect()}
    assert red[("id", "name")]


def test_approx_flags(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    prof = {r.column: r.distinct for r in P.column_profile(df, approx_distinct=True).collect()}
    assert prof["id"] == 3 and prof["name"] == 3
