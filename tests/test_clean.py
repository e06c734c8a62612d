"""Cleaning pipeline on the sample storefront rows (FIXTURES F1) and S1 CSV read."""

from pyspark.sql import functions as F

from orderlab.operators.clean import clean_audit, clean_order_lines, normalize_strings
from orderlab.sources.files import RAW_SCHEMA

ROWS = [
    ("5001", "2024-08-15T10:00:00-07:00", "PAID", "Fall 2024 Game Jersey - Mens/Youth", "Navy/YM", "1", "55.00"),
    ("5001", "2024-08-15T10:00:00-07:00", "PAID", "Fall 2024 Game Short - Mens/Youth", "Navy/YM", "1", "25.00"),
    ("5001", "2024-08-15T10:00:00-07:00", "PAID", "Fall 2024 Game Sock", "Navy/YM", "1", "12.00"),
    ("5002", "2024-08-16T10:00:00-07:00", "PAID", "Fall 2024 Game Jersey - Womens", "White/WS", "1", "55.00"),
    ("5002", "2024-08-16T10:00:00-07:00", "PAID", "Fall 2024 Game Short - Womens", "White/WS", "1", "25.00"),
    ("5003", "2024-08-17T10:00:00-07:00", "PAID", "Fall 2024 Game Jersey - Mens/Youth", "Navy/AL", "abc", "55.00"),
    ("5004", "2024-08-18T10:00:00-07:00", "PAID", "Fall 2024 Game Jersey - Mens/Youth", "Navy/YL", "2", "abc"),
    ("5005", "2024-12-01T10:00:00-07:00", "PAID", "Winter 2024 Game Jersey - Mens/Youth", "Black/AM", "1", "55.00"),
    ("5006", "2025-03-01T10:00:00-07:00", "PAID", "Spring 2025 Game Jersey - Mens/Youth", "Royal/YS", "1", "55.00"),
    ("5007", "2024-08-20T10:00:00-07:00", "REFUNDED", "Practice Jersey", "Navy/YM", "1", "30.00"),
]


def raw(spark):
    return spark.createDataFrame(ROWS, RAW_SCHEMA)


def test_clean_rows(spark):
    out = clean_order_lines(raw(spark)).orderBy("order_id", "product_category").collect()
    assert len(out) == 9
    by = {(r.order_id, r.product_category): r for r in out}
    assert by[(5001, "top")].size == "YM" and by[(5001, "top")].uniform_set == "fall"
    assert by[(5001, "socks")].color is None and by[(5001, "top")].color == "Unknown"
    assert by[(5002, "top")].gender_age == "womens" and by[(5002, "top")].size == "WS"
    assert by[(5003, "top")].quantity == 1                 # bad quantity -> 1
    assert by[(5004, "top")].unit_price is None            # bad price -> NULL
    assert by[(5005, "top")].season == "winter"
    assert by[(5006, "top")].season == "spring" and by[(5006, "top")].year == 2025
    # 10:00 at -07:00 is 17:00 UTC on the same day
    assert str(by[(5001, "top")].order_date) == "2024-08-15"


def test_month_boundary_is_utc(spark):
    df = spark.createDataFrame([("1", "2024-08-31T20:00:00-07:00", "PAID", "Game Jersey", "YM", "1", "1")], RAW_SCHEMA)
    r = clean_order_lines(df).first()
    assert r.season == "fall" and str(r.order_date) == "2024-09-01"


def test_audit(spark):
    a = {r.step: r for r in clean_audit(raw(spark)).collect()}
    assert a["raw"].rows_after == 10 and a["paid"].rows_after == 9 and a["classified"].rows_after == 9
    assert not any(r.flagged for r in a.values())


def test_csv_roundtrip(spark, tmp_path):
    from orderlab.operators.clean import write_clean_lines
    from orderlab.sources.files import CLEAN_SCHEMA, read_csv, read_raw_orders
    p = str(tmp_path / "raw.csv")
    raw(spark).coalesce(1).write.option("header", True).option("escape", '"').csv(p)
    back = read_raw_orders(spark, p)
    assert back.count() == 10
    out = str(tmp_path / "clean")
    write_clean_lines(clean_order_lines(back), out, fmt="csv")
    assert read_csv(spark, out, CLEAN_SCHEMA).filter(F.col("quantity") > 0).count() == 9


def test_text_numbers(spark):
    from orderlab.operators.clean import coerce_price, coerce_quantity
    df = spark.createDataFrame([(t,) for t in ("3", " 2.9\t", "nan", "inf", "1e20", "5d", "1e2", "x", None)], "v string")
    got = [(r.q, r.p) for r in df.select(coerce_quantity(df, "v").alias("q"), coerce_price(df, "v").alias("p")).collect()]
    assert got == [(3, 3.0), (2, 2.9), (1, None), (1, None), (1, 1e20), (1, None), (100, 100.0), (1, None), (1, None)]


def test_normalize_strings_trims_all_white_space(spark):
    df = spark.createDataFrame([("2XL\t", 1), ("\n a B\u00a0", 2), ("x y", 3), (None, 4)], "t string, n int")
    assert [r.t for r in normalize_strings(df).orderBy("n").collect()] == ["2xl", "a b", "x y", None]
