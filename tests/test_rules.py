"""Rule tables case by case (FIXTURES F3 and the sample order fixture F1)."""

import pytest
from pyspark.sql import functions as F

from orderlab.functions import rules as R


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("variant,expected", [
    (None, "UNKNOWN"), ("2XL", "AXXL"), ("axs", "AS"), ("Entrada 22/AL", "AL"), ("Youth X-Small", "YXS"),
    ("Women Small", "AS"), ("X-Large/Black", "AXL"), ("L - Black", "AL"), ("Navy/YM", "YM"), ("White/WS", "WS"),
    ("Black/AM", "AM"), ("Royal/YS", "YS"), ("nothing here", "UNKNOWN"), ("Medium", "AM"), ("xl", "AXL"),
])
def test_size(spark, variant, expected):
    assert one(spark, R.size_col, variant) == expected


def test_size_corrected_table(spark):
    got = one(spark, lambda c: R.size_col(c, R.corrected_size_phrases()), "Women Small")
    assert got == "WS"


@pytest.mark.parametrize("name,expected", [
    ("Practice Game Jersey", None), ("Copa Zone", "socks"), ("Fall 2024 Game Jersey - Mens/Youth", "top"),
    ("Game Short - Womens", "bottom"), ("Game Sock", "socks"), ("Football Game Jersey", None),
    ("What Game Jersey", None), ("Random Thing", None),
])
def test_classify(spark, name, expected):
    assert one(spark, R.classify_product_col, name) == expected


@pytest.mark.parametrize("name,month,expected", [
    ("CFA Game Short", 8, "cfa"), ("Game Short", None, "unknown"), ("Fall Game Jersey", 3, "fall"),
    ("Winter Game Jersey", 8, "winter"), ("Game Jersey", 12, "winter"), ("Game Jersey", 4, "spring"),
])
def test_uniform_set(spark, name, month, expected):
    df = spark.createDataFrame([(name, month)], "n string, m int")
    assert df.select(R.uniform_set_col(F.col("n"), F.col("m"))).first()[0] == expected


@pytest.mark.parametrize("month,expected", [(None, "spring"), (7, "fall"), (10, "fall"), (11, "winter"),
                                            (2, "winter"), (3, "spring"), (6, "spring")])
def test_season(spark, month, expected):
    assert one(spark, R.season_col, month, "x int") == expected


@pytest.mark.parametrize("name,expected", [("Sky Blue Game Jersey", "Sky Blue"), ("Navy Game Jersey", "Navy"),
                                           ("Neon Green Jersey", "Neon Green"), ("Game Jersey", "Unknown")])
def test_color(spark, name, expected):
    assert one(spark, R.color_col, name) == expected


@pytest.mark.parametrize("variant,expected", [("#7", "7"), ("With Name & Number", "custom"), ("No Number", None),
                                              ("Add number for $5", "custom"), ("YM # 23", "23"), (None, None),
                                              ("YM", None)])
def test_number(spark, variant, expected):
    assert one(spark, R.number_col, variant) == expected


@pytest.mark.parametrize("name,expected", [("Game Jersey - Womens", "womens"), ("Girls Jersey", "womens"),
                                           ("Game Jersey - Mens/Youth", "mens_youth")])
def test_gender(spark, name, expected):
    assert one(spark, R.gender_age_col, name) == expected


def test_item_key_and_features(spark):
    df = spark.createDataFrame([("top", "mens_youth", "YM", "fall", 2000)], "c string, g string, s string, se string, y int")
    r = df.select(R.item_key_col(F.col("c"), F.col("g"), F.col("s")).alias("k"),
                  R.size_group_col(F.col("s")).alias("sg"), R.size_rank_col(F.col("s")).alias("sr"),
                  R.season_num_col(F.col("se")).alias("sn"), R.lifecycle_year_col(F.col("y"), [2000]).alias("ly")).first()
    assert (r.k, r.sg, r.sr, r.sn, r.ly) == ("top_mens_youth_ym", "youth", 3, 1, 1)
