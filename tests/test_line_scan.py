"""Group-level queries parse the order lines once: rules are not repeated for a filter,
and work on the groups does not go back to the lines."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderlab.operators import demand as D
from orderlab.operators import evaluate as E


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    part = [(1, "red widget", "Brand#1", 3, 10.0), (2, "old ring", "Brand#2", 8, 4.0), (3, "big anvil", "Brand#3", 1, 9.0),
            (None, "lost gear", "Brand#4", 2, 1.0)]
    orders = [(o, 1 + o % 3, "F" if o % 4 else "O", dt.datetime(1995 + o % 7, 1 + o % 12, 5)) for o in range(1, 57)]
    lineitem = [(o, 1 + (o + k) % 3, float(1 + k + o % 5)) for o in range(0, 57) for k in range(3)]
    customer = [(1, "HOUSEHOLD"), (2, "BUILDING"), (None, "HOUSEHOLD")]
    for name, rows, ddl in [
            ("part", part, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"),
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
            ("lineitem", lineitem, "l_orderkey long, l_partkey long, l_quantity double"),
            ("customer", customer, "c_custkey long, c_mktsegment string")]:
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ridge_reads_kept_groups(spark, tables):  # F3
    from orderlab.plans.queries_costs import features_df, q_ridge_one_feature
    f = features_df(spark, tables)
    assert "parquet" not in plan(f)
    assert f.count() == D.demand_groups(_lines(spark, tables)).count() > 20
    got = q_ridge_one_feature(spark, tables).first()
    assert got.n == f.where(F.col("year") < 2000).count() and got.feature == "size_rank"


def _lines(spark, tables):
    from orderlab.plans.common import lines
    return lines(spark, tables)


def test_null_keys_go_without_a_second_parse(spark):  # F5 F6 F7
    raw = spark.createDataFrame([("a-1", 2000, 2, 1.0), ("a-1", 2000, 3, 2.0), (None, 2000, 9, 1.0), ("b-2", None, 9, 1.0),
                                 ("b-2", 2001, 4, None)], "text string, year int, quantity int, unit_price double")
    ln = raw.select("year", F.regexp_replace(F.concat("text", F.lit("x")), "[0-9]", "").alias("size"), "quantity", "unit_price")
    keys = ["year", "size"]
    for g in (D.demand_groups(ln, keys), D.demand_price_groups(ln, keys).drop("unit_price")):
        assert plan(g).count("regexp_replace") == 1
        assert sorted(map(tuple, g.collect())) == [(2000, "a-x", 5), (2001, "b-x", 4)]


def test_not_a_number_key_goes_too(spark):
    ln = spark.createDataFrame([(1.0, 2), (float("nan"), 3), (None, 4)], "k double, quantity int")
    assert [tuple(r) for r in D.demand_groups(ln, ["k"]).collect()] == [(1.0, 2)]


def test_backtest_parses_keys_once(spark):
    ln = spark.createDataFrame([("a", y, 3 + y % 2, 2.0) for y in (1999, 2000)] + [(None, 2000, 5, 1.0)],
                               "text string, year int, quantity int, unit_price double")
    ln = ln.select("year", F.regexp_replace(F.concat("text", F.lit("x")), "q", "").alias("size"), "quantity", "unit_price")
    out = E.quantile_backtest(ln, [1999], 2000, 0.7, 0.4, 1, item_keys=["size"])
    assert plan(out).count("regexp_replace") == 1
    assert [(r["size"], r.demand) for r in out.collect()] == [("ax", 3)]


def test_customer_meets_orders_before_lines(spark, tables):
    from orderlab.sources.tables import raw_order_lines
    raw = raw_order_lines(spark, tables)
    li, o = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("lineitem", "orders"))
    known = o.where("o_custkey in (1, 2)")
    assert raw.count() == li.join(known, li.l_orderkey == known.o_orderkey).where("l_partkey in (1, 2, 3)").count()
