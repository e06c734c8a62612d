"""Evaluation operators: quantile backtest (E4), baseline comparison (E1, E2),
cost sensitivity (E3, E5), exploration (E6, E7), stock-out rates (A18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlab.functions.newsvendor import nv_cost, order_up, over, under
from orderlab.operators.demand import ITEM_KEYS, complete_groups


def quantile_backtest(lines: DataFrame, train_years, test_year: int, co_frac: float = 0.70,
                      cu_frac: float = 0.40, moq: int = 6, item_keys=None, approx: bool = False) -> DataFrame:
    """Order the empirical critical-ratio quantile of train demand; score on the test year.

    Policy = quantile at CR = cu/(cu+co) of yearly train demand per item, baseline
    = mean yearly train demand; both ceil'ed then floored at MOQ (0 stays 0),
    missing items order 0.  Costs co = co_frac*price, cu = cu_frac*price use the
    test year's mean unit price.

    Plan: one scan; aggregate lines to (item, year) with map-side combining;
    a second aggregate per item computes quantile, mean and the test-year row
    with conditional aggregates.  Two shuffles of aggregated rows, no join.
    The exact percentile buffers one value per (item, train year); with
    ``approx=True`` a fixed-size sketch (``percentile_approx``) is used instead,
    for histories with very many periods per item.
    """
    keys = item_keys or ITEM_KEYS
    cr = cu_frac / (cu_frac + co_frac)
    years = list(train_years) + [test_year]
    by_year = complete_groups(lines.filter(F.col("year").isin(*years)), [*keys, "year"],
                              F.sum("quantity").alias("demand"), F.avg("unit_price").alias("unit_price"))
    is_train = F.col("year").isin(*train_years)
    is_test = F.col("year") == test_year
    per_item = by_year.groupBy(*keys).agg(
        (F.percentile_approx(F.when(is_train, F.col("demand")).cast("double"), F.lit(cr), F.lit(10000)) if approx
         else F.percentile(F.when(is_train, F.col("demand")), F.lit(cr))).alias("q_policy"),
        F.avg(F.when(is_train, F.col("demand"))).alias("q_base"),
        F.max(F.when(is_test, F.col("demand"))).alias("demand"),
        F.max(F.when(is_test, F.col("unit_price"))).alias("unit_price"),
    ).filter(F.col("demand").isNotNull())
    agent = F.coalesce(order_up(F.col("q_policy"), moq), F.lit(0).cast("bigint"))
    base = F.coalesce(order_up(F.col("q_base"), moq), F.lit(0).cast("bigint"))
    co, cu = F.col("unit_price") * co_frac, F.col("unit_price") * cu_frac
    return per_item.select(
        F.lit(test_year).alias("year"), *keys, "demand", "unit_price",
        agent.alias("agent_qty"), base.alias("baseline_qty"),
    ).select("*",
             nv_cost(F.col("agent_qty"), F.col("demand"), co, cu).alias("agent_cost"),
             nv_cost(F.col("baseline_qty"), F.col("demand"), co, cu).alias("baseline_cost"),
             over(F.col("agent_qty"), F.col("demand")).alias("agent_over_units"),
             under(F.col("agent_qty"), F.col("demand")).alias("agent_under_units"))


def cost_rollup(scored: DataFrame, by: str = "product_category", a: str = "agent_cost",
                b: str = "baseline_cost") -> DataFrame:
    """Per-group sums of policy and baseline cost, savings and % reduction,
    plus a grand-total row (group value 'TOTAL'), from one aggregate."""
    g = scored.groupBy(by).agg(F.sum(a).alias(a), F.sum(b).alias(b), F.count(F.lit(1)).alias("items"))
    t = scored.agg(F.lit("TOTAL").alias(by), F.sum(a).alias(a), F.sum(b).alias(b),
                   F.count(F.lit(1)).alias("items"))
    u = g.unionByName(t)
    return u.select(by, "items", a, b, (F.col(b) - F.col(a)).alias("savings"),
                    F.when(F.col(b) > 0, (F.col(b) - F.col(a)) / F.col(b) * 100).otherwise(0.0)
                    .alias("reduction_pct"))


def sensitivity(scored: DataFrame, qty: str, demand: str, price: str, co_mult: float, cu_mult: float,
                shifts=(-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3)) -> DataFrame:
    """Total cost when co or cu is shifted, plan held fixed.

    Cost is linear in the multipliers, so one pass computes the two sums
    V_o = sum(price*over) and V_u = sum(price*under); all 2*len(shifts) points
    follow on one row: cost = co*V_o + cu*V_u.
    """
    v = scored.agg(F.sum(F.col(price) * over(F.col(qty), F.col(demand))).alias("v_over"),
                   F.sum(F.col(price) * under(F.col(qty), F.col(demand))).alias("v_under"))
    spark = scored.sparkSession
    pts = spark.createDataFrame(
        [(p, round(s * 100), co_mult * (1 + s) if p == "overage" else co_mult,
          cu_mult * (1 + s) if p == "underage" else cu_mult)
         for p in ("overage", "underage") for s in shifts],
        "parameter string, shift_pct long, co_mult double, cu_mult double")
    j = F.broadcast(pts).crossJoin(v)
    base = F.lit(co_mult) * F.col("v_over") + F.lit(cu_mult) * F.col("v_under")
    cost = F.col("co_mult") * F.col("v_over") + F.col("cu_mult") * F.col("v_under")
    return j.select("parameter", "shift_pct",
                    F.round(F.when(F.col("parameter") == "overage", F.col("co_mult"))
                            .otherwise(F.col("cu_mult")), 4).alias("multiplier"),
                    cost.alias("total_cost"),
                    F.when(base > 0, (cost / base - 1) * 100).otherwise(0.0).alias("pct_change"))


def range_ratio(sens: DataFrame) -> DataFrame:
    """E5: spread of the total cost over the shifts of each multiplier, and overage spread
    over underage spread (null if the latter is 0)."""
    def spread(p):
        c = F.when(F.col("parameter") == p, F.col("total_cost"))
        return F.max(c) - F.min(c)
    r = sens.agg(spread("overage").alias("co_range"), spread("underage").alias("cu_range"))
    return r.select("co_range", "cu_range", F.try_divide("co_range", "cu_range").alias("range_ratio"))


def stockout_rates(scored: DataFrame, qty: str = "agent_qty", demand: str = "demand",
                   by: str = "size") -> DataFrame:
    """Share of items short (demand > order) and over (order > demand) per size."""
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("items"),
        F.avg((F.col(demand) > F.col(qty)).cast("double")).alias("stockout_rate"),
        F.avg((F.col(qty) > F.col(demand)).cast("double")).alias("overstock_rate"))
