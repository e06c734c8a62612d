"""Registered queries: cleaning, rules, demand groups and the backtest family."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlab.functions import rules as R
from orderlab.functions.newsvendor import nv_cost_sql, order_up_sql
from orderlab.operators import clean as C
from orderlab.operators import demand as D
from orderlab.operators import evaluate as E
from orderlab.plans.common import (CO_FRAC, CO_MULT, CR, CU_FRAC, CU_MULT, MOQ, TRAIN, Y1, Y2, lines,
                                   with_lines, yrs)
from orderlab.plans.registry import register
from orderlab.session import cut_lineage
from orderlab.sources.tables import CATALOG_RULES, raw_order_lines

ITEM = "season, product_category, gender_age, size"


# ---------------------------------------------------------------- flagship E4

def _backtest(spark, sf_dir):
    return E.quantile_backtest(lines(spark, sf_dir), TRAIN, Y1, CO_FRAC, CU_FRAC, MOQ)


def backtest_sql_cte() -> str:
    return f"""bt_year AS (SELECT {ITEM}, year, sum(quantity) AS demand, avg(unit_price) AS unit_price
                  FROM lines WHERE year IN {yrs(TRAIN + [Y1])} GROUP BY ALL),
    bt_pol AS (SELECT {ITEM}, quantile_cont(demand, {CR!r}) AS q_policy, avg(demand) AS q_base
               FROM bt_year WHERE year IN {yrs(TRAIN)} GROUP BY ALL),
    bt AS (SELECT t.year, t.season, t.product_category, t.gender_age, t.size, t.demand, t.unit_price,
                  coalesce({order_up_sql('p.q_policy', MOQ)}, 0) AS agent_qty,
                  coalesce({order_up_sql('p.q_base', MOQ)}, 0) AS baseline_qty
           FROM bt_year t LEFT JOIN bt_pol p USING ({ITEM}) WHERE t.year = {Y1}),
    bt_scored AS (SELECT *, {nv_cost_sql('agent_qty', 'demand', f'{CO_FRAC}*unit_price', f'{CU_FRAC}*unit_price')} AS agent_cost,
                         {nv_cost_sql('baseline_qty', 'demand', f'{CO_FRAC}*unit_price', f'{CU_FRAC}*unit_price')} AS baseline_cost,
                         greatest(agent_qty - demand, 0) AS agent_over_units,
                         greatest(demand - agent_qty, 0) AS agent_under_units
                  FROM bt)"""


@register("quantile_backtest",
          "year:long, season:string, product_category:string, gender_age:string, size:string, demand:long, "
          "unit_price:double, agent_qty:long, baseline_qty:long, agent_cost:double, baseline_cost:double, "
          "agent_over_units:double, agent_under_units:double",
          lambda: with_lines(backtest_sql_cte()) + " SELECT * FROM bt_scored",
          ops="E4 A5 A9 A2 J5 N1")
def q_quantile_backtest(spark, sf_dir):
    return _backtest(spark, sf_dir)


def rollup_sql(src: str, by: str, a: str, b: str) -> str:
    return f"""SELECT {by}, items, {a}, {b}, {b} - {a} AS savings,
                      CASE WHEN {b} > 0 THEN ({b} - {a}) / {b} * 100 ELSE 0.0 END AS reduction_pct
               FROM (SELECT {by}, count(*) AS items, sum({a}) AS {a}, sum({b}) AS {b} FROM {src} GROUP BY {by}
                     UNION ALL SELECT 'TOTAL', count(*), sum({a}), sum({b}) FROM {src}) r"""


@register("backtest_by_category",
          "product_category:string, items:long, agent_cost:double, baseline_cost:double, savings:double, "
          "reduction_pct:double",
          lambda: with_lines(backtest_sql_cte()) + " " + rollup_sql("bt_scored", "product_category",
                                                                     "agent_cost", "baseline_cost"),
          ops="E4 A6 E2")
def q_backtest_by_category(spark, sf_dir):
    return E.cost_rollup(_backtest(spark, sf_dir))


def sensitivity_sql(src: str, qty: str, demand: str, price: str, co: float, cu: float) -> str:
    shifts = [-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3]
    rows = ", ".join(f"('{p}', {round(s * 100)}, {co * (1 + s) if p == 'overage' else co!r}, "
                     f"{cu * (1 + s) if p == 'underage' else cu!r})"
                     for p in ("overage", "underage") for s in shifts)
    return f"""SELECT parameter, shift_pct, round(CASE WHEN parameter = 'overage' THEN co_mult ELSE cu_mult END, 4)
                      AS multiplier, co_mult * v_over + cu_mult * v_under AS total_cost,
                      CASE WHEN {co!r} * v_over + {cu!r} * v_under > 0
                           THEN ((co_mult * v_over + cu_mult * v_under) / ({co!r} * v_over + {cu!r} * v_under) - 1) * 100
                           ELSE 0.0 END AS pct_change
               FROM (VALUES {rows}) AS pts(parameter, shift_pct, co_mult, cu_mult),
                    (SELECT sum({price} * greatest({qty} - {demand}, 0)) AS v_over,
                            sum({price} * greatest({demand} - {qty}, 0)) AS v_under FROM {src}) v"""


SENS_COLS = "parameter:string, shift_pct:long, multiplier:double, total_cost:double, pct_change:double"


@register("backtest_sensitivity", SENS_COLS,
          lambda: with_lines(backtest_sql_cte()) + " " + sensitivity_sql("bt_scored", "agent_qty", "demand",
                                                                          "unit_price", CO_FRAC, CU_FRAC),
          ops="E5 E3")
def q_backtest_sensitivity(spark, sf_dir):
    return E.sensitivity(_backtest(spark, sf_dir), "agent_qty", "demand", "unit_price", CO_FRAC, CU_FRAC)


@register("stockout_rates", "size:string, items:long, stockout_rate:double, overstock_rate:double",
          lambda: with_lines(backtest_sql_cte()) + """ SELECT size, count(*) AS items,
              avg(CASE WHEN demand > agent_qty THEN 1.0 ELSE 0.0 END) AS stockout_rate,
              avg(CASE WHEN agent_qty > demand THEN 1.0 ELSE 0.0 END) AS overstock_rate
              FROM bt_scored GROUP BY size""",
          ops="A18")
def q_stockout_rates(spark, sf_dir):
    return E.stockout_rates(_backtest(spark, sf_dir))


# ---------------------------------------------------------------- cleaning

CLEAN_SPEC = ("order_id:long, order_date:date, season:string, year:long, uniform_set:string, "
              "product_category:string, gender_age:string, size:string, color:string, number:string, "
              "quantity:long, unit_price:double")


@register("order_lines_clean", CLEAN_SPEC, lambda: with_lines() + " SELECT * FROM lines",
          ops="P1 P2 P3 P6 P7 P10 P11 P12 P13 P16 T1 T2 T3 T4 T5 T6")
def q_order_lines_clean(spark, sf_dir):
    return lines(spark, sf_dir)


@register("clean_audit", "step_no:long, step:string, rows_after:long, dropped:long, drop_share:double, flagged:bool",
          lambda: with_lines() + """, cnt AS (
              SELECT count(*) AS n0, count_if("Financial Status" = 'PAID') AS n1,
                     count_if("Financial Status" = 'PAID' AND "Lineitem name" IS NOT NULL) AS n2,
                     count_if("Financial Status" = 'PAID' AND "Lineitem name" IS NOT NULL AND _category IS NOT NULL) AS n3,
                     count_if("Financial Status" = 'PAID' AND "Lineitem name" IS NOT NULL AND _category IS NOT NULL
                              AND _ts IS NOT NULL) AS n4 FROM _parsed),
              st AS (SELECT 0 AS step_no, 'raw' AS step, n0 AS a, n0 AS b FROM cnt UNION ALL
                     SELECT 1, 'paid', n1, n0 FROM cnt UNION ALL SELECT 2, 'named', n2, n1 FROM cnt UNION ALL
                     SELECT 3, 'classified', n3, n2 FROM cnt UNION ALL SELECT 4, 'dated', n4, n3 FROM cnt)
              SELECT step_no, step, a AS rows_after, b - a AS dropped, round((b - a) / b, 4) AS drop_share,
                     (b - a) / b > 0.5 AS flagged FROM st""",
          ops="D7")
def q_clean_audit(spark, sf_dir):
    return C.clean_audit(raw_order_lines(spark, sf_dir), CATALOG_RULES)


def _rule_sql(select: str, group: str) -> str:
    return with_lines() + f" SELECT {select}, count(*) AS lines FROM _parsed GROUP BY {group}"


@register("classify_product", "product_name:string, product_category:string, lines:long",
          lambda: _rule_sql('"Lineitem name" AS product_name, _category AS product_category', "ALL"),
          ops="T1")
def q_classify_product(spark, sf_dir):
    raw = raw_order_lines(spark, sf_dir)
    return (raw.groupBy(F.col(C.RAW["name"]).alias("product_name"))
            .agg(F.count(F.lit(1)).alias("lines"))
            .select("product_name", R.classify_product_col(F.col("product_name"), CATALOG_RULES)
                    .alias("product_category"), "lines"))


@register("uniform_set", "product_name:string, month:long, uniform_set:string, lines:long",
          lambda: _rule_sql(f'"Lineitem name" AS product_name, _month AS month, '
                            f'{R.uniform_set_sql(chr(34) + "Lineitem name" + chr(34), "_month")} AS uniform_set', "ALL"),
          ops="T2")
def q_uniform_set(spark, sf_dir):
    raw = raw_order_lines(spark, sf_dir)
    g = raw.groupBy(F.col(C.RAW["name"]).alias("product_name"),
                    F.month(C.parsed_timestamp(raw, C.RAW["created_at"])).alias("month")
                    ).agg(F.count(F.lit(1)).alias("lines"))
    return g.select("product_name", "month", R.uniform_set_col(F.col("product_name"), F.col("month"))
                    .alias("uniform_set"), "lines")


@register("gender_age", "product_name:string, gender_age:string, lines:long",
          lambda: _rule_sql(f'"Lineitem name" AS product_name, {R.gender_age_sql(chr(34) + "Lineitem name" + chr(34))} '
                            f'AS gender_age', "ALL"),
          ops="T3")
def q_gender_age(spark, sf_dir):
    raw = raw_order_lines(spark, sf_dir)
    return (raw.groupBy(F.col(C.RAW["name"]).alias("product_name")).agg(F.count(F.lit(1)).alias("lines"))
            .select("product_name", R.gender_age_col(F.col("product_name")).alias("gender_age"), "lines"))


@register("size_normalize", "variant:string, size:string, lines:long",
          lambda: _rule_sql(f'"Lineitem variant" AS variant, {R.size_sql(chr(34) + "Lineitem variant" + chr(34))} AS size',
                            "ALL"),
          ops="T4")
def q_size_normalize(spark, sf_dir):
    raw = raw_order_lines(spark, sf_dir)
    return (raw.groupBy(F.col(C.RAW["variant"]).alias("variant")).agg(F.count(F.lit(1)).alias("lines"))
            .select("variant", R.size_col(F.col("variant")).alias("size"), "lines"))


@register("color_parse", "product_name:string, color:string, lines:long",
          lambda: _rule_sql(f'"Lineitem name" AS product_name, {R.color_sql(chr(34) + "Lineitem name" + chr(34))} AS color',
                            "ALL"),
          ops="T5")
def q_color_parse(spark, sf_dir):
    raw = raw_order_lines(spark, sf_dir)
    return (raw.groupBy(F.col(C.RAW["name"]).alias("product_name")).agg(F.count(F.lit(1)).alias("lines"))
            .select("product_name", R.color_col(F.col("product_name")).alias("color"), "lines"))


@register("number_parse", "variant:string, number:string, lines:long",
          lambda: _rule_sql(f'"Lineitem variant" AS variant, {R.number_sql(chr(34) + "Lineitem variant" + chr(34))} AS number',
                            "ALL"),
          ops="T6")
def q_number_parse(spark, sf_dir):
    raw = raw_order_lines(spark, sf_dir)
    return (raw.groupBy(F.col(C.RAW["variant"]).alias("variant")).agg(F.count(F.lit(1)).alias("lines"))
            .select("variant", R.number_col(F.col("variant")).alias("number"), "lines"))


@register("season_by_month", "month:long, season:string, lines:long",
          lambda: _rule_sql(f"_month AS month, {R.season_sql('_month')} AS season", "ALL"),
          ops="P11 P12")
def q_season_by_month(spark, sf_dir):
    raw = raw_order_lines(spark, sf_dir)
    m = F.month(C.parsed_timestamp(raw, C.RAW["created_at"]))
    return (raw.groupBy(m.alias("month")).agg(F.count(F.lit(1)).alias("lines"))
            .select("month", R.season_col(F.col("month")).alias("season"), "lines"))


@register("item_key", "item_key:string, demand:long, lines:long",
          lambda: with_lines() + """ SELECT lower(coalesce(product_category, 'None') || '_' || coalesce(gender_age, 'None')
                 || '_' || coalesce(size, 'None')) AS item_key, sum(quantity) AS demand, count(*) AS lines
                 FROM lines GROUP BY 1""",
          ops="T7")
def q_item_key(spark, sf_dir):
    ln = lines(spark, sf_dir)
    return (ln.groupBy(R.item_key_col(F.col("product_category"), F.col("gender_age"), F.col("size")).alias("item_key"))
            .agg(F.sum("quantity").alias("demand"), F.count(F.lit(1)).alias("lines")))


# ---------------------------------------------------------------- demand

GROUP_SPEC = "year:long, season:string, product_category:string, gender_age:string, size:string, demand:long"


@register("demand_groups", GROUP_SPEC,
          lambda: with_lines() + " SELECT year, season, product_category, gender_age, size, demand FROM groups",
          ops="A1 P8 P14 P15")
def q_demand_groups(spark, sf_dir):
    # Optional descriptive columns are dropped (absent names are ignored)
    return D.demand_groups(lines(spark, sf_dir).drop("color", "number", "not_a_column"))


@register("size_features",
          "year:long, season:string, product_category:string, gender_age:string, size:string, demand:long, "
          "size_group:string, size_rank:long, season_num:long, lifecycle_year:long, is_youth:long, is_women:long, "
          "is_top:long, is_bottom:long, is_socks:long",
          lambda: with_lines() + f""" SELECT year, season, product_category, gender_age, size, demand,
              {R.size_group_sql('size')} AS size_group, {R.size_rank_sql('size')} AS size_rank,
              {R.season_num_sql('season')} AS season_num,
              CASE WHEN year IN ({Y1}) THEN 1 ELSE 2 END AS lifecycle_year,
              CAST({R.size_group_sql('size')} = 'youth' AS INT) AS is_youth,
              CAST({R.size_group_sql('size')} = 'women' AS INT) AS is_women,
              CAST(product_category = 'top' AS INT) AS is_top, CAST(product_category = 'bottom' AS INT) AS is_bottom,
              CAST(product_category = 'socks' AS INT) AS is_socks FROM groups""",
          ops="T8 T9 T10 M3")
def q_size_features(spark, sf_dir):
    return D.size_features(D.demand_groups(lines(spark, sf_dir)), [Y1])


# ---------------------------------------------------------------- E5 ratio, P4 with its count

@register("sensitivity_range_ratio", "co_range:double, cu_range:double, range_ratio:double",
          lambda: with_lines(backtest_sql_cte(), "sens AS (" + sensitivity_sql(
              "bt_scored", "agent_qty", "demand", "unit_price", CO_FRAC, CU_FRAC) + ")") + """
              SELECT co_range, cu_range, co_range / nullif(cu_range, 0) AS range_ratio FROM
              (SELECT max(total_cost) FILTER (WHERE parameter = 'overage') - min(total_cost) FILTER (WHERE parameter = 'overage')
                      AS co_range,
                      max(total_cost) FILTER (WHERE parameter = 'underage') - min(total_cost) FILTER (WHERE parameter = 'underage')
                      AS cu_range FROM sens)""",
          ops="E5")
def q_sensitivity_range_ratio(spark, sf_dir):
    return E.range_ratio(q_backtest_sensitivity(spark, sf_dir))


@register("growth_targets", "season:string, product_category:string, gender_age:string, size:string, growth:long, "
          "rows:long, null_target:long, nonpositive:long",
          lambda: with_lines(f"""gt AS (SELECT season, product_category, gender_age, size,
                  sum(demand) FILTER (WHERE year = {Y2}) - sum(demand) FILTER (WHERE year = {Y1}) AS growth
                  FROM groups GROUP BY ALL)""") + """
              SELECT gt.*, r.* FROM gt, (SELECT count(*) AS rows, count_if(growth IS NULL) AS null_target,
                     count_if(growth <= 0) AS nonpositive FROM gt) r WHERE growth > 0""",
          ops="P4")
def q_growth_targets(spark, sf_dir):
    """Demand growth of every item between the test years as target: rows without a positive
    one go, and how many is counted in the pass that writes the rest."""
    g = D.demand_price_groups(lines(spark, sf_dir))

    def in_year(y):
        return F.sum(F.when(F.col("year") == y, F.col("demand")))
    x = g.groupBy("season", "product_category", "gender_age", "size").agg((in_year(Y2) - in_year(Y1)).alias("growth"))
    kept, seen = C.drop_and_report(x, "growth")
    kept = cut_lineage(kept)
    return kept.select("*", *[F.lit(v).cast("long").alias(k) for k, v in seen.get.items()])
