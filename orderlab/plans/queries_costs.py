"""Registered queries: costs, baselines, scenarios, forecast scoring, features
and demand exploration (J1, J2, J6, J7, M1-M4, M7, M10-M15, M17, A2-A4, A10-A15,
A17, E6, E7, O2, W2, W3)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from orderlab.functions import rules as R
from orderlab.operators import costs as K
from orderlab.operators import demand as D
from orderlab.operators import forecast as FC
from orderlab.plans.common import MOQ, TRAIN, Y1, Y2, lines, with_lines, yrs
from orderlab.plans.forecast_inputs import (CONFIG, KEYS, KEYS_SQL, baseline_preds, cost_ctes, cost_table, forecast_ctes,
                                            scenario_cte, scenarios, train_test)
from orderlab.plans.registry import register
from orderlab.session import checkpoint_dir, cut_lineage
from orderlab.sources.config import config_json, read_constraints, read_cost_structure


PKEYS = ", ".join("pr." + k for k in KEYS)


def W(*extra: str) -> str:
    return with_lines(forecast_ctes(), cost_ctes(), *extra)


COST_COLS = "product_category:string, period:long, unit_cost:double, overage_cost:double, underage_cost:double"


@register("cost_lookup", COST_COLS, lambda: W() + " SELECT * FROM j6", ops="J6 S2")
def q_cost_lookup(spark, sf_dir):
    _, te = train_test(spark, sf_dir)
    return K.resolve_costs(K.item_combos(te), cost_table(spark), "optimizer")


@register("cost_lookup_strict", "product_category:string, period:long, overage_cost:double, underage_cost:double",
          lambda: W() + " SELECT * FROM j7", ops="J7")
def q_cost_lookup_strict(spark, sf_dir):
    _, te = train_test(spark, sf_dir)
    return K.resolve_costs(K.item_combos(te), cost_table(spark), "strict", ("overage_cost", "underage_cost"))


def _cr(spark, sf_dir):
    _, te = train_test(spark, sf_dir)
    strict = K.resolve_costs(K.item_combos(te), cost_table(spark), "strict", ("overage_cost", "underage_cost"))
    return K.critical_ratio_table(strict, 0.8)


@register("critical_ratio",
          "product_category:string, period:long, co:double, cu:double, critical_ratio:double, safety_factor:double, "
          "z_cr:double",
          lambda: W() + " SELECT * FROM crt", ops="M10 M12")
def q_critical_ratio(spark, sf_dir):
    return _cr(spark, sf_dir)


ITEMY = "year:long, season:string, product_category:string, gender_age:string, size:string"


@register("pto_adjust", ITEMY + ", pred:double, safety_factor:double, pred_pto:double",
          lambda: W() + f""" SELECT pr.year, {PKEYS}, pred, coalesce(crt.safety_factor, 1.0) AS safety_factor,
                  greatest(pred * coalesce(crt.safety_factor, 1.0), 0.0) AS pred_pto
                  FROM pr LEFT JOIN crt ON pr.product_category IS NOT DISTINCT FROM crt.product_category
                  AND pr.lifecycle_year IS NOT DISTINCT FROM crt.period""",
          ops="M11")
def q_pto_adjust(spark, sf_dir):
    pred, _, _ = baseline_preds(spark, sf_dir)
    x = K.pto_adjust(pred, _cr(spark, sf_dir))
    return x.withColumn("safety_factor", F.coalesce("safety_factor", F.lit(1.0)))


@register("pto_quantile", ITEMY + ", pred:double, sigma:double, z_cr:double, pred_quantile:double",
          lambda: W() + f""" SELECT pr.year, {PKEYS}, pred, sigma, crt.z_cr,
                  greatest(pred + sigma * crt.z_cr, 0.0) AS pred_quantile
                  FROM pr LEFT JOIN crt ON pr.product_category IS NOT DISTINCT FROM crt.product_category
                  AND pr.lifecycle_year IS NOT DISTINCT FROM crt.period""",
          ops="M12")
def q_pto_quantile(spark, sf_dir):
    pred, _, _ = baseline_preds(spark, sf_dir)
    return K.pto_quantile(pred, _cr(spark, sf_dir))


@register("residual_sigma", "scope:string, sigma:double, n:long",
          lambda: W() + """ SELECT 'ALL' AS scope, sigma, (SELECT count(*) FROM trs) AS n FROM sg
              UNION ALL SELECT product_category, coalesce(stddev_samp(demand - pred), 10.0), count(*) FROM trs GROUP BY 1""",
          ops="A12 A13")
def q_residual_sigma(spark, sf_dir):
    tr, _ = train_test(spark, sf_dir)
    return FC.residual_sigma(FC.baseline_predict(tr, tr, KEYS))


@register("scenarios", ITEMY + ", scenario_id:long, demand:double",
          lambda: W(scenario_cte()) + " SELECT * FROM scen", ops="M13 A3 J1")
def q_scenarios(spark, sf_dir):
    return scenarios(spark, sf_dir)


@register("empirical_scenarios", "season:string, product_category:string, gender_age:string, size:string, "
          "scenario_id:long, demand:double",
          lambda: W() + f" SELECT {KEYS_SQL}, year AS scenario_id, demand FROM tr", ops="M14")
def q_empirical_scenarios(spark, sf_dir):
    from orderlab.operators.scenarios import empirical_scenarios
    tr, _ = train_test(spark, sf_dir)
    return empirical_scenarios(tr, KEYS, TRAIN)


def _scored(spark, sf_dir):
    pred, _, _ = baseline_preds(spark, sf_dir)
    return K.strict_scoring_costs(pred, cost_table(spark))


@register("nv_cost_total", "product_category:string, lifecycle_year:string, items:long, nv_cost:double",
          lambda: W() + """ SELECT coalesce(product_category, 'ALL') AS product_category,
                 coalesce(CAST(lifecycle_year AS VARCHAR), 'ALL') AS lifecycle_year, count(*) AS items,
                 sum(co * greatest(pred - demand, 0) + cu * greatest(demand - pred, 0)) AS nv_cost
                 FROM sc GROUP BY ROLLUP (product_category, lifecycle_year)""",
          ops="N1 N2 J7")
def q_nv_cost_total(spark, sf_dir):
    return K.nv_totals(_scored(spark, sf_dir), "pred", "demand")


def _candidates(spark, sf_dir):
    """Long (model, item, pred) table of the SQL-expressible candidates."""
    sc = _scored(spark, sf_dir)
    cr = _cr(spark, sf_dir)
    pto = K.pto_adjust(sc, cr)
    qnt = K.pto_quantile(sc, cr)
    base = sc.select("year", *KEYS, "demand", "co", "cu", F.lit("Baseline").alias("model"), "pred")
    p1 = pto.select("year", *KEYS, "demand", "co", "cu", F.lit("Baseline+PTO").alias("model"),
                    F.col("pred_pto").alias("pred"))
    p2 = qnt.select("year", *KEYS, "demand", "co", "cu", F.lit("Baseline+Quantile").alias("model"),
                    F.col("pred_quantile").alias("pred"))
    return base.unionByName(p1).unionByName(p2)


@register("model_selection", "model:string, items:long, nv_cost:double, pct_vs_baseline:double, winner:bool",
          lambda: W() + """, cand AS (
                 SELECT 'Baseline' AS model, pred, demand, co, cu FROM sc
                 UNION ALL SELECT 'Baseline+PTO', greatest(pred * coalesce(crt.safety_factor, 1.0), 0.0), demand, sc.co, sc.cu
                   FROM sc LEFT JOIN crt ON sc.product_category IS NOT DISTINCT FROM crt.product_category
                   AND sc.lifecycle_year IS NOT DISTINCT FROM crt.period
                 UNION ALL SELECT 'Baseline+Quantile', greatest(pred + sigma * crt.z_cr, 0.0), demand, sc.co, sc.cu
                   FROM sc LEFT JOIN crt ON sc.product_category IS NOT DISTINCT FROM crt.product_category
                   AND sc.lifecycle_year IS NOT DISTINCT FROM crt.period),
              tot AS (SELECT model, count(*) AS items,
                      sum(co * greatest(pred - demand, 0) + cu * greatest(demand - pred, 0)) AS nv_cost FROM cand GROUP BY 1),
              w AS (SELECT arg_min(model, (nv_cost, model)) AS winner FROM tot WHERE model <> 'Baseline')
              SELECT model, items, tot.nv_cost,
                     CASE WHEN b.nv_cost > 0 THEN (tot.nv_cost / b.nv_cost - 1) * 100 ELSE 0.0 END AS pct_vs_baseline,
                     model = w.winner AS winner
              FROM tot, (SELECT nv_cost FROM tot WHERE model = 'Baseline') b, w""",
          ops="M15 O5")
def q_model_selection(spark, sf_dir):
    return FC.score_models(_candidates(spark, sf_dir))


def _validated(spark, sf_dir):
    pred, _, _ = baseline_preds(spark, sf_dir)
    return FC.with_errors(pred.withColumn("predicted_order", F.greatest(F.col("pred"), F.lit(float(MOQ)))))


VAL_SQL = f""", val AS (SELECT *, greatest(pred, {float(MOQ)}) AS predicted_order,
                       greatest(pred, {float(MOQ)}) - demand AS error, abs(greatest(pred, {float(MOQ)}) - demand) AS abs_error,
                       (greatest(pred, {float(MOQ)}) - demand) / greatest(demand, 1) * 100 AS pct_error FROM pr)"""
ERR_AGGS = """count(*) AS items, avg(error) AS mean_error, avg(abs_error) AS mae, sqrt(avg(error * error)) AS rmse,
              avg(pct_error) AS mean_pct_error, quantile_cont(pct_error, 0.5) AS median_pct_error,
              sum(predicted_order) AS total_predicted, sum(demand) AS total_actual,
              count_if(error > 0) AS over_orders, count_if(error < 0) AS under_orders, count_if(error = 0) AS exact"""


@register("error_report",
          "product_category:string, items:long, mean_error:double, mae:double, rmse:double, mean_pct_error:double, "
          "median_pct_error:double, total_predicted:double, total_actual:double, over_orders:long, under_orders:long, "
          "exact:long",
          lambda: W() + VAL_SQL + f" SELECT product_category, {ERR_AGGS} FROM val GROUP BY 1 "
          f"UNION ALL SELECT 'ALL', {ERR_AGGS} FROM val",
          ops="M17 A10 A14 A15")
def q_error_report(spark, sf_dir):
    return FC.error_report(_validated(spark, sf_dir))


@register("worst_orders", "kind:string, " + ITEMY + ", demand:long, predicted_order:double, error:double",
          lambda: W() + VAL_SQL + f""" SELECT * FROM (SELECT 'over' AS kind, year, {KEYS_SQL}, demand, predicted_order, error
                 FROM val ORDER BY error DESC, year, {KEYS_SQL} LIMIT 10)
                 UNION ALL SELECT * FROM (SELECT 'under', year, {KEYS_SQL}, demand, predicted_order, error
                 FROM val ORDER BY error ASC, year, {KEYS_SQL} LIMIT 10)""",
          ops="O2")
def q_worst_orders(spark, sf_dir):
    return FC.worst_orders(_validated(spark, sf_dir), ["year", *KEYS], 10)


@register("baseline_mean", "product_category:string, gender_age:string, size:string, baseline_qty:double",
          lambda: W() + " SELECT product_category, gender_age, size, round(avg(demand), 2) AS baseline_qty FROM tr GROUP BY ALL",
          ops="A2")
def q_baseline_mean(spark, sf_dir):
    tr, _ = train_test(spark, sf_dir)
    return FC.baseline_by_item(tr)


@register("price_map", ITEMY + ", mean_price:double",
          lambda: W() + f""", pm AS (SELECT product_category, size, avg(unit_price) AS mp FROM lines GROUP BY ALL)
              SELECT te.year, {KEYS_SQL}, coalesce(pm.mp, 25.0) AS mean_price FROM te
              LEFT JOIN pm USING (product_category, size)""",
          ops="J2 A4")
def q_price_map(spark, sf_dir):
    _, te = train_test(spark, sf_dir)
    pm = lines(spark, sf_dir).groupBy("product_category", "size").agg(F.avg("unit_price").alias("_mp"))
    return te.join(pm, ["product_category", "size"], "left").withColumn(
        "mean_price", F.coalesce(F.col("_mp"), F.lit(25.0)))


ENC = ["season", "product_category", "gender_age", "size"]


@register("label_encode", ITEMY + ", demand:long, season_encoded:long, product_category_encoded:long, "
          "gender_age_encoded:long, size_encoded:long",
          lambda: W() + ", " + ", ".join(
              f"e_{c} AS (SELECT {c}, dense_rank() OVER (ORDER BY {c}) - 1 AS {c}_encoded FROM "
              f"(SELECT DISTINCT {c} FROM groups WHERE {c} IS NOT NULL))" for c in ENC)
          + f" SELECT g.year, {', '.join('g.' + c for c in KEYS)}, g.demand, "
          + ", ".join(f"coalesce(e_{c}.{c}_encoded, -1) AS {c}_encoded" for c in ENC)
          + " FROM groups g " + " ".join(f"LEFT JOIN e_{c} ON g.{c} = e_{c}.{c}" for c in ENC),
          ops="W2")
def q_label_encode(spark, sf_dir):
    from orderlab.session import cut_lineage
    return D.label_encode(cut_lineage(D.demand_groups(lines(spark, sf_dir))), ENC)


@register("year_split", ITEMY + ", demand:long, split:string",
          lambda: W() + f""" SELECT year, {KEYS_SQL}, demand, CASE WHEN year IN {yrs(TRAIN)} THEN 'train' ELSE 'test' END AS split
              FROM groups WHERE year IN {yrs(TRAIN + [Y1, Y2])}""",
          ops="M1 P5")
def q_year_split(spark, sf_dir):
    g = D.demand_groups(lines(spark, sf_dir))
    tr, te = D.split_by_years(g, TRAIN, [Y1, Y2])
    return tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))


@register("positional_split", ITEMY + ", demand:long, is_train:bool",
          lambda: W() + f""" SELECT year, {KEYS_SQL}, demand,
                 row_number() OVER (ORDER BY year, {KEYS_SQL}) <= CAST(floor(count(*) OVER () * 0.8) AS BIGINT) AS is_train
                 FROM groups""",
          ops="W3")
def q_positional_split(spark, sf_dir):
    g = D.demand_groups(lines(spark, sf_dir))
    return D.positional_split(g, ["year", *KEYS], 0.8)


FEATURES = ["size_rank", "season_num", "lifecycle_year", "year_idx", "is_youth", "is_women", "is_top", "is_bottom",
            "is_socks"]


def features_df(spark, sf_dir):
    """Features of the demand groups.  The groups are kept (one row per item and year): the
    first year, the scaling, the penalty and the fit each read them, not the lines."""
    g = D.with_year_index(cut_lineage(D.demand_groups(lines(spark, sf_dir))))
    return D.size_features(g, [Y1])


def features_sql() -> str:
    return f""", feat AS (SELECT year, {KEYS_SQL}, demand, {R.size_rank_sql('size')} AS size_rank,
                 {R.season_num_sql('season')} AS season_num, CASE WHEN year IN ({Y1}) THEN 1 ELSE 2 END AS lifecycle_year,
                 year - (SELECT min(year) FROM groups) AS year_idx,
                 CAST({R.size_group_sql('size')} = 'youth' AS INT) AS is_youth,
                 CAST({R.size_group_sql('size')} = 'women' AS INT) AS is_women,
                 CAST(product_category = 'top' AS INT) AS is_top, CAST(product_category = 'bottom' AS INT) AS is_bottom,
                 CAST(product_category = 'socks' AS INT) AS is_socks FROM groups)"""


@register("feature_table", ITEMY + ", demand:double, " + ", ".join(f"{c}:double" for c in FEATURES),
          lambda: W() + features_sql() + f" SELECT year, {KEYS_SQL}, CAST(demand AS DOUBLE) AS demand, "
          + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in FEATURES) + " FROM feat",
          ops="M2 M3 W1 T8 T9 T10")
def q_feature_table(spark, sf_dir):
    f = features_df(spark, sf_dir)
    ft = D.feature_table(f.select(*FEATURES, "demand"))
    # keep the identifying keys next to the feature table
    return f.select("year", *KEYS, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES],
                    F.col("demand").cast("double").alias("demand")).select("year", *KEYS, *ft.columns)


@register("standardize", ITEMY + ", " + ", ".join(f"{c}:double" for c in FEATURES),
          lambda: W() + features_sql() + ", st AS (SELECT " + ", ".join(
              f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)
          + f" FROM feat WHERE year IN {yrs(TRAIN)}) SELECT year, {KEYS_SQL}, " + ", ".join(
              f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in FEATURES)
          + f" FROM feat, st WHERE year IN {yrs([Y1, Y2])}",
          ops="M4")
def q_standardize(spark, sf_dir):
    f = features_df(spark, sf_dir).select("year", *KEYS, *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return D.standardize(f.filter(F.col("year").isin(*TRAIN)), f.filter(F.col("year").isin(Y1, Y2)), FEATURES)


@register("ridge_one_feature", "feature:string, n:long, intercept:double, slope:double",
          lambda: W() + features_sql() + f""", t AS (SELECT CAST(size_rank AS DOUBLE) AS x, CAST(demand AS DOUBLE) AS y
                 FROM feat WHERE year IN {yrs(TRAIN)}),
              z AS (SELECT (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, y FROM t),
              m AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n FROM z),
              c AS (SELECT sum((x - mx) * (y - my)) AS sxy, sum((x - mx) * (x - mx)) AS sxx, any_value(mx) AS mx,
                           any_value(my) AS my, any_value(n) AS n FROM z, m)
              SELECT 'size_rank' AS feature, n, my - sxy / (sxx + 1.0) * mx AS intercept, sxy / (sxx + 1.0) AS slope FROM c""",
          ops="M7")
def q_ridge_one_feature(spark, sf_dir):
    f = features_df(spark, sf_dir).filter(F.col("year").isin(*TRAIN)).select(
        F.col("size_rank").cast("double").alias("size_rank"), F.col("demand").cast("double").alias("demand"))
    z = D.standardize(f, f, ["size_rank"])
    model, _ = FC.fit_predict(z, z.limit(0), ["size_rank"], FC.ridge(z, ["size_rank"], 1.0))
    n = z.count()
    return spark.createDataFrame([("size_rank", n, float(model.intercept), float(model.coefficients[0]))],
                                 "feature string, n long, intercept double, slope double")


# ---------------------------------------------------------------- exploration

@register("demand_by_year_pivot", "year:long, total:long, top:long, bottom:long, socks:long",
          lambda: with_lines() + """ SELECT year, sum(quantity) AS total,
                 coalesce(sum(quantity) FILTER (WHERE product_category = 'top'), 0) AS top,
                 coalesce(sum(quantity) FILTER (WHERE product_category = 'bottom'), 0) AS bottom,
                 coalesce(sum(quantity) FILTER (WHERE product_category = 'socks'), 0) AS socks FROM lines GROUP BY 1""",
          ops="A11 E6")
def q_demand_by_year_pivot(spark, sf_dir):
    return D.year_pivot(lines(spark, sf_dir), "product_category", R.CATEGORIES)


@register("demand_by_year_size", "year:long, total:long, " + ", ".join(f"{s}:long" for s in R.DEFAULT_SIZES),
          lambda: with_lines() + " SELECT year, sum(quantity) AS total, " + ", ".join(
              f"coalesce(sum(quantity) FILTER (WHERE size = '{s}'), 0) AS {s}" for s in R.DEFAULT_SIZES)
          + " FROM lines GROUP BY 1",
          ops="A11 E6")
def q_demand_by_year_size(spark, sf_dir):
    return D.year_pivot(lines(spark, sf_dir), "size", R.DEFAULT_SIZES)


@register("demand_by_size", "size:string, demand:long, lines:long, size_rank:long",
          lambda: with_lines() + f""" SELECT size, sum(quantity) AS demand, count(*) AS lines,
                 {R.size_rank_sql('size')} AS size_rank FROM lines GROUP BY 1""",
          ops="A17 E6")
def q_demand_by_size(spark, sf_dir):
    return (lines(spark, sf_dir).groupBy("size").agg(F.sum("quantity").alias("demand"), F.count(F.lit(1)).alias("lines"))
            .withColumn("size_rank", R.size_rank_col(F.col("size"))))


@register("price_range", "product_category:string, lines:long, min_price:double, max_price:double, mean_price:double",
          lambda: with_lines() + """ SELECT product_category, count(*) AS lines, min(unit_price) AS min_price,
                 max(unit_price) AS max_price, avg(unit_price) AS mean_price FROM lines GROUP BY 1""",
          ops="E6 A8")
def q_price_range(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("product_category").agg(
        F.count(F.lit(1)).alias("lines"), F.min("unit_price").alias("min_price"),
        F.max("unit_price").alias("max_price"), F.avg("unit_price").alias("mean_price"))


@register("recommended_by_size", "size:string, size_rank:long, items:long, mean_recommended:double, mean_actual:double",
          lambda: W() + f""" SELECT size, {R.size_rank_sql('size')} AS size_rank, count(*) AS items,
                 avg(greatest(pred, {float(MOQ)})) AS mean_recommended, avg(demand) AS mean_actual
                 FROM pr WHERE product_category = 'top' GROUP BY 1""",
          ops="E7")
def q_recommended_by_size(spark, sf_dir):
    pred, _, _ = baseline_preds(spark, sf_dir)
    return (pred.filter(F.col("product_category") == "top").groupBy("size")
            .agg(F.count(F.lit(1)).alias("items"),
                 F.avg(F.greatest(F.col("pred"), F.lit(float(MOQ)))).alias("mean_recommended"),
                 F.avg("demand").alias("mean_actual"))
            .withColumn("size_rank", R.size_rank_col(F.col("size"))))


# ---------------------------------------------------------------- JSON configuration

def _config_path(spark) -> str:
    """The configuration written as a JSON file in a new folder of the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/config-{uuid4().hex}"
    spark.createDataFrame([(config_json(CONFIG),)], "value string").coalesce(1).write.text(path)
    return path


@register("config_item_costs", ITEMY + ", unit_cost:double, overage_cost:double, underage_cost:double, budget:double, "
          "moq:long",
          lambda: W() + f""" SELECT te.year, {', '.join('te.' + k for k in KEYS)}, j6.unit_cost, j6.overage_cost,
                 j6.underage_cost, {float(CONFIG.budget)!r} AS budget, {int(CONFIG.moq)} AS moq
                 FROM te LEFT JOIN j6 ON te.product_category IS NOT DISTINCT FROM j6.product_category
                 AND te.lifecycle_year IS NOT DISTINCT FROM j6.period""",
          ops="S2 J6")
def q_config_item_costs(spark, sf_dir):
    """Costs, budget and MOQ of a JSON file on every test item."""
    path = _config_path(spark)
    _, te = train_test(spark, sf_dir)
    items = K.with_costs(te, read_cost_structure(spark, path), "optimizer")
    return (items.crossJoin(F.broadcast(read_constraints(spark, path)))
            .select("year", *KEYS, "unit_cost", "overage_cost", "underage_cost", "budget", "moq"))
