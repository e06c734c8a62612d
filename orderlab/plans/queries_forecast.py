"""Registered queries: plan evaluation against the historical-mean baseline
(E1-E3, J8, W5), Spark ML forecasters (M5-M9, M15), the grouped
forecaster (F2) and sources/sinks (S1, S3, S4, S5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlab.functions import rules as R
from orderlab.operators import costs as K
from orderlab.operators import evaluate as E
from orderlab.operators import forecast as FC
from orderlab.operators import plan as PL
from orderlab.plans.common import CO_MULT, CU_MULT, MOQ, TRAIN, Y1, Y2, lines, with_lines
from orderlab.plans.forecast_inputs import (KEYS, cost_ctes, cost_table, forecast_ctes, model_a_ctes,
                                            model_a_items, season_budgets, train_test, units_ctes)
from orderlab.plans.queries_clean import backtest_sql_cte, rollup_sql, sensitivity_sql
from orderlab.plans.registry import register
from orderlab.session import checkpoint_dir, cut_lineage
from orderlab.sources.tables import TABLES

SKU = ["product_category", "gender_age", "size"]


def _eval_rows(spark, sf_dir):
    """Test rows scored with the plan's quantities (J8/W5) and the baseline (A2)."""
    tr, te = train_test(spark, sf_dir)
    it = model_a_items(spark, sf_dir)
    plan = PL.allocate_units(it, season_budgets(it), ["season"], MOQ, ["year", *KEYS])
    sku = R.item_key_col(F.col("product_category"), F.col("gender_age"), F.col("size"))
    # the plan keyed by sku: later (year, season) rows win, as a dict built in row order would
    agent = plan.groupBy(sku.alias("sku")).agg(
        F.max_by(F.col("q"), F.struct(F.col("year"), F.col("season"))).cast("double").alias("agent_qty"))
    base = FC.baseline_by_item(tr).select(sku.alias("sku"), "baseline_qty")
    rows = te.select("year", *KEYS, sku.alias("sku"), F.col("demand").cast("double").alias("actual_demand"),
                     "unit_price")
    x = (rows.join(agent, "sku", "left").join(base, "sku", "left")
         .withColumn("agent_qty", F.coalesce("agent_qty", F.lit(0.0)))
         .withColumn("baseline_qty", F.coalesce("baseline_qty", F.lit(0.0))))
    co, cu = F.col("unit_price") * CO_MULT, F.col("unit_price") * CU_MULT
    from orderlab.functions.newsvendor import nv_cost
    return x.select("*", nv_cost(F.col("agent_qty"), F.col("actual_demand"), co, cu).alias("agent_cost"),
                    nv_cost(F.col("baseline_qty"), F.col("actual_demand"), co, cu).alias("baseline_cost")) \
            .withColumn("savings", F.round("baseline_cost", 4) - F.round("agent_cost", 4))


def _eval_sql() -> str:
    sku = "lower(coalesce(product_category, 'None') || '_' || coalesce(gender_age, 'None') || '_' || coalesce(size, 'None'))"
    return with_lines(forecast_ctes(), cost_ctes(), model_a_ctes(), units_ctes()[2:]) + f""",
    ag AS (SELECT {sku} AS sku, CAST(arg_max(q, (year, season)) AS DOUBLE) AS agent_qty FROM ualloc GROUP BY 1),
    bq AS (SELECT {sku} AS sku, round(avg(demand), 2) AS baseline_qty FROM tr GROUP BY 1),
    ev0 AS (SELECT te.year, te.season, te.product_category, te.gender_age, te.size, {sku} AS sku,
                   CAST(te.demand AS DOUBLE) AS actual_demand, te.unit_price FROM te),
    ev AS (SELECT ev0.*, coalesce(ag.agent_qty, 0.0) AS agent_qty, coalesce(bq.baseline_qty, 0.0) AS baseline_qty
           FROM ev0 LEFT JOIN ag USING (sku) LEFT JOIN bq USING (sku)),
    evs AS (SELECT *, unit_price * {CO_MULT!r} * greatest(agent_qty - actual_demand, 0)
                      + unit_price * {CU_MULT!r} * greatest(actual_demand - agent_qty, 0) AS agent_cost,
                      unit_price * {CO_MULT!r} * greatest(baseline_qty - actual_demand, 0)
                      + unit_price * {CU_MULT!r} * greatest(actual_demand - baseline_qty, 0) AS baseline_cost FROM ev)"""


@register("baseline_comparison",
          "year:long, season:string, product_category:string, gender_age:string, size:string, sku:string, "
          "actual_demand:double, unit_price:double, agent_qty:double, baseline_qty:double, agent_cost:double, "
          "baseline_cost:double, savings:double",
          lambda: _eval_sql() + " SELECT *, round(baseline_cost, 4) - round(agent_cost, 4) AS savings FROM evs",
          ops="E1 J8 W5 A2 T7")
def q_baseline_comparison(spark, sf_dir):
    return _eval_rows(spark, sf_dir)


@register("baseline_by_category", "product_category:string, items:long, agent_cost:double, baseline_cost:double, "
          "savings:double, reduction_pct:double",
          lambda: _eval_sql() + """ SELECT product_category, items, agent_cost, baseline_cost, baseline_cost - agent_cost AS savings,
                 CASE WHEN baseline_cost > 0 THEN (baseline_cost - agent_cost) / baseline_cost * 100 ELSE 0.0 END AS reduction_pct
                 FROM (SELECT product_category, count(*) AS items, sum(agent_cost) AS agent_cost, sum(baseline_cost) AS baseline_cost
                       FROM evs GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), sum(agent_cost), sum(baseline_cost) FROM evs)""",
          ops="E2 A6")
def q_baseline_by_category(spark, sf_dir):
    return E.cost_rollup(_eval_rows(spark, sf_dir))


@register("cost_sensitivity", "parameter:string, shift_pct:long, multiplier:double, total_cost:double, pct_change:double",
          lambda: _eval_sql() + " " + sensitivity_sql("evs", "agent_qty", "actual_demand", "unit_price", CO_MULT, CU_MULT),
          ops="E3 J9")
def q_cost_sensitivity(spark, sf_dir):
    return E.sensitivity(_eval_rows(spark, sf_dir), "agent_qty", "actual_demand", "unit_price", CO_MULT, CU_MULT)


# ---------------------------------------------------------------- Spark ML forecasters (rows-only)

FEATURES = ["size_rank", "season_num", "lifecycle_year", "year_idx", "is_youth", "is_women", "is_top", "is_bottom",
            "is_socks"]


def _ml_frames(spark, sf_dir):
    from orderlab.operators import demand as D
    tr, te = train_test(spark, sf_dir)
    allg = tr.unionByName(te.drop("lifecycle_year"))
    f = D.size_features(D.with_year_index(allg), [Y1])
    f = f.select("year", *KEYS, "unit_price", *[F.col(c).cast("double").alias(c) for c in FEATURES],
                 F.col("demand").cast("double").alias("demand"))
    f = cut_lineage(f)
    return f.filter(F.col("year").isin(*TRAIN)), f.filter(F.col("year").isin(Y1, Y2))


def _ml_predictions(spark, sf_dir, trees: int = 300):
    from orderlab.operators import demand as D
    tr, te = _ml_frames(spark, sf_dir)
    gm, gp = FC.fit_predict(tr, te, FEATURES, FC.gbt(trees=trees))
    fm, fp = FC.fit_predict(tr, te, FEATURES, FC.forest(trees=trees))
    trz = D.standardize(tr, tr, FEATURES)
    tez = D.standardize(tr, te, FEATURES)
    _, rp = FC.fit_predict(trz, tez, FEATURES, FC.ridge(trz, FEATURES, 1.0))
    return gm, gp, fm, fp, rp, tr, te


@register("gbt_forecast", "year:long, season:string, product_category:string, gender_age:string, size:string, "
          "demand:double, pred:double", None, ops="M5 M2")
def q_gbt_forecast(spark, sf_dir):
    tr, te = _ml_frames(spark, sf_dir)
    _, p = FC.fit_predict(tr, te, FEATURES, FC.gbt())
    return p


@register("forest_forecast", "year:long, season:string, product_category:string, gender_age:string, size:string, "
          "demand:double, pred:double", None, ops="M6")
def q_forest_forecast(spark, sf_dir):
    tr, te = _ml_frames(spark, sf_dir)
    _, p = FC.fit_predict(tr, te, FEATURES, FC.forest())
    return p


@register("feature_importance", "feature:string, importance:double", None, ops="M9")
def q_feature_importance(spark, sf_dir):
    tr, te = _ml_frames(spark, sf_dir)
    m, _ = FC.fit_predict(tr, te, FEATURES, FC.gbt())
    return spark.createDataFrame(FC.feature_importance(m, FEATURES), "feature string, importance double")


@register("ml_model_selection", "model:string, items:long, nv_cost:double, pct_vs_baseline:double, winner:bool",
          None, ops="M15 M5 M6 M7 M11 O5")
def q_ml_model_selection(spark, sf_dir):
    _, gp, _, fp, rp, tr, te = _ml_predictions(spark, sf_dir)
    keys = ["year", *KEYS]
    base = FC.baseline_predict(tr.select(*KEYS, "demand"), te.select(*keys, "lifecycle_year", "demand"), KEYS)
    longp = None
    for name, df in [("Baseline", base), ("GBT", gp), ("Forest", fp), ("Ridge", rp)]:
        x = df.select(*keys, "lifecycle_year", "demand", F.greatest(F.col("pred"), F.lit(0.0)).alias("pred"),
                      F.lit(name).alias("model"))
        longp = x if longp is None else longp.unionByName(x)
    scored = K.strict_scoring_costs(longp, cost_table(spark))
    strict = K.resolve_costs(K.item_combos(scored), cost_table(spark), "strict", ("overage_cost", "underage_cost"))
    pto = K.pto_adjust(scored.filter(F.col("model") != "Baseline"), K.critical_ratio_table(strict, 0.8))
    pto = pto.select(*scored.columns).withColumn("pred", F.col("pred")) \
        .join(pto.select(*keys, "model", "pred_pto"), [*keys, "model"]) \
        .withColumn("pred", F.col("pred_pto")).withColumn("model", F.concat("model", F.lit("+PTO"))).drop("pred_pto")
    return FC.score_models(scored.unionByName(pto))


# Overrides of the default settings; few trees, since every setting is a fit of its own.
GRID = [("Ridge alpha=0.1", "ridge", 0.1), ("Ridge alpha=1", "ridge", 1.0), ("Ridge alpha=100", "ridge", 100.0),
        ("Forest depth=3", "forest", {"maxDepth": 3}), ("Forest depth=6", "forest", {"maxDepth": 6}),
        ("Forest depth=4 sample=0.5", "forest", {"subsamplingRate": 0.5})]


@register("settings_grid", "model:string, items:long, nv_cost:double, pct_vs_baseline:double, winner:bool", None, ops="M16 M15 O5")
def q_settings_grid(spark, sf_dir):
    """Several hyperparameter settings, each scored by its asymmetric cost on the test years."""
    from orderlab.operators import demand as D
    tr, te = _ml_frames(spark, sf_dir)
    trz, tez = D.standardize(tr, tr, FEATURES), D.standardize(tr, te, FEATURES)
    forest = FC.forest(trees=20)
    settings = [(n, FC.ridge(trz, FEATURES, v), {}) if kind == "ridge" else (n, forest, v) for n, kind, v in GRID]
    keys = ["year", *KEYS]
    base = FC.baseline_predict(tr.select(*KEYS, "demand"), te.select(*keys, "lifecycle_year", "demand"), KEYS)
    longp = FC.GridFit(settings, FEATURES).predictions(trz, tez)
    cols = [*keys, F.col("lifecycle_year"), "demand", "pred", "model"]
    lifecycle = F.when(F.col("year") == Y1, 1).otherwise(2)  # the standardised column is a feature now
    longp = longp.withColumn("lifecycle_year", lifecycle).select(*cols)
    base = base.withColumn("lifecycle_year", lifecycle).withColumn("model", F.lit("Baseline")).select(*cols)
    return FC.score_models(K.strict_scoring_costs(longp.unionByName(base), cost_table(spark)))


@register("nv_loss_model", "year:long, season:string, product_category:string, gender_age:string, size:string, "
          "demand:double, pred:double", None, ops="M8")
def q_nv_loss_model(spark, sf_dir):
    from orderlab.operators import demand as D
    tr, te = _ml_frames(spark, sf_dir)
    trz, tez = D.standardize(tr, tr, FEATURES), D.standardize(tr, te, FEATURES)
    # strict costs of each row's category, Year-1 period for training
    cost = K.strict_scoring_costs(trz.withColumn("lifecycle_year", F.lit(1)), cost_table(spark))
    b, hi = FC.nv_loss_fit(cost, FEATURES, epochs=80)
    return FC.nv_loss_predict(tez, FEATURES, b, hi)


@register("grouped_forecast", "season:string, product_category:string, gender_age:string, size:string, year:long, "
          "pred:double", lambda: with_lines(f"""
    fit AS (SELECT {', '.join(KEYS)}, count(*) AS n, avg(demand) AS mean,
                     regr_slope(CAST(demand AS DOUBLE), CAST(year AS DOUBLE)) AS slope,
                     regr_intercept(CAST(demand AS DOUBLE), CAST(year AS DOUBLE)) AS icpt
              FROM groups WHERE year IN ({', '.join(map(str, TRAIN))}) GROUP BY ALL)""") + f"""
    SELECT {', '.join(KEYS)}, y AS year, greatest(CASE WHEN n = 1 THEN mean ELSE icpt + slope * y END, 0) AS pred
    FROM fit, (VALUES ({Y1}), ({Y2})) AS t(y)""", ops="F2")
def q_grouped_forecast(spark, sf_dir):
    tr, te = train_test(spark, sf_dir)
    return FC.trend_forecast(tr, TRAIN, [Y1, Y2], KEYS)


# ---------------------------------------------------------------- sources and sinks (rows-only)

@register("file_fingerprint", "table_name:string, bytes:long, sha256:string, rows:long, content_hash:string", None,
          ops="S5")
def q_file_fingerprint(spark, sf_dir):
    """SHA-256 of every input table's bytes (a long file range by range, see ``file_digests``; of several
    part files, the hash of their hashes in path order) plus an order-insensitive content fingerprint per table: the sum of 64-bit
    row hashes as a decimal (no sort, no single-task pass)."""
    from orderlab.sources.files import file_digests
    files = None
    for t in TABLES:  # a table is a file or a folder of part files; hashes of its files in path order
        one = file_digests(spark, f"{sf_dir}/{t}.parquet").withColumn("table_name", F.lit(t))
        files = one if files is None else files.unionByName(one)
    part = F.array_sort(F.collect_list(F.struct("path", "sha")))
    files = files.groupBy("table_name").agg(F.sum("length").alias("bytes"), part.alias("parts")).select(
        "table_name", "bytes", F.when(F.size("parts") == 1, F.col("parts")[0]["sha"])
        .otherwise(F.sha2(F.array_join(F.col("parts.sha"), ","), 256)).alias("sha256"))
    out = None
    for t in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        h = df.select(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)").alias("h"))
        c = h.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("rows"),
                  F.sum("h").cast("string").alias("content_hash"))
        out = c if out is None else out.unionByName(c)
    return out.join(files, "table_name", "left")


@register("csv_roundtrip", "order_id:long, order_date:date, season:string, year:long, uniform_set:string, "
          "product_category:string, gender_age:string, size:string, color:string, number:string, quantity:long, "
          "unit_price:double", lambda: with_lines() + " SELECT * FROM lines", ops="S1 S3 O1")
def q_csv_roundtrip(spark, sf_dir):
    """S3 then S1: clean lines written as CSV (year-partitioned, sorted within
    files) under the checkpoint folder, then read back with an explicit schema."""
    import uuid

    from orderlab.operators.clean import write_clean_lines
    from orderlab.sources.files import CLEAN_SCHEMA, read_csv
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_clean_lines(lines(spark, sf_dir), path, fmt="csv")
    return read_csv(spark, path, CLEAN_SCHEMA)


@register("json_summary_sink", "product_category:string, items:long, agent_cost:double, baseline_cost:double, "
          "savings:double, reduction_pct:double", lambda: with_lines(backtest_sql_cte()) + " " + rollup_sql(
              "bt_scored", "product_category", "agent_cost", "baseline_cost"), ops="S4")
def q_json_summary_sink(spark, sf_dir):
    """The backtest summary written as JSON and read back."""
    import uuid

    from orderlab.plans.queries_clean import q_backtest_by_category
    path = f"{checkpoint_dir(spark)}/json-{uuid.uuid4().hex}"
    q_backtest_by_category(spark, sf_dir).write.mode("overwrite").json(path)
    return spark.read.schema("product_category string, items long, agent_cost double, baseline_cost double, "
                             "savings double, reduction_pct double").json(path)
