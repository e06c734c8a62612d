"""Registered queries: Model A plans and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlab.operators import costs as K
from orderlab.operators import plan as PL
from orderlab.operators import scenarios as S
from orderlab.plans.common import MOQ, TRAIN, with_lines
from orderlab.plans.forecast_inputs import (CONFIG, IK_SQL, KEYS, KEYS_SQL, baseline_preds, cost_ctes, cost_table,
                                            forecast_ctes, item_join, items_with_scenarios, model_a_ctes, model_a_items,
                                            scenario_cte, season_budgets, units_ctes, winner_ctes, winner_preds)
from orderlab.plans.registry import register

IK = ["year", *KEYS]
ITEMY = "year:long, season:string, product_category:string, gender_age:string, size:string"
M = float(MOQ)


def A(*extra: str) -> str:
    return with_lines(forecast_ctes(), cost_ctes(), model_a_ctes(), *extra)


def _items(spark, sf_dir):
    it = model_a_items(spark, sf_dir)
    return it, season_budgets(it)


@register("saa_objective", ITEMY + ", q:double, saa_cost:double, scenarios:long",
          lambda: A() + f""" SELECT p.year, {', '.join('p.' + k for k in KEYS)}, greatest(p.pred, {M}) AS q,
                 {'avg(p.co * greatest(greatest(p.pred, ' + str(M) + ') - s.demand, 0) + p.cu * greatest(s.demand - greatest(p.pred, ' + str(M) + '), 0))'} AS saa_cost,
                 count(*) AS scenarios FROM ai p JOIN scen s ON {item_join('p', 's')} GROUP BY ALL""",
          ops="N3")
def q_saa_objective(spark, sf_dir):
    it, _ = _items(spark, sf_dir)
    q = F.greatest(F.col("pred"), F.lit(M))
    return it.select(*IK, q.alias("q"), PL.saa_cost(q).alias("saa_cost"), F.size("d").alias("scenarios"))


def _smooth_sql(k: float = 5.0, penalty: float = 1000.0) -> str:
    from orderlab.functions.newsvendor import softplus_sql
    b = CONFIG.budget
    q = f"greatest(p.pred, {M})"
    sig = (lambda z: f"(1.0 / (1.0 + exp(-least(greatest(({z}) * {k}, -60.0), 60.0))))")
    return A() + f""", sp AS (SELECT season, sum(unit_cost * greatest(pred, {M})) AS spend FROM ai GROUP BY 1),
        it AS (SELECT p.year, {', '.join('p.' + kk for kk in KEYS)}, {q} AS q, p.unit_cost,
               avg(p.co * greatest({q} - s.demand, 0) + p.cu * greatest(s.demand - {q}, 0)) AS exact_cost,
               avg(p.co * {softplus_sql(f'{q} - s.demand', k)} + p.cu * {softplus_sql(f's.demand - {q}', k)}) AS smooth_cost,
               avg(p.co * {sig(f'{q} - s.demand')} - p.cu * {sig(f's.demand - {q}')}) AS smooth_grad
               FROM ai p JOIN scen s ON {item_join('p', 's')} GROUP BY ALL)
        SELECT year, {', '.join('it.' + kk for kk in KEYS)}, q, exact_cost, smooth_cost, smooth_cost - exact_cost AS smooth_error,
               smooth_grad + CASE WHEN sp.spend > {b!r} THEN 2.0 * {penalty} * ((sp.spend - {b!r}) / greatest({b!r}, 1.0))
                                  * it.unit_cost / greatest({b!r}, 1.0) ELSE 0.0 END
                           - 2.0 * {penalty} * greatest({M} - q, 0.0) AS gradient,
               CASE WHEN sp.spend > {b!r} THEN {penalty} * power((sp.spend - {b!r}) / greatest({b!r}, 1.0), 2) ELSE 0.0 END
                 AS season_penalty
        FROM it JOIN sp USING (season)"""


@register("smooth_saa", ITEMY + ", q:double, exact_cost:double, smooth_cost:double, smooth_error:double, "
          "gradient:double, season_penalty:double", _smooth_sql, ops="N4")
def q_smooth_saa(spark, sf_dir):
    it, bud = _items(spark, sf_dir)
    k, penalty, b = 5.0, 1000.0, CONFIG.budget
    q = F.greatest(F.col("pred"), F.lit(M))
    obj, grad = PL.smooth_saa(q, k)
    sp = it.groupBy("season").agg(F.sum(F.col("unit_cost") * q).alias("_spend"))
    scaled = F.greatest(F.col("_spend") - b, F.lit(0.0)) / max(b, 1.0)
    x = it.join(F.broadcast(sp), "season")
    return x.select(*IK, q.alias("q"), PL.saa_cost(q).alias("exact_cost"), obj.alias("smooth_cost"),
                    (obj - PL.saa_cost(q)).alias("smooth_error"),
                    (grad + 2.0 * penalty * scaled * F.col("unit_cost") / max(b, 1.0)
                     - 2.0 * penalty * F.greatest(F.lit(M) - q, F.lit(0.0))).alias("gradient"),
                    (penalty * scaled * scaled).alias("season_penalty"))


def _proj_sql(qexpr: str, name: str, src: str = "ai") -> str:
    """CTE ``name``: items of ``src`` with q = projection of ``qexpr`` (N5) per season."""
    b = CONFIG.budget
    return f""", {name}_s AS (SELECT season, sum(unit_cost * greatest({qexpr}, {M})) AS spend,
                   sum(unit_cost * {M}) AS mn FROM {src} GROUP BY 1),
    {name} AS (SELECT {src}.*, s.mn > {b!r} + 1e-9 AS infeasible,
                   {M} + (greatest({qexpr}, {M}) - {M}) * CASE WHEN s.spend <= {b!r} + 1e-9 THEN 1.0
                        WHEN s.spend - s.mn > 0 THEN least(greatest({b!r} - s.mn, 0.0) / (s.spend - s.mn), 1.0)
                        ELSE 0.0 END AS q
               FROM {src} JOIN {name}_s s USING (season))"""


@register("project_budget", ITEMY + ", q:double, q_projected:double, infeasible:bool",
          lambda: A(_proj_sql("pred", "proj")[2:]) + f" SELECT {IK_SQL}, greatest(pred, {M}) AS q, q AS q_projected, "
          "infeasible FROM proj",
          ops="N5")
def q_project_budget(spark, sf_dir):
    it, bud = _items(spark, sf_dir)
    x = it.withColumn("q", F.greatest(F.col("pred"), F.lit(M)))
    return PL.project_budget(x, "q", bud, ["season"], MOQ).select(*IK, "q", "q_projected", "infeasible")


@register("allocate_budget", ITEMY + ", unit_cost:double, q:double, saa_cost:double",
          lambda: A() + f""" SELECT {', '.join('p.' + k for k in IK)}, p.unit_cost, p.q,
                 avg(p.co * greatest(p.q - s.demand, 0) + p.cu * greatest(s.demand - p.q, 0)) AS saa_cost
                 FROM alloc p JOIN scen s ON {item_join('p', 's')} GROUP BY ALL""",
          ops="N6 W4")
def q_allocate_budget(spark, sf_dir):
    it, bud = _items(spark, sf_dir)
    plan, _ = PL.allocate(it, bud, ["season"], MOQ, IK)
    return plan.select(*IK, "unit_cost", "q", PL.saa_cost(F.col("q")).alias("saa_cost"))


def _units(spark, sf_dir):
    it, bud = _items(spark, sf_dir)
    return PL.allocate_units(it, bud, ["season"], MOQ, IK), bud


@register("allocate_budget_units", ITEMY + ", unit_cost:double, q:long, saa_cost:double",
          lambda: A(units_ctes()[2:]) + f""" SELECT {', '.join('p.' + k for k in IK)}, p.unit_cost, p.q,
                 avg(p.co * greatest(p.q - s.demand, 0) + p.cu * greatest(s.demand - p.q, 0)) AS saa_cost
                 FROM ualloc p JOIN scen s ON {item_join('p', 's')} GROUP BY ALL""",
          ops="N7")
def q_allocate_budget_units(spark, sf_dir):
    plan, _ = _units(spark, sf_dir)
    return plan.select(*IK, "unit_cost", "q", PL.saa_cost(F.col("q").cast("double")).alias("saa_cost"))


WHAT_IF_LEVELS = [20000.0, CONFIG.budget, CONFIG.budget + 50.0, 80000.0]


def _what_if(spark, sf_dir, levels, it=None):
    """One allocation job for all budget levels: the level is part of the budget key."""
    if it is None:
        it, _ = _items(spark, sf_dir)
    lv = spark.createDataFrame([(float(x),) for x in levels], "budget_level double")
    itl = it.crossJoin(F.broadcast(lv))  # levels: a short parameter list
    bud = itl.select("budget_level", "season").distinct().withColumn("budget", F.col("budget_level"))
    plan, prices = PL.allocate(itl, bud, ["budget_level", "season"], MOQ, ["budget_level", *IK])
    per = plan.groupBy("budget_level", "season").agg(
        F.sum(F.col("unit_cost") * F.col("q")).alias("spend"),
        F.sum(PL.saa_cost(F.col("q"))).alias("objective"))
    return per.join(prices.select("budget_level", "season", "shadow_price", "infeasible"), ["budget_level", "season"])


def _what_if_sql(levels) -> str:
    parts = [A()]
    for i, b in enumerate(levels):
        parts.append(model_a_ctes(b, f"_{i}", base=False))
    ctes = "".join(parts[1:])
    sel = []
    for i, b in enumerate(levels):
        sel.append(f"""SELECT {float(b)!r} AS budget_level, a.season, sum(a.unit_cost * a.q) AS spend,
                       sum(a.c) AS objective, any_value(pz.shadow_price) AS shadow_price, any_value(pz.infeasible) AS infeasible
                FROM (SELECT p.season, p.unit_cost, p.q,
                             avg(p.co * greatest(p.q - s.demand, 0) + p.cu * greatest(s.demand - p.q, 0)) AS c
                      FROM alloc_{i} p JOIN scen s ON {item_join('p', 's')} GROUP BY p.year, {', '.join('p.' + k for k in KEYS)},
                           p.unit_cost, p.q) a JOIN prices_{i} pz USING (season) GROUP BY a.season""")
    return parts[0] + ctes + " " + " UNION ALL ".join(sel)


@register("budget_what_if", "budget_level:double, season:string, spend:double, objective:double, shadow_price:double, "
          "infeasible:bool", lambda: _what_if_sql(WHAT_IF_LEVELS), ops="N12")
def q_budget_what_if(spark, sf_dir):
    return _what_if(spark, sf_dir, WHAT_IF_LEVELS)


@register("shadow_price", "season:string, budget:double, moq_spend:double, infeasible:bool, shadow_price:double, "
          "finite_difference:double",
          lambda: _what_if_sql([CONFIG.budget, CONFIG.budget + 50.0]).replace(
              " SELECT " + repr(float(CONFIG.budget)) + " AS budget_level", " , wi AS (SELECT " + repr(float(CONFIG.budget))
              + " AS budget_level", 1) + """) SELECT p.season, p.budget, p.moq_spend, p.infeasible, p.shadow_price,
                 (b.objective - h.objective) / 50.0 AS finite_difference
                 FROM prices_0 p JOIN wi b ON b.season = p.season AND b.budget_level = """ + repr(float(CONFIG.budget))
          + " JOIN wi h ON h.season = p.season AND h.budget_level = " + repr(float(CONFIG.budget + 50.0)),
          ops="N11")
def q_shadow_price(spark, sf_dir):
    it, bud = _items(spark, sf_dir)
    _, prices = PL.allocate(it, bud, ["season"], MOQ, IK)
    wi = _what_if(spark, sf_dir, [CONFIG.budget, CONFIG.budget + 50.0], it)
    b = wi.filter(F.col("budget_level") == CONFIG.budget).select("season", F.col("objective").alias("_o0"))
    h = wi.filter(F.col("budget_level") == CONFIG.budget + 50.0).select("season", F.col("objective").alias("_o1"))
    return (prices.join(b, "season").join(h, "season")
            .withColumn("finite_difference", (F.col("_o0") - F.col("_o1")) / 50.0))


@register("budget_diagnostics", "season:string, spend:double, budget:double, violation:double, max_violation:double, "
          "feasible:bool",
          lambda: A(units_ctes()[2:]) + """, d AS (SELECT season, sum(unit_cost * q) AS spend FROM ualloc GROUP BY 1)
              SELECT d.season, d.spend, b.budget, greatest(d.spend - b.budget, 0) AS violation,
                     max(greatest(d.spend - b.budget, 0)) OVER () AS max_violation,
                     max(greatest(d.spend - b.budget, 0)) OVER () <= 1e-6 AS feasible
              FROM d JOIN bud b USING (season)""".replace("bud b", "(SELECT DISTINCT season, "
                                                         + repr(float(CONFIG.budget)) + " AS budget FROM ai) b"),
          ops="N8")
def q_budget_diagnostics(spark, sf_dir):
    plan, bud = _units(spark, sf_dir)
    return PL.budget_diagnostics(plan, "q", bud, ["season"])


@register("order_plan", ITEMY + ", recommended_order_qty:long, procurement_spend:double, expected_demand_saa:double, "
          "expected_overage_units:double, expected_underage_units:double, expected_nv_cost:double, saa_expected_cost:double",
          lambda: A(units_ctes()[2:]) + f""", m AS (SELECT p.year, {', '.join('p.' + k for k in KEYS)}, any_value(p.q) AS q,
                 any_value(p.unit_cost) AS unit_cost, any_value(p.co) AS co, any_value(p.cu) AS cu, avg(s.demand) AS mean_d,
                 avg(p.co * greatest(p.q - s.demand, 0) + p.cu * greatest(s.demand - p.q, 0)) AS saa
                 FROM ualloc p JOIN scen s ON {item_join('p', 's')} GROUP BY ALL)
              SELECT {IK_SQL}, q AS recommended_order_qty, q * unit_cost AS procurement_spend, mean_d AS expected_demand_saa,
                     greatest(q - mean_d, 0) AS expected_overage_units, greatest(mean_d - q, 0) AS expected_underage_units,
                     co * greatest(q - mean_d, 0) + cu * greatest(mean_d - q, 0) AS expected_nv_cost,
                     saa AS saa_expected_cost FROM m""",
          ops="N9")
def q_order_plan(spark, sf_dir):
    plan, _ = _units(spark, sf_dir)
    return PL.order_plan(plan, "q", IK)


# ---------------------------------------------------------------- policies

def _policies(spark, sf_dir):
    it, bud = _items(spark, sf_dir)
    units = PL.allocate_units(it, bud, ["season"], MOQ, IK).select(*IK, "unit_cost", "co", "cu", "d",
                                                                   F.col("q").cast("double").alias("q"))
    cont, _ = PL.allocate(it, bud, ["season"], MOQ, IK)
    cont = cont.select(*IK, "unit_cost", "co", "cu", "d", "q")
    p50 = PL.project_budget(it.withColumn("q0", F.greatest(F.col("pred"), F.lit(M))), "q0", bud, ["season"], MOQ)
    crq = F.element_at(F.col("d"), F.ceil(F.size("d") * F.col("cu") / (F.col("cu") + F.col("co"))).cast("int"))
    crp = PL.project_budget(it.withColumn("q0", crq), "q0", bud, ["season"], MOQ)
    strict = K.resolve_costs(K.item_combos(it), cost_table(spark), "strict", ("overage_cost", "underage_cost"))
    sf = K.critical_ratio_table(strict, 0.8)
    pto = K.pto_adjust(it, sf)
    ptp = PL.project_budget(pto, "pred_pto", bud, ["season"], MOQ)
    out = None
    for name, df, col in [("allocation_units", units, "q"), ("allocation", cont, "q"),
                          ("proportional", p50, "q_projected"), ("cr_quantile", crp, "q_projected"),
                          ("pto", ptp, "q_projected")]:
        x = df.select(F.lit(name).alias("policy"), *IK, "unit_cost", "co", "cu", "d", F.col(col).alias("q"))
        out = x if out is None else out.unionByName(x)
    return out, bud


def _policies_sql() -> str:
    ctes = units_ctes() + _proj_sql("pred", "pp50") + f""",
    crq AS (SELECT {IK_SQL}, demand AS q_cr FROM (SELECT s.*, p.co, p.cu, row_number() OVER (PARTITION BY
              {', '.join('s.' + k for k in IK)} ORDER BY s.demand) AS rn, count(*) OVER (PARTITION BY
              {', '.join('s.' + k for k in IK)}) AS n FROM scen s JOIN ai p ON {item_join('p', 's')})
            WHERE rn = CAST(ceil(n * cu / (cu + co)) AS BIGINT)),
    ai_cr AS (SELECT ai.*, crq.q_cr FROM ai JOIN crq USING ({IK_SQL})),
    ai_pto AS (SELECT ai.*, greatest(ai.pred * coalesce(crt.safety_factor, 1.0), 0.0) AS q_pto FROM ai LEFT JOIN crt
               ON ai.product_category IS NOT DISTINCT FROM crt.product_category AND ai.lifecycle_year IS NOT DISTINCT FROM crt.period)"""
    ctes += _proj_sql("q_cr", "pcr", "ai_cr") + _proj_sql("q_pto", "ppto", "ai_pto")
    cols = f"{IK_SQL}, unit_cost, co, cu"
    union = f""", plans AS (SELECT 'allocation_units' AS policy, {cols}, CAST(q AS DOUBLE) AS q FROM ualloc
        UNION ALL SELECT 'allocation', {cols}, q FROM alloc
        UNION ALL SELECT 'proportional', {cols}, q FROM pp50
        UNION ALL SELECT 'cr_quantile', {cols}, q FROM pcr
        UNION ALL SELECT 'pto', {cols}, q FROM ppto)"""
    return A(ctes[2:], union[2:])


@register("union_plans", "policy:string, " + ITEMY + ", q:double",
          lambda: _policies_sql() + f" SELECT policy, {IK_SQL}, q FROM plans", ops="U1 N5 N6 N7 M11")
def q_union_plans(spark, sf_dir):
    out, _ = _policies(spark, sf_dir)
    return out.select("policy", *IK, "q")


@register("policy_comparison", "policy:string, objective_value:double, total_spend:double, max_budget_violation:double, "
          "feasible:bool, rank:long",
          lambda: _policies_sql() + f""", per AS (SELECT p.policy, p.season, sum(c) AS obj, sum(p.unit_cost * p.q) AS spend
                 FROM (SELECT p.policy, p.season, p.unit_cost, p.q,
                              avg(p.co * greatest(p.q - s.demand, 0) + p.cu * greatest(s.demand - p.q, 0)) AS c
                       FROM plans p JOIN scen s ON {item_join('p', 's')}
                       GROUP BY p.policy, {', '.join('p.' + k for k in IK)}, p.unit_cost, p.q) p GROUP BY 1, 2),
              s AS (SELECT policy, sum(obj) AS objective_value, sum(spend) AS total_spend,
                           max(greatest(spend - {CONFIG.budget!r}, 0)) AS max_budget_violation FROM per GROUP BY 1)
              SELECT *, max_budget_violation <= 1e-6 AS feasible,
                     row_number() OVER (ORDER BY max_budget_violation <= 1e-6 DESC, objective_value, policy) AS rank FROM s""",
          ops="N10 O4")
def q_policy_comparison(spark, sf_dir):
    out, bud = _policies(spark, sf_dir)
    return PL.policy_summary(out, bud, ["season"])


@register("plan_check", "season:string, spend:double, budget:double, within_budget:bool, below_moq:long, negative:long, "
          "non_integer:long",
          lambda: A(units_ctes()[2:]) + f""" SELECT season, sum(unit_cost * q) AS spend, {CONFIG.budget!r} AS budget,
                 sum(unit_cost * q) <= {CONFIG.budget!r} + 1e-6 AS within_budget, count_if(q < {MOQ}) AS below_moq,
                 count_if(q < 0) AS negative, count_if(q <> floor(q)) AS non_integer FROM ualloc GROUP BY 1""",
          ops="D11")
def q_plan_check(spark, sf_dir):
    plan, bud = _units(spark, sf_dir)
    q = F.col("q").cast("double")
    return (plan.groupBy("season").agg(F.sum(F.col("unit_cost") * q).alias("spend"),
                                       F.count_if(q < MOQ).alias("below_moq"), F.count_if(q < 0).alias("negative"),
                                       F.count_if(q != F.floor(q)).alias("non_integer"))
            .join(bud, "season").withColumn("within_budget", F.col("spend") <= F.col("budget") + 1e-6))


# ---------------------------------------------------------------- plans from other forecasts

PLAN_SQL = f""" SELECT {', '.join('p.' + k for k in IK)}, p.pred, p.unit_cost, p.q,
                 avg(p.co * greatest(p.q - s.demand, 0) + p.cu * greatest(s.demand - p.q, 0)) AS saa_cost
                 FROM alloc p JOIN scen s ON {item_join('p', 's')} GROUP BY ALL"""


@register("winner_scenarios", ITEMY + ", model:string, pred:double, sigma:double, scenario_id:long, scenario_demand:double",
          lambda: with_lines(winner_ctes(), scenario_cte()) + f" SELECT {', '.join('p.' + k for k in IK)}, p.model, p.pred, p.sigma, "
          f"s.scenario_id, s.demand AS scenario_demand FROM pr p JOIN scen s ON {item_join('p', 's')}",
          ops="M15 M13 O5")
def q_winner_scenarios(spark, sf_dir):
    pred = winner_preds(spark, sf_dir)
    scen = S.normal_scenarios(pred, [*IK, "model", "pred", "sigma"], MOQ)
    return scen.withColumnRenamed("demand", "scenario_demand")


@register("winner_plan", ITEMY + ", pred:double, unit_cost:double, q:double, saa_cost:double",
          lambda: with_lines(winner_ctes(), model_a_ctes()) + PLAN_SQL, ops="M15 M13 N6")
def q_winner_plan(spark, sf_dir):
    """The winner's scenarios through the budget allocation."""
    pred = winner_preds(spark, sf_dir)
    it = items_with_scenarios(spark, pred, S.normal_scenarios(pred, IK, MOQ))
    plan, _ = PL.allocate(it, season_budgets(it), ["season"], MOQ, IK)
    return plan.select(*IK, "pred", "unit_cost", "q", PL.saa_cost(F.col("q")).alias("saa_cost"))


def _history_sql() -> str:
    scen = f"""scen AS (SELECT te.year, {', '.join('te.' + k for k in KEYS)}, tr.year AS scenario_id, CAST(tr.demand AS DOUBLE) AS demand
             FROM te JOIN tr USING ({KEYS_SQL}))"""
    known = forecast_ctes().replace("FROM pr0 CROSS JOIN sg)", f"FROM pr0 SEMI JOIN tr USING ({KEYS_SQL}) CROSS JOIN sg)")
    return with_lines(known, cost_ctes(), model_a_ctes().replace(scenario_cte(), scen)) + PLAN_SQL


@register("history_saa_plan", ITEMY + ", pred:double, unit_cost:double, q:double, saa_cost:double", _history_sql, ops="M14 N3 N6")
def q_history_saa_plan(spark, sf_dir):
    """M14 into N6: each test item's train years are its scenarios (items without history have none)."""
    pred, tr, _ = baseline_preds(spark, sf_dir)
    past = S.empirical_scenarios(tr, KEYS, TRAIN)
    scen = pred.select(*IK).join(past, KEYS).select(*IK, "scenario_id", "demand")
    it = items_with_scenarios(spark, pred, scen)
    plan, _ = PL.allocate(it, season_budgets(it), ["season"], MOQ, IK)
    return plan.select(*IK, "pred", "unit_cost", "q", PL.saa_cost(F.col("q")).alias("saa_cost"))


# ---------------------------------------------------------------- caps on units

UNIT_LEVELS = [("money", CONFIG.budget, 1e9), ("units", 1e9, 3000.0)]


def _unit_cap_sql() -> str:
    """The two cases in which one budget binds: money as in N6, units as N6 with unit cost 1."""
    money, cap = UNIT_LEVELS[0][1], UNIT_LEVELS[1][2]
    cost = "avg(p.co * greatest(p.q - s.demand, 0) + p.cu * greatest(s.demand - p.q, 0))"
    return A(model_a_ctes(money, "_m", base=False)[2:].lstrip()) + f""",
    ivu AS (SELECT *, round(-((co * k - cu * (n - k)) / n), 10) AS benefit FROM ivr),
    uav AS (SELECT season, {cap!r} - count(*) * {M} AS room FROM ai GROUP BY 1),
    uw AS (SELECT b.*, u.room, sum(units) OVER (PARTITION BY season ORDER BY benefit DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
           FROM (SELECT season, benefit, sum(length) AS units FROM ivu GROUP BY ALL) b JOIN uav u USING (season)),
    ucap AS (SELECT season, benefit, CASE WHEN room < 0 THEN 0.0 WHEN cum <= room THEN 1.0
                    WHEN cum - units >= room THEN 0.0 ELSE (room - (cum - units)) / units END AS frac FROM uw),
    allocu AS (SELECT ai.*, {M} + coalesce(x.extra, 0.0) AS q FROM ai LEFT JOIN
               (SELECT {IK_SQL}, sum(length * frac) AS extra FROM ivu JOIN ucap USING (season, benefit) GROUP BY ALL) x USING ({IK_SQL})),
    both_ AS (SELECT 'money' AS binding, p.season, p.unit_cost, p.q, {cost} AS c FROM alloc_m p JOIN scen s ON {item_join('p', 's')}
              GROUP BY p.year, {', '.join('p.' + k for k in KEYS)}, p.unit_cost, p.q
              UNION ALL SELECT 'units', p.season, p.unit_cost, p.q, {cost} FROM allocu p JOIN scen s ON {item_join('p', 's')}
              GROUP BY p.year, {', '.join('p.' + k for k in KEYS)}, p.unit_cost, p.q)
    SELECT binding, season, sum(unit_cost * q) AS spend, sum(q) AS units, sum(c) AS objective FROM both_ GROUP BY ALL"""


@register("unit_cap_what_if", "binding:string, season:string, spend:double, units:double, objective:double", _unit_cap_sql, ops="N12 N6")
def q_unit_cap_what_if(spark, sf_dir):
    it, _ = _items(spark, sf_dir)
    lv = spark.createDataFrame(UNIT_LEVELS, "binding string, budget double, unit_cap double")
    itl = it.crossJoin(F.broadcast(lv.select("binding")))  # levels: a short parameter list
    bud = itl.select("binding", "season").distinct().join(F.broadcast(lv), "binding")
    plan, _ = PL.allocate_capped(itl, bud, ["binding", "season"], MOQ)
    return plan.groupBy("binding", "season").agg(
        F.sum(F.col("unit_cost") * F.col("q")).alias("spend"), F.sum("q").alias("units"), F.sum(PL.saa_cost(F.col("q"))).alias("objective"))
