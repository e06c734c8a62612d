"""Registered queries: Model B (two periods) and the A-versus-B comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlab.operators import costs as K
from orderlab.operators import joint as J
from orderlab.operators import plan as PL
from orderlab.operators.scenarios import normal_scenarios
from orderlab.plans.common import MOQ, Y1, Y2, with_lines
from orderlab.plans.forecast_inputs import (CONFIG, KEYS, KEYS_SQL, baseline_preds, cost_ctes, cost_table,
                                            forecast_ctes, model_a_items, resolve_sql, scenario_cte, season_budgets)
from orderlab.plans.registry import register
from orderlab.session import cut_lineage

M = float(MOQ)
ITEM = "season:string, product_category:string, gender_age:string, size:string"


def _inputs(spark, sf_dir):
    pred, _, _ = baseline_preds(spark, sf_dir)
    scen = normal_scenarios(pred, ["year", *KEYS], MOQ)
    first, second = J.two_test_years(pred)
    y1, y2 = pred.filter(F.col("year") == first), pred.filter(F.col("year") == second)
    s1 = scen.filter(F.col("year") == first).drop("year")
    s2 = scen.filter(F.col("year") == second).drop("year")
    spark_ = pred.sparkSession
    periods = spark_.createDataFrame([(1,), (2,), (None,)], "period int")
    combos = pred.select("product_category").distinct().crossJoin(F.broadcast(periods))
    costs = K.resolve_costs(combos, cost_table(spark), "optimizer")
    items = J.joint_items(y1, y2, KEYS, s1, s2, costs)
    p1 = y1.select(*KEYS, F.col("pred").alias("pred1"))
    p2 = y2.select(*KEYS, F.col("pred").alias("pred2"))
    return cut_lineage(items.join(p1, KEYS).join(p2, KEYS))


def _budgets(items):
    return (items.select("season").distinct()
            .withColumn("budget1", F.lit(float(CONFIG.budget))).withColumn("budget2", F.lit(float(CONFIG.budget))))


def joint_ctes() -> str:
    return scenario_cte() + f""",
    jc AS ({resolve_sql("(SELECT DISTINCT te.product_category, p.period FROM te, (VALUES (1), (2), (NULL)) AS p(period))",
                        'optimizer')}),
    jk AS (SELECT {', '.join('a.' + k for k in KEYS)}, a.pred AS pred1, b.pred AS pred2,
                  c1.underage_cost AS cu1, c2.overage_cost AS co2, c2.underage_cost AS cu2, c0.unit_cost
           FROM (SELECT * FROM pr WHERE year = {Y1}) a JOIN (SELECT * FROM pr WHERE year = {Y2}) b USING ({KEYS_SQL})
           LEFT JOIN jc c1 ON c1.product_category IS NOT DISTINCT FROM a.product_category AND c1.period = 1
           LEFT JOIN jc c2 ON c2.product_category IS NOT DISTINCT FROM a.product_category AND c2.period = 2
           LEFT JOIN jc c0 ON c0.product_category IS NOT DISTINCT FROM a.product_category AND c0.period IS NULL),
    jp AS (SELECT jk.*, s1.scenario_id, s1.demand AS d1, s2.demand AS d2 FROM jk
           JOIN scen s1 ON s1.year = {Y1} AND {' AND '.join(f's1.{k} = jk.{k}' for k in KEYS)}
           JOIN scen s2 ON s2.year = {Y2} AND s2.scenario_id = s1.scenario_id AND {' AND '.join(f's2.{k} = jk.{k}' for k in KEYS)})"""


def J_(*extra: str) -> str:
    return with_lines(forecast_ctes(), cost_ctes(), joint_ctes(), *extra)


@register("joint_inputs", ITEM + ", scenario_id:long, d1:double, d2:double, cu1:double, co2:double, cu2:double, "
          "unit_cost:double",
          lambda: J_() + f" SELECT {KEYS_SQL}, scenario_id, d1, d2, cu1, co2, cu2, unit_cost FROM jp",
          ops="B1 J3 U2 J6")
def q_joint_inputs(spark, sf_dir):
    it = _inputs(spark, sf_dir)
    z = it.select(*KEYS, "cu1", "co2", "cu2", "unit_cost",
                  F.posexplode(F.arrays_zip(F.col("d1").alias("a"), F.col("d2").alias("b"))).alias("scenario_id", "p"))
    return z.select(*KEYS, "scenario_id", F.col("p.a").alias("d1"), F.col("p.b").alias("d2"),
                    "cu1", "co2", "cu2", "unit_cost")


def _jcost_sql(q1: str, q2: str) -> str:
    inv = f"greatest({q1} - d1, 0)"
    return (f"avg(cu1 * greatest(d1 - {q1}, 0) + co2 * greatest({q2} + {inv} - d2, 0) "
            f"+ cu2 * greatest(d2 - {q2} - {inv}, 0))")


def _smooth_sql(q1: str, q2: str, k: float = 10.0) -> str:
    from orderlab.functions.newsvendor import softplus_sql
    inv = softplus_sql(f"{q1} - d1", k)
    eff = f"({q2} + {inv})"
    return (f"avg(cu1 * {softplus_sql(f'd1 - {q1}', k)} + co2 * {softplus_sql(f'{eff} - d2', k)} "
            f"+ cu2 * {softplus_sql(f'd2 - {eff}', k)})")


@register("joint_objective", ITEM + ", q1:double, q2:double, joint_cost:double, smooth_cost:double",
          lambda: J_() + f""" SELECT {KEYS_SQL}, greatest(pred1, {M}) AS q1, greatest(pred2, {M}) AS q2,
                 {_jcost_sql(f'greatest(pred1, {M})', f'greatest(pred2, {M})')} AS joint_cost,
                 {_smooth_sql(f'greatest(pred1, {M})', f'greatest(pred2, {M})')} AS smooth_cost
                 FROM jp GROUP BY {KEYS_SQL}, pred1, pred2""",
          ops="B2 B3")
def q_joint_objective(spark, sf_dir):
    it = _inputs(spark, sf_dir)
    q1, q2 = F.greatest(F.col("pred1"), F.lit(M)), F.greatest(F.col("pred2"), F.lit(M))
    smooth, _, _ = J.joint_smooth(q1, q2, 10.0)
    return it.select(*KEYS, q1.alias("q1"), q2.alias("q2"), J.joint_cost(q1, q2).alias("joint_cost"),
                     smooth.alias("smooth_cost"))


@register("expected_carryover", ITEM + ", q1:double, expected_carryover:double",
          lambda: J_() + f""" SELECT {KEYS_SQL}, greatest(pred1, {M}) AS q1,
                 avg(greatest(greatest(pred1, {M}) - d1, 0)) AS expected_carryover FROM jp GROUP BY {KEYS_SQL}, pred1""",
          ops="B7")
def q_expected_carryover(spark, sf_dir):
    it = _inputs(spark, sf_dir)
    q1 = F.greatest(F.col("pred1"), F.lit(M))
    return it.select(*KEYS, q1.alias("q1"), J.expected_carryover(q1).alias("expected_carryover"))


@register("top_carryover", ITEM + ", q1:double, expected_carryover:double",
          lambda: J_() + f""" SELECT {KEYS_SQL}, greatest(pred1, {M}) AS q1,
                 round(avg(greatest(greatest(pred1, {M}) - d1, 0)), 6) AS expected_carryover
                 FROM jp GROUP BY {KEYS_SQL}, pred1 ORDER BY expected_carryover DESC, {KEYS_SQL} LIMIT 10""",
          ops="O7")
def q_top_carryover(spark, sf_dir):
    return J.top_carryover(q_expected_carryover(spark, sf_dir), KEYS)


def _unconstrained_sql() -> str:
    """Per item, the best vertex candidate without budget prices (B5, unconstrained case)."""
    r = J.COST_DIGITS
    return J_() + f""",
    ca AS (SELECT {KEYS_SQL}, {M} AS v FROM jk UNION SELECT {KEYS_SQL}, d1 FROM jp WHERE d1 >= {M}),
    cb AS (SELECT {KEYS_SQL}, {M} AS v FROM jk UNION SELECT {KEYS_SQL}, d2 FROM jp WHERE d2 >= {M}),
    cs AS (SELECT DISTINCT {KEYS_SQL}, d1 + d2 AS v FROM jp),
    cand AS (SELECT {KEYS_SQL}, a.v AS q1, b.v AS q2 FROM ca a JOIN cb b USING ({KEYS_SQL})
             UNION SELECT {KEYS_SQL}, a.v, s.v - a.v FROM ca a JOIN cs s USING ({KEYS_SQL}) WHERE s.v - a.v >= {M}
             UNION SELECT {KEYS_SQL}, s.v - b.v, b.v FROM cb b JOIN cs s USING ({KEYS_SQL}) WHERE s.v - b.v >= {M}),
    cc AS (SELECT {', '.join('c.' + k for k in KEYS)}, c.q1, c.q2,
                  round(avg(jp.cu1 * greatest(jp.d1 - c.q1, 0) + jp.co2 * greatest(c.q2 + greatest(c.q1 - jp.d1, 0) - jp.d2, 0)
                        + jp.cu2 * greatest(jp.d2 - c.q2 - greatest(c.q1 - jp.d1, 0), 0)), {r}) AS cost
           FROM cand c JOIN jp ON {' AND '.join(f'c.{k} = jp.{k}' for k in KEYS)} GROUP BY ALL)
    SELECT {KEYS_SQL}, arg_min(q1, (cost, q1, q2)) AS q1, arg_min(q2, (cost, q1, q2)) AS q2, min(cost) AS joint_cost
    FROM cc GROUP BY ALL"""


@register("joint_unconstrained", ITEM + ", q1:double, q2:double, joint_cost:double", _unconstrained_sql, ops="B5")
def q_joint_unconstrained(spark, sf_dir):
    it = J.with_candidates(_inputs(spark, sf_dir), MOQ)
    best = F.array_min("cands")
    return it.select(*KEYS, best["q1"].alias("q1"), best["q2"].alias("q2"), best["cost"].alias("joint_cost"))


def _orders(spark, sf_dir, it=None, budgets=None):
    it = _inputs(spark, sf_dir) if it is None else it
    bud = _budgets(it) if budgets is None else budgets
    plan, duals = J.joint_orders(it, bud, "season", MOQ)
    return it, bud, plan, duals


@register("joint_orders", ITEM + ", q1:double, q2:double, l1:double, l2:double, joint_cost:double", None, ops="B5")
def q_joint_orders(spark, sf_dir):
    _, _, plan, _ = _orders(spark, sf_dir)
    return plan.select(*KEYS, "q1", "q2", "l1", "l2", J.joint_cost(F.col("q1"), F.col("q2")).alias("joint_cost"))


def _repaired(spark, sf_dir):
    it, bud, plan, duals = _orders(spark, sf_dir)
    rep = cut_lineage(J.joint_repair(plan, bud, "season", MOQ, KEYS))
    return it, bud, rep, duals


@register("joint_repair", ITEM + ", q1:long, q2:long, joint_cost:double, expected_carryover:double", None,
          ops="B4 B6 B7")
def q_joint_repair(spark, sf_dir):
    _, _, rep, _ = _repaired(spark, sf_dir)
    q1, q2 = F.col("q1").cast("double"), F.col("q2").cast("double")
    return rep.select(*KEYS, "q1", "q2", J.joint_cost(q1, q2).alias("joint_cost"),
                      J.expected_carryover(q1).alias("expected_carryover"))


@register("joint_spend", "season:string, y1_spend:double, y2_spend:double, budget1:double, budget2:double, "
          "max_violation:double, feasible:bool, dual_bound:double", None, ops="B8")
def q_joint_spend(spark, sf_dir):
    _, bud, rep, duals = _repaired(spark, sf_dir)
    return J.joint_spend(rep, bud, "season").join(duals.select("season", "dual_bound"), "season")


@register("joint_shadow_price", "season:string, y1_dual:double, y1_dual_after:double, finite_difference:double, "
          "plan_difference:double, gap:double", None, ops="B9")
def q_joint_shadow_price(spark, sf_dir):
    """Year-1 price before and after $50 more, the difference a dollar of the convexified
    optimum (between the two prices, up to the gaps) and that of the plans' exact cost (which
    is not convex and may lie outside)."""
    it, bud, plan, duals = _orders(spark, sf_dir)
    bud_p = bud.withColumn("budget1", F.col("budget1") + 50.0)
    _, _, plan_p, duals_p = _orders(spark, sf_dir, it, bud_p)
    return J.shadow_price(plan, duals, plan_p, duals_p, "season", 50.0)


def _a_plan(spark, sf_dir):
    it = model_a_items(spark, sf_dir)
    return PL.allocate_units(it, season_budgets(it), ["season"], MOQ, ["year", *KEYS])


def _table(spark, sf_dir):
    a = _a_plan(spark, sf_dir)
    it, bud, rep, duals = _repaired(spark, sf_dir)
    return J.formulation_table(a, rep, KEYS, Y1, Y2), a, it, rep, duals


@register("formulation_table", ITEM + ", a_y1_qty:long, a_y2_qty:long, b_y1_qty:long, b_y2_qty:long, "
          "expected_carryover:double, y1_qty_diff:long, y2_qty_diff:long", None, ops="B10 J4")
def q_formulation_table(spark, sf_dir):
    t, _, _, _, _ = _table(spark, sf_dir)
    return t


@register("largest_size_shift", "size:string, abs_y2_shift:long", None, ops="A17")
def q_largest_size_shift(spark, sf_dir):
    t, _, _, _, _ = _table(spark, sf_dir)
    return J.largest_size_shift(t, 5)


def _summary(t, a, it, rep):
    a_cost = a.agg(F.sum(PL.saa_cost(F.col("q").cast("double"))).alias("model_a_total_cost"))
    q1, q2 = F.col("q1").cast("double"), F.col("q2").cast("double")
    b_cost = rep.agg(F.sum(J.joint_cost(q1, q2)).alias("model_b_total_cost"),
                     F.sum(J.expected_carryover(q1)).alias("total_expected_carryover"))
    diff = t.agg(F.sum("y1_qty_diff").alias("y1_total_qty_diff"))
    # Model A's quantities scored by the joint objective (like for like)
    ay = a.select(*KEYS, "year", F.col("q").cast("double").alias("q"))
    a12 = (it.join(ay.filter(F.col("year") == Y1).select(*KEYS, F.col("q").alias("qa1")), KEYS)
           .join(ay.filter(F.col("year") == Y2).select(*KEYS, F.col("q").alias("qa2")), KEYS))
    a_joint = a12.agg(F.sum(J.joint_cost(F.col("qa1"), F.col("qa2"))).alias("a_plan_joint_cost"))
    s = a_cost.crossJoin(b_cost).crossJoin(diff).crossJoin(a_joint)
    myopia = F.col("model_a_total_cost") - F.col("model_b_total_cost")
    return s.select(
        "model_a_total_cost", "model_b_total_cost", myopia.alias("cost_of_myopia_usd"),
        F.when(F.col("model_a_total_cost") > 0, myopia / F.col("model_a_total_cost") * 100).otherwise(0.0)
        .alias("cost_reduction_pct"),
        F.when(F.coalesce(F.col("y1_total_qty_diff"), F.lit(0)) >= 0, "more").otherwise("less").alias("y1_order_direction"),
        "y1_total_qty_diff", "total_expected_carryover", "a_plan_joint_cost",
        (F.col("a_plan_joint_cost") - F.col("model_b_total_cost")).alias("like_for_like_myopia_usd"))


@register("formulation_summary",
          "model_a_total_cost:double, model_b_total_cost:double, cost_of_myopia_usd:double, cost_reduction_pct:double, "
          "y1_order_direction:string, y1_total_qty_diff:long, total_expected_carryover:double, "
          "a_plan_joint_cost:double, like_for_like_myopia_usd:double", None, ops="B11 B12")
def q_formulation_summary(spark, sf_dir):
    t, a, it, rep, _ = _table(spark, sf_dir)
    return _summary(t, a, it, rep)


@register("myopia_like_for_like", ITEM + ", a_q1:double, a_q2:double, a_joint_cost:double", None, ops="B12")
def q_myopia_like_for_like(spark, sf_dir):
    a = _a_plan(spark, sf_dir).select(*KEYS, "year", F.col("q").cast("double").alias("q"))
    it = _inputs(spark, sf_dir)
    x = (it.join(a.filter(F.col("year") == Y1).select(*KEYS, F.col("q").alias("a_q1")), KEYS)
         .join(a.filter(F.col("year") == Y2).select(*KEYS, F.col("q").alias("a_q2")), KEYS))
    return x.select(*KEYS, "a_q1", "a_q2", J.joint_cost(F.col("a_q1"), F.col("a_q2")).alias("a_joint_cost"))


# ------------------------------------------- a given plan: B3 gradient, B4, B6, B8, B10-B12, A17

def _gradient_sql(k: float = 10.0) -> str:
    def sg(z):
        return f"(1.0 / (1.0 + exp(-least(greatest(({z}) * {k}, -60.0), 60.0))))"
    from orderlab.functions.newsvendor import softplus_sql
    q1, q2 = f"greatest(pred1, {M})", f"greatest(pred2, {M})"
    return J_(f"""jg AS (SELECT *, {q1} AS q1, {q2} AS q2, {q2} + {softplus_sql(f'{q1} - d1', k)} AS eff FROM jp),
    jh AS (SELECT *, co2 * {sg('eff - d2')} - cu2 * {sg('d2 - eff')} AS dobj FROM jg)""") + f"""
    SELECT {KEYS_SQL}, q1, q2, avg(-cu1 * {sg('d1 - q1')} + dobj * {sg('q1 - d1')}) AS grad_q1, avg(dobj) AS grad_q2
    FROM jh GROUP BY {KEYS_SQL}, q1, q2"""


@register("joint_gradient", ITEM + ", q1:double, q2:double, grad_q1:double, grad_q2:double", _gradient_sql, ops="B3")
def q_joint_gradient(spark, sf_dir):
    q1, q2 = F.greatest(F.col("pred1"), F.lit(M)), F.greatest(F.col("pred2"), F.lit(M))
    _, g1, g2 = J.joint_smooth(q1, q2, 10.0)
    return _inputs(spark, sf_dir).select(*KEYS, q1.alias("q1"), q2.alias("q2"), g1.alias("grad_q1"), g2.alias("grad_q2"))


# A season's budget of a year: the MOQ spend and this share of what the forecast costs above it
# (no round share: forecasts are fractions, and a projected quantity should not be a whole number).
SHARES = (0.6180339887, 0.3678794412)


def _given(spark, sf_dir):
    """The forecast taken as plan of both years, and budgets that bind."""
    it = _inputs(spark, sf_dir).withColumn("q1", F.greatest("pred1", F.lit(M))).withColumn("q2", F.greatest("pred2", F.lit(M)))
    uc = F.col("unit_cost")
    base = F.sum(uc * M)
    bud = cut_lineage(it.groupBy("season").agg(*[
        F.round(base + share * (F.sum(uc * F.col(q)) - base), 2).alias(b)
        for q, b, share in (("q1", "budget1", SHARES[0]), ("q2", "budget2", SHARES[1]))]))
    return it, bud


def given_ctes() -> str:
    """jb (budgets), jproj (projected p1, p2) and jrep (integer q1, q2) of the forecast plan."""
    def year(i):
        return f"""
    jx{i} AS (SELECT k.*, ceil(round(k.p{i}, 9)) AS u, (ceil(round(k.p{i}, 9)) - {M}) * k.unit_cost AS rem,
                 md5(concat_ws('|', {', '.join('k.' + c for c in KEYS)})) AS h FROM jproj k),
    je{i} AS (SELECT season, sum(unit_cost * u) - any_value(b{i}) AS excess FROM jx{i} JOIN jb USING (season) GROUP BY 1),
    jw{i} AS (SELECT *, sum(rem) OVER (PARTITION BY season ORDER BY unit_cost, h, {KEYS_SQL}
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - rem AS before FROM jx{i} JOIN je{i} USING (season)),
    jr{i} AS (SELECT {KEYS_SQL}, CAST(u - CASE WHEN excess <= 1e-9 THEN 0 ELSE
                 least(greatest(ceil((excess - before) / unit_cost - 1e-9), 0), u - {M}) END AS BIGINT) AS q{i} FROM jw{i})"""

    def scaled(i):
        return (f"{M} + (greatest(pred{i}, {M}) - {M}) * CASE WHEN s{i} <= b{i} + 1e-9 THEN 1.0 WHEN s{i} - mn > 0 "
                f"THEN least(greatest(b{i} - mn, 0.0) / (s{i} - mn), 1.0) ELSE 0.0 END AS p{i}")
    return f"""js AS (SELECT season, sum(unit_cost * {M}) AS mn, sum(unit_cost * greatest(pred1, {M})) AS s1,
                  sum(unit_cost * greatest(pred2, {M})) AS s2 FROM jk GROUP BY 1),
    jb AS (SELECT *, round(mn + {SHARES[0]} * (s1 - mn), 2) AS b1, round(mn + {SHARES[1]} * (s2 - mn), 2) AS b2 FROM js),
    jproj AS (SELECT jk.*, {scaled(1)}, {scaled(2)} FROM jk JOIN jb USING (season)),{year(1)},{year(2)},
    jrep AS (SELECT jk.*, q1, q2 FROM jk JOIN jr1 USING ({KEYS_SQL}) JOIN jr2 USING ({KEYS_SQL}))"""


def _given_repaired(spark, sf_dir):
    it, bud = _given(spark, sf_dir)
    return it, bud, cut_lineage(J.joint_repair(it, bud, "season", MOQ, KEYS))


@register("joint_projection", ITEM + ", q1:double, q2:double",
          lambda: J_(given_ctes()) + f" SELECT {KEYS_SQL}, p1 AS q1, p2 AS q2 FROM jproj", ops="B4")
def q_joint_projection(spark, sf_dir):
    it, bud = _given(spark, sf_dir)
    return J.joint_project(it, bud, "season", MOQ).select(*KEYS, "q1", "q2")


@register("joint_forecast_repair", ITEM + ", q1:long, q2:long, joint_cost:double, expected_carryover:double",
          lambda: J_(given_ctes(), f"jq AS (SELECT jp.*, q1, q2 FROM jp JOIN jrep USING ({KEYS_SQL}))") + f"""
          SELECT {KEYS_SQL}, q1, q2, {_jcost_sql('q1', 'q2')} AS joint_cost, avg(greatest(q1 - d1, 0)) AS expected_carryover
          FROM jq GROUP BY {KEYS_SQL}, q1, q2""", ops="B6 B7")
def q_joint_forecast_repair(spark, sf_dir):
    _, _, rep = _given_repaired(spark, sf_dir)
    q1, q2 = F.col("q1").cast("double"), F.col("q2").cast("double")
    return rep.select(*KEYS, "q1", "q2", J.joint_cost(q1, q2).alias("joint_cost"),
                      J.expected_carryover(q1).alias("expected_carryover"))


@register("joint_forecast_spend", "season:string, y1_spend:double, y2_spend:double, budget1:double, budget2:double, "
          "max_violation:double, feasible:bool",
          lambda: J_(given_ctes()) + """ SELECT season, y1_spend, y2_spend, b1 AS budget1, b2 AS budget2,
              greatest(y1_spend - b1, y2_spend - b2) AS max_violation, greatest(y1_spend - b1, y2_spend - b2) <= 1.0 AS feasible
              FROM (SELECT season, sum(unit_cost * q1) AS y1_spend, sum(unit_cost * q2) AS y2_spend FROM jrep GROUP BY 1) s
              JOIN jb USING (season)""", ops="B8")
def q_joint_forecast_spend(spark, sf_dir):
    _, bud, rep = _given_repaired(spark, sf_dir)
    return J.joint_spend(rep, bud, "season")


def _compare_sql(*extra: str) -> str:
    from orderlab.plans.forecast_inputs import model_a_ctes, units_ctes
    # the scenario table of Model A is that of Model B
    head = model_a_ctes().split("ai AS (", 1)[1]
    return J_(given_ctes(), "ai AS (" + head, units_ctes().lstrip().lstrip(",").lstrip(), f"""
    fq AS (SELECT jp.*, q1, q2 FROM jp JOIN jrep USING ({KEYS_SQL})),
    fb AS (SELECT {KEYS_SQL}, q1 AS b_y1_qty, q2 AS b_y2_qty, avg(greatest(q1 - d1, 0)) AS carry,
                  {_jcost_sql('q1', 'q2')} AS b_cost FROM fq GROUP BY {KEYS_SQL}, q1, q2),
    fa AS (SELECT {KEYS_SQL}, max(q) FILTER (WHERE year = {Y1}) AS a_y1_qty, max(q) FILTER (WHERE year = {Y2}) AS a_y2_qty
           FROM ualloc GROUP BY {KEYS_SQL}),
    ft AS (SELECT {KEYS_SQL}, a_y1_qty, a_y2_qty, b_y1_qty, b_y2_qty, round(carry, 1) AS expected_carryover,
                  b_y1_qty - a_y1_qty AS y1_qty_diff, b_y2_qty - a_y2_qty AS y2_qty_diff
           FROM fa FULL JOIN fb USING ({KEYS_SQL}))""", *extra)


def _given_table(spark, sf_dir):
    a = _a_plan(spark, sf_dir)
    it, _, rep = _given_repaired(spark, sf_dir)
    return J.formulation_table(a, rep, KEYS, Y1, Y2), a, it, rep


@register("forecast_formulations", ITEM + ", a_y1_qty:long, a_y2_qty:long, b_y1_qty:long, b_y2_qty:long, "
          "expected_carryover:double, y1_qty_diff:long, y2_qty_diff:long",
          lambda: _compare_sql() + " SELECT * FROM ft", ops="B10 J4")
def q_forecast_formulations(spark, sf_dir):
    return _given_table(spark, sf_dir)[0]


@register("forecast_size_shift", "size:string, abs_y2_shift:long",
          lambda: _compare_sql() + """ SELECT size, abs(sum(y2_qty_diff)) AS abs_y2_shift FROM ft GROUP BY size
              ORDER BY abs_y2_shift DESC NULLS LAST, size LIMIT 5""", ops="A17")
def q_forecast_size_shift(spark, sf_dir):
    return J.largest_size_shift(_given_table(spark, sf_dir)[0], 5)


SUMMARY = ("model_a_total_cost:double, model_b_total_cost:double, cost_of_myopia_usd:double, cost_reduction_pct:double, "
           "y1_order_direction:string, y1_total_qty_diff:long, total_expected_carryover:double, "
           "a_plan_joint_cost:double, like_for_like_myopia_usd:double")


@register("forecast_formulation_summary", SUMMARY,
          lambda: _compare_sql(f"""ga AS (SELECT sum(c) AS a FROM (SELECT avg(p.co * greatest(p.q - s.demand, 0)
                  + p.cu * greatest(s.demand - p.q, 0)) AS c FROM ualloc p JOIN scen s ON s.year = p.year
                  AND {' AND '.join(f's.{k} = p.{k}' for k in KEYS)} GROUP BY p.year, {', '.join('p.' + k for k in KEYS)})),
              gb AS (SELECT sum(b_cost) AS b, sum(carry) AS carry FROM fb),
              gd AS (SELECT CAST(sum(y1_qty_diff) AS BIGINT) AS d FROM ft),
              gj AS (SELECT sum(c) AS j FROM (SELECT {_jcost_sql('a_y1_qty', 'a_y2_qty')} AS c
                     FROM jp JOIN fa USING ({KEYS_SQL}) WHERE a_y1_qty IS NOT NULL AND a_y2_qty IS NOT NULL
                     GROUP BY {KEYS_SQL}))""") + """
              SELECT a AS model_a_total_cost, b AS model_b_total_cost, a - b AS cost_of_myopia_usd,
                     CASE WHEN a > 0 THEN (a - b) / a * 100 ELSE 0.0 END AS cost_reduction_pct,
                     CASE WHEN coalesce(d, 0) >= 0 THEN 'more' ELSE 'less' END AS y1_order_direction,
                     d AS y1_total_qty_diff, carry AS total_expected_carryover, j AS a_plan_joint_cost,
                     j - b AS like_for_like_myopia_usd FROM ga, gb, gd, gj""", ops="B11 B12")
def q_forecast_formulation_summary(spark, sf_dir):
    return _summary(*_given_table(spark, sf_dir))
