"""Shared forecast inputs for the queries: train/test demand groups, baseline
predictions, residual sigma, costs and scenarios (Spark) and the same as
DuckDB CTEs (oracle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlab.functions.normal import norm_ppf_sql
from orderlab.operators import costs as K
from orderlab.operators import demand as D
from orderlab.operators import forecast as FC
from orderlab.operators import scenarios as S
from orderlab.plans.common import MOQ, TRAIN, Y1, Y2, lines, yrs
from orderlab.session import cut_lineage
from orderlab.sources.config import COST_ALIASES, ProblemConfig

CONFIG = ProblemConfig()
KEYS = D.ITEM_KEYS
KEYS_SQL = ", ".join(KEYS)
TEST = [Y1, Y2]


def groups(spark, sf_dir) -> DataFrame:
    """Demand groups, materialised once per query in the checkpoint folder.

    The groups are aggregated (one row per item and year), so the write is
    small; every later use (train/test split, baselines, residuals, costs)
    starts from it instead of re-running the line scan and joins, and the
    short lineage keeps plan analysis cheap."""
    from orderlab.plans.registry import memoized
    return memoized(("groups", sf_dir), lambda: cut_lineage(D.demand_price_groups(lines(spark, sf_dir))))


def train_test(spark, sf_dir):
    g = groups(spark, sf_dir)
    tr = g.filter(F.col("year").isin(*TRAIN))
    te = g.filter(F.col("year").isin(*TEST)).withColumn(
        "lifecycle_year", F.when(F.col("year") == Y1, 1).otherwise(2))
    return tr, te


def baseline_preds(spark, sf_dir):
    """Test groups with the baseline prediction, plus the train sigma."""
    tr, te = train_test(spark, sf_dir)
    pred = FC.baseline_predict(tr, te, KEYS)
    trs = FC.baseline_predict(tr, tr, KEYS)
    sig = FC.residual_sigma(trs).filter(F.col("scope") == "ALL").select("sigma")
    return pred.crossJoin(F.broadcast(sig)), tr, te


def cost_table(spark):
    return CONFIG.cost_table(spark)


def scenarios(spark, sf_dir):
    """M13 scenarios of the test items (both test years)."""
    pred, _, _ = baseline_preds(spark, sf_dir)
    return S.normal_scenarios(pred, ["year", *KEYS], MOQ)


# ---------------------------------------------------------------- SQL side

def forecast_ctes() -> str:
    return f"""tr AS (SELECT * FROM groups WHERE year IN {yrs(TRAIN)}),
    te AS (SELECT *, CASE WHEN year = {Y1} THEN 1 ELSE 2 END AS lifecycle_year FROM groups WHERE year IN {yrs(TEST)}),
    gm AS (SELECT avg(demand) AS g FROM tr),
    bm AS (SELECT {KEYS_SQL}, avg(demand) AS bq FROM tr GROUP BY ALL),
    pr0 AS (SELECT te.*, coalesce(bm.bq, gm.g) AS pred FROM te LEFT JOIN bm USING ({KEYS_SQL}) CROSS JOIN gm),
    trs AS (SELECT tr.*, coalesce(bm.bq, gm.g) AS pred FROM tr LEFT JOIN bm USING ({KEYS_SQL}) CROSS JOIN gm),
    sg AS (SELECT CASE WHEN stddev_pop(demand - pred) = 0 THEN 10.0 ELSE stddev_pop(demand - pred) END AS sigma FROM trs),
    pr AS (SELECT pr0.*, sg.sigma FROM pr0 CROSS JOIN sg),
    ct AS {CONFIG.cost_values_sql()}"""


def _prio_sql(name: str, mode: str) -> str:
    same = ("ct.name = '{n}' AND ct.product_category IS NOT DISTINCT FROM q.product_category").format(n=name)
    if mode == "optimizer":
        s = (f"CASE WHEN {same} AND ct.period IS NOT DISTINCT FROM q.period THEN 1 "
             f"WHEN {same} AND ct.period IS NULL THEN 2 WHEN ct.name = '{name}' THEN 3 ")
        for k, a in enumerate(COST_ALIASES.get(name, [])):
            s += f"WHEN ct.name = '{a}' THEN {4 + k} "
        return s + "END"
    return (f"CASE WHEN {same} AND ct.period IS NOT DISTINCT FROM q.period THEN 1 "
            f"WHEN {same} AND ct.period IS NULL THEN 2 "
            f"WHEN ct.name = '{name}' AND ct.period IS NULL AND ct.product_category IS NULL THEN 3 END")


def resolve_sql(combos: str, mode: str, names=K.COST_NAMES) -> str:
    """SELECT product_category, period, <names> for the combos relation."""
    cols = []
    for n in names:
        p = _prio_sql(n, mode)
        v = f"arg_min(ct.value, ({p}) * 100000 + ct.ord) FILTER (WHERE ({p}) IS NOT NULL)"
        cols.append(f"coalesce({v}, 1.0) AS {n}" if mode == "optimizer" else f"{v} AS {n}")
    return (f"SELECT q.product_category, q.period, {', '.join(cols)} FROM (SELECT DISTINCT product_category, "
            f"CAST(period AS INTEGER) AS period FROM {combos}) q CROSS JOIN ct GROUP BY q.product_category, q.period")


def cost_ctes() -> str:
    """j6 / j7 resolved over the test combos, cr table."""
    return f"""combos AS (SELECT DISTINCT product_category, lifecycle_year AS period FROM te),
    j6 AS ({resolve_sql('combos', 'optimizer')}),
    j7 AS ({resolve_sql('combos', 'strict', ('overage_cost', 'underage_cost'))}),
    crt AS (SELECT product_category, period, overage_cost AS co, underage_cost AS cu,
                   underage_cost / (underage_cost + overage_cost) AS critical_ratio,
                   coalesce(1 + (underage_cost / (underage_cost + overage_cost) - 0.5) * 0.8, 1.0) AS safety_factor,
                   {norm_ppf_sql('underage_cost / (underage_cost + overage_cost)')} AS z_cr FROM j7),
    sc AS (SELECT pr.*, CASE WHEN j7.overage_cost IS NULL OR j7.underage_cost IS NULL THEN 1.0 ELSE j7.overage_cost END AS co,
                  CASE WHEN j7.overage_cost IS NULL OR j7.underage_cost IS NULL THEN 1.0 ELSE j7.underage_cost END AS cu
           FROM pr LEFT JOIN j7 ON pr.product_category IS NOT DISTINCT FROM j7.product_category
                               AND pr.lifecycle_year IS NOT DISTINCT FROM j7.period)"""


def scenario_cte() -> str:
    from orderlab.operators.scenarios import Z_P10_P50_P90
    zs = ", ".join(f"({i}, {z!r})" for i, z in enumerate(Z_P10_P50_P90))
    return f"""scen AS (SELECT year, {KEYS_SQL}, scenario_id,
                    greatest(greatest(pred, {float(MOQ)}) + sigma * z, 0.0) AS demand
             FROM pr CROSS JOIN (VALUES {zs}) AS zt(scenario_id, z))"""


# ---------------------------------------------------------------- Model A items

def model_a_items(spark, sf_dir):
    """Test items (both test years) with J6 costs and their scenario array."""
    pred, _, _ = baseline_preds(spark, sf_dir)
    return items_with_scenarios(spark, pred, S.normal_scenarios(pred, ["year", *KEYS], MOQ))


def items_with_scenarios(spark, pred: DataFrame, scen: DataFrame) -> DataFrame:
    """The items of ``pred`` that have scenarios, with J6 costs and their scenario array."""
    ik = ["year", *KEYS]
    items = pred.select(*ik, "lifecycle_year", "pred").join(S.scenario_arrays(scen, ik), ik)
    items = K.with_costs(items, cost_table(spark), "optimizer")
    # items are reused by every step of an allocation (intervals, MOQ spend, join back)
    return cut_lineage(items.withColumnRenamed("overage_cost", "co").withColumnRenamed("underage_cost", "cu"))


# ---------------------------------------------------------------- the winner of M15

def winner_preds(spark, sf_dir) -> DataFrame:
    """M15 -> M13: test items with the prediction and the sigma of the cheapest candidate."""
    tr, te = train_test(spark, sf_dir)
    test = K.strict_scoring_costs(FC.candidate_forecasts(tr, te, KEYS), cost_table(spark)).withColumn("base", F.col("model"))
    strict = K.resolve_costs(K.item_combos(te), cost_table(spark), "strict", ("overage_cost", "underage_cost"))
    pto = K.pto_adjust(test.where("model <> 'Baseline'"), K.critical_ratio_table(strict, 0.8))
    pto = pto.withColumn("pred", F.col("pred_pto")).withColumn("model", F.concat("base", F.lit("+PTO"))).select(*test.columns)
    sigmas = FC.model_sigma(FC.candidate_forecasts(tr, tr, KEYS))
    return cut_lineage(FC.winner_forecast(test.unionByName(pto), sigmas, MOQ).drop("base", "co", "cu"))


def winner_ctes() -> str:
    """The same in SQL: forecast_ctes and cost_ctes with ``pr`` holding the winner's predictions."""
    base = forecast_ctes().replace("    pr AS (SELECT pr0.*", "    prb AS (SELECT pr0.*")
    trend = "CASE WHEN f.icpt + f.slope * {y}.year IS NULL THEN f.mean ELSE f.icpt + f.slope * {y}.year END"

    def rows(src: str) -> str:
        models = [("Baseline", "f.mean"), ("Trend", trend.format(y=src)), ("Last", "f.last"), ("Median", "f.median")]
        return " UNION ALL ".join(
            f"SELECT {src}.*, '{n}' AS model, greatest(coalesce({c}, gm.g), 0.0) AS pred FROM {src} LEFT JOIN fit f USING ({KEYS_SQL}) "
            f"CROSS JOIN gm" for n, c in models)

    costs = cost_ctes()
    costs = costs[:costs.index("sc AS (")].rstrip().rstrip(",")
    return base + f""",
    {costs},
    fit AS (SELECT {KEYS_SQL}, avg(demand) AS mean, regr_slope(CAST(demand AS DOUBLE), CAST(year AS DOUBLE)) AS slope,
                   regr_intercept(CAST(demand AS DOUBLE), CAST(year AS DOUBLE)) AS icpt, CAST(arg_max(demand, year) AS DOUBLE) AS last,
                   CAST(quantile_cont(CAST(demand AS DOUBLE), 0.5) AS DOUBLE) AS median FROM tr GROUP BY ALL),
    cand0 AS ({rows('te')}),
    cand1 AS (SELECT c.*, c.model AS base, CASE WHEN j.overage_cost IS NULL OR j.underage_cost IS NULL THEN 1.0 ELSE j.overage_cost END AS co,
                     CASE WHEN j.overage_cost IS NULL OR j.underage_cost IS NULL THEN 1.0 ELSE j.underage_cost END AS cu
              FROM cand0 c LEFT JOIN j7 j ON c.product_category IS NOT DISTINCT FROM j.product_category
                                         AND c.lifecycle_year IS NOT DISTINCT FROM j.period),
    cand AS (SELECT * FROM cand1 UNION ALL
             SELECT c.* REPLACE (c.base || '+PTO' AS model, greatest(c.pred * coalesce(t.safety_factor, 1.0), 0.0) AS pred)
             FROM cand1 c LEFT JOIN crt t ON c.product_category IS NOT DISTINCT FROM t.product_category
                                         AND c.lifecycle_year IS NOT DISTINCT FROM t.period WHERE c.base <> 'Baseline'),
    best AS (SELECT model FROM cand WHERE model <> 'Baseline' GROUP BY model
             ORDER BY sum(co * greatest(pred - demand, 0) + cu * greatest(demand - pred, 0)), model LIMIT 1),
    csig AS (SELECT model AS base, CASE WHEN stddev_pop(demand - pred) = 0 THEN 10.0 ELSE stddev_pop(demand - pred) END AS sigma
             FROM ({rows('tr')}) GROUP BY 1),
    pr AS (SELECT c.* EXCLUDE (base, co, cu, pred), greatest(c.pred, {float(MOQ)}) AS pred, s.sigma
           FROM cand c JOIN best USING (model) JOIN csig s USING (base))"""


def season_budgets(items, budget: float | None = None):
    b = CONFIG.budget if budget is None else budget
    return items.select("season").distinct().withColumn("budget", F.lit(float(b)))


IK_SQL = "year, " + KEYS_SQL


def model_a_ctes(budget: float | None = None, sfx: str = "", base: bool = True) -> str:
    """ai (items with costs), scenario intervals (ivr) and, per budget level
    (CTE names suffixed ``sfx``): bud, avail, cut, alloc (q) and prices."""
    moq = float(MOQ)
    b = CONFIG.budget if budget is None else budget
    head = scenario_cte() + f""",
    ai AS (SELECT pr.year, {", ".join("pr." + k for k in KEYS)}, pr.lifecycle_year, pr.pred,
                  j6.unit_cost, j6.overage_cost AS co, j6.underage_cost AS cu
           FROM pr LEFT JOIN j6 ON pr.product_category IS NOT DISTINCT FROM j6.product_category
                              AND pr.lifecycle_year IS NOT DISTINCT FROM j6.period),
    nsc AS (SELECT {IK_SQL}, count(*) AS n FROM scen GROUP BY ALL),
    pts AS (SELECT {IK_SQL}, {moq} AS a FROM ai UNION SELECT {IK_SQL}, demand FROM scen WHERE demand > {moq}),
    iv AS (SELECT *, lead(a) OVER (PARTITION BY {IK_SQL} ORDER BY a) AS b FROM pts),
    ivk AS (SELECT iv.{IK_SQL.replace(', ', ', iv.')}, iv.a, iv.b, count(s.demand) AS k
            FROM iv LEFT JOIN scen s ON s.year = iv.year AND {" AND ".join(f"s.{k} = iv.{k}" for k in KEYS)}
                                    AND s.demand <= iv.a
            WHERE iv.b IS NOT NULL GROUP BY ALL),
    ivr AS (SELECT * FROM (SELECT ivk.*, ai.unit_cost, ai.co, ai.cu, nsc.n, ivk.b - ivk.a AS length,
                   round(-((ai.co * ivk.k - ai.cu * (nsc.n - ivk.k)) / nsc.n) / ai.unit_cost, 10) AS ratio
            FROM ivk JOIN ai USING ({IK_SQL}) JOIN nsc USING ({IK_SQL})) WHERE ratio > 0),
    bk AS (SELECT season, ratio, sum(length * unit_cost) AS spend FROM ivr GROUP BY ALL)"""
    cut = f""",
    bud{sfx} AS (SELECT DISTINCT season, {float(b)!r} AS budget FROM ai),
    avail{sfx} AS (SELECT season, budget, sum(unit_cost * {moq}) AS moq_spend, budget - sum(unit_cost * {moq}) AS avail
              FROM ai JOIN bud{sfx} USING (season) GROUP BY season, budget),
    cutw{sfx} AS (SELECT bk.*, a.avail, sum(spend) OVER (PARTITION BY season ORDER BY ratio DESC
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM bk JOIN avail{sfx} a USING (season)),
    cut{sfx} AS (SELECT season, ratio, spend, CASE WHEN avail < 0 THEN 0.0 WHEN cum <= avail THEN 1.0
                   WHEN cum - spend >= avail THEN 0.0 ELSE (avail - (cum - spend)) / spend END AS frac FROM cutw{sfx}),
    alloc{sfx} AS (SELECT ai.*, {moq} + coalesce(x.extra, 0.0) AS q FROM ai LEFT JOIN
              (SELECT {IK_SQL}, sum(length * frac) AS extra FROM ivr JOIN cut{sfx} USING (season, ratio) GROUP BY ALL) x
              USING ({IK_SQL})),
    prices{sfx} AS (SELECT a.season, a.budget, a.moq_spend, a.avail < 0 AS infeasible,
                      CASE WHEN a.avail < 0 THEN NULL ELSE coalesce(m.sp, 0.0) END AS shadow_price
               FROM avail{sfx} a LEFT JOIN (SELECT season, max(ratio) AS sp FROM cut{sfx} WHERE frac < 1.0 GROUP BY 1) m
               USING (season))"""
    return (head if base else "") + cut


def saa_sql(q: str, src_alias: str = "p") -> str:
    """Exact SAA cost of the plan column ``q`` of ``src_alias`` (joined to scen as s)."""
    return f"avg({src_alias}.co * greatest({q} - s.demand, 0) + {src_alias}.cu * greatest(s.demand - {q}, 0))"


def item_join(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in ["year", *KEYS])


def units_ctes() -> str:
    """Integer runs (runs), their cut (ucut) and the integer plan (ualloc)."""
    moq = float(MOQ)
    key_text = "concat_ws('|', " + ", ".join(f"r.{k}" for k in ["year", *KEYS]) + ")"
    return f""",
    upts AS (SELECT {IK_SQL}, {moq} AS a FROM ai
             UNION SELECT {IK_SQL}, CAST(floor(demand) AS DOUBLE) FROM scen WHERE demand > {moq}
             UNION SELECT {IK_SQL}, CAST(ceil(demand) AS DOUBLE) FROM scen WHERE demand > {moq}),
    uiv AS (SELECT *, lead(a) OVER (PARTITION BY {IK_SQL} ORDER BY a) AS b FROM upts),
    udel AS (SELECT uiv.{IK_SQL.replace(', ', ', uiv.')}, uiv.a, uiv.b,
                    sum(ai.co * (greatest(uiv.a + 1 - s.demand, 0) - greatest(uiv.a - s.demand, 0))
                        + ai.cu * (greatest(s.demand - uiv.a - 1, 0) - greatest(s.demand - uiv.a, 0))) AS dsum,
                    count(*) AS n, any_value(ai.unit_cost) AS unit_cost
             FROM uiv JOIN ai USING ({IK_SQL})
                  JOIN scen s ON s.year = uiv.year AND {" AND ".join(f"s.{k} = uiv.{k}" for k in KEYS)}
             WHERE uiv.b IS NOT NULL GROUP BY ALL),
    runs AS (SELECT * FROM (SELECT *, b - a AS length, round(-(dsum / n) / unit_cost, 10) AS ratio FROM udel)
             WHERE ratio > 0),
    ubk AS (SELECT season, ratio, sum(length * unit_cost) AS spend FROM runs GROUP BY ALL),
    ucutw AS (SELECT ubk.*, avail.avail, sum(spend) OVER (PARTITION BY season ORDER BY ratio DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM ubk JOIN avail USING (season)),
    ucut AS (SELECT season, ratio, CASE WHEN avail < 0 THEN 0.0 WHEN cum <= avail THEN 1.0
                    WHEN cum - spend >= avail THEN 0.0 ELSE (avail - (cum - spend)) / spend END AS frac FROM ucutw),
    ur AS (SELECT runs.*, ucut.frac, CAST(floor(ucut.frac * runs.length + 1e-9) AS DOUBLE) AS units
           FROM runs JOIN ucut USING (season, ratio)),
    uslack AS (SELECT avail.season, avail.avail - coalesce(sp.s, 0.0) AS slack FROM avail
               LEFT JOIN (SELECT season, sum(units * unit_cost) AS s FROM ur GROUP BY 1) sp USING (season)),
    ucand AS (SELECT r.*, md5({key_text}) AS h FROM ur r WHERE frac > 0 AND frac < 1 AND units < length),
    uplus AS (SELECT * FROM (SELECT ucand.*, sum(unit_cost) OVER (PARTITION BY season ORDER BY h, {KEYS_SQL.replace('season, ', '')}, year
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM ucand) c
              JOIN uslack USING (season) WHERE cum <= slack + 1e-9),
    ualloc AS (SELECT ai.*, CAST({moq} + coalesce(x.extra, 0.0) AS BIGINT) AS q FROM ai LEFT JOIN
               (SELECT {IK_SQL}, sum(units + CASE WHEN p.a IS NOT NULL THEN 1 ELSE 0 END) AS extra
                FROM ur LEFT JOIN (SELECT {IK_SQL}, a FROM uplus) p USING ({IK_SQL}, a) GROUP BY ALL) x
               USING ({IK_SQL}))"""
