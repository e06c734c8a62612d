"""Model A (one period): SAA objective, projection, exact budget allocation,
integer plans, shadow prices, what-if runs, diagnostics and policy comparison
(N3-N12, D11, U1, O4, W4).

Items carry their scenarios as a sorted array ``d`` (bounded by the scenario
count).  The SAA cost of an item is convex and piecewise linear in q with kinks
at the scenario values, so the budget-constrained optimum is a fractional
knapsack over kink intervals ranked by benefit per dollar:

1. per item, intervals above MOQ with ratio = -slope / unit_cost (one walk along the
   sorted scenarios on the item row: no shuffle, linear in their number);
2. per budget key and distinct ratio, the spend of all intervals (partial
   aggregation: the table has one row per distinct ratio, not per item);
3. a two-level prefix sum along falling ratios (ranges of ratios, then the one
   range where the budget runs out) finds the cut ratio (= shadow price) and the
   share of the cut bucket that fits; one method at every size;
4. the cut, one row per budget key, is broadcast to the items: intervals above it are
   taken in full, the cut bucket by the same share (ties share equally), the rest not at
   all, so the intervals are never shuffled on a season or a ratio.

A second budget, a cap on units, is priced by bisection around the same cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlab.functions.newsvendor import nv_cost

RATIO_DIGITS = 10
RATIO_STEPS = 512        # ratio ranges per doubling in the first level of the cut's prefix sum
MONEY = "decimal(30,9)"  # exact sums of spend
HASH_PREFIX = 3          # md5 hex prefix length: 4096 first-level buckets for the unit tie-break


def _cols(c: Column | None, name: str) -> Column:
    return F.col(name) if c is None else c


def saa_cost(q: Column, d: Column | None = None, co: Column | None = None, cu: Column | None = None) -> Column:
    """N3 per item: mean over the item's scenarios of co*(q-D)+ + cu*(D-q)+."""
    d, co, cu = _cols(d, "d"), _cols(co, "co"), _cols(cu, "cu")
    tot = F.aggregate(d, F.lit(0.0), lambda acc, x: acc + nv_cost(q, x, co, cu))
    return tot / F.size(d)


def smooth_saa(q: Column, k: float, d: Column | None = None, co: Column | None = None,
               cu: Column | None = None):
    """N4 per item: softplus-smoothed cost and its derivative in q."""
    d, co, cu = _cols(d, "d"), _cols(co, "co"), _cols(cu, "cu")
    from orderlab.functions.newsvendor import sigmoid, softplus
    obj = F.aggregate(d, F.lit(0.0), lambda acc, x: acc + co * softplus(q - x, k) + cu * softplus(x - q, k))
    grad = F.aggregate(d, F.lit(0.0), lambda acc, x: acc + co * sigmoid(q - x, k) - cu * sigmoid(x - q, k))
    return obj / F.size(d), grad / F.size(d)


def expected_mean(d: Column | None = None) -> Column:
    d = _cols(d, "d")
    return F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x) / F.size(d)


def item_key_text(keys) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys])


# ---------------------------------------------------------------- projection

def project_budget(items: DataFrame, q: str, budgets: DataFrame, bkeys, moq: int, clamp: bool = False) -> DataFrame:
    """Q -> max(q, moq), then per budget key scale the part above MOQ so the
    spend fits.  ``infeasible`` marks keys whose MOQ spend alone exceeds the
    budget (the reference raises; ``clamp=True`` sets q = moq there, as B4)."""
    qm = F.greatest(F.col(q), F.lit(float(moq)))
    s = (items.groupBy(*bkeys).agg(F.sum(F.col("unit_cost") * qm).alias("_spend"),
                                   F.sum(F.col("unit_cost") * moq).alias("_min"))
         .join(budgets, bkeys))
    extra = F.col("_spend") - F.col("_min")
    s = s.select(*bkeys, (F.col("_min") > F.col("budget") + 1e-9).alias("infeasible"),
                 F.when(F.col("_spend") <= F.col("budget") + 1e-9, 1.0)
                  .when(extra > 0, F.least(F.greatest(F.col("budget") - F.col("_min"), F.lit(0.0)) / extra, F.lit(1.0)))
                  .otherwise(0.0).alias("_scale"))
    # one row per budget key (seasons, or season x year): a configuration-sized table
    j = items.join(F.broadcast(s), bkeys) if bkeys else items.crossJoin(F.broadcast(s))
    proj = F.lit(float(moq)) + (qm - moq) * F.col("_scale")
    if clamp:
        proj = F.when(F.col("infeasible"), F.lit(float(moq))).otherwise(proj)
    return j.withColumn("q_projected", proj).drop("_scale")


# ---------------------------------------------------------------- intervals

def interval_array(moq: int) -> Column:
    """Kink intervals above MOQ with positive benefit, as array<struct<a, length, benefit,
    ratio>> on the item row: one walk along the sorted scenarios.  Before scenario i, i
    scenarios are met, so the slope needs no count (duplicates give empty intervals)."""
    m, n = F.lit(float(moq)), F.size("d")

    def interval(i):
        a = F.greatest(m, F.coalesce(F.get(F.col("d"), i - 1), m))
        benefit = -(F.col("co") * i - F.col("cu") * (n - i)) / n
        return F.struct(a.alias("a"), (F.get(F.col("d"), i) - a).alias("length"), F.round(benefit, RATIO_DIGITS).alias("benefit"),
                        F.round(benefit / F.col("unit_cost"), RATIO_DIGITS).alias("ratio"))

    places = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    return F.filter(F.transform(places, interval), lambda x: (x["length"] > 0) & (x["ratio"] > 0))


def continuous_intervals(items: DataFrame, moq: int) -> DataFrame:
    """Kink intervals above MOQ with positive benefit per dollar (one row each)."""
    return (items.withColumn("_iv", F.explode(interval_array(moq)))
            .select("*", "_iv.a", "_iv.length", "_iv.ratio").drop("_iv"))


def unit_runs(items: DataFrame, moq: int) -> DataFrame:
    """Integer runs above MOQ: consecutive integer kinks (MOQ, floor and ceil of
    each scenario) bound runs whose unit steps all have the same marginal cost."""
    m = F.lit(float(moq))
    ints = F.flatten(F.transform(F.filter("d", lambda x: x > m),
                                 lambda x: F.array(F.floor(x).cast("double"), F.ceil(x).cast("double"))))
    pts = F.array_sort(F.array_distinct(F.concat(F.array(m), ints)))
    iv = items.withColumn("_pts", pts).withColumn(
        "_iv", F.explode(F.filter(F.sequence(F.lit(0), F.size("_pts") - 1), lambda i: i < F.size("_pts") - 1)))
    u, v = F.get(F.col("_pts"), F.col("_iv")), F.get(F.col("_pts"), F.col("_iv") + 1)
    co, cu = F.col("co"), F.col("cu")
    # marginal cost of the unit step [u, u+1]
    delta = F.aggregate("d", F.lit(0.0), lambda acc, x: acc
                        + co * (F.greatest(u + 1 - x, F.lit(0.0)) - F.greatest(u - x, F.lit(0.0)))
                        + cu * (F.greatest(x - u - 1, F.lit(0.0)) - F.greatest(x - u, F.lit(0.0)))) / F.size("d")
    return (iv.select("*", u.alias("a"), (v - u).alias("length"),
                      F.round(-delta / F.col("unit_cost"), RATIO_DIGITS).alias("ratio"))
            .filter(F.col("ratio") > 0).drop("_pts", "_iv"))


# ---------------------------------------------------------------- the cut

def _available(items: DataFrame, budgets: DataFrame, bkeys, moq: int) -> DataFrame:
    ms = items.groupBy(*bkeys).agg(F.sum(F.col("unit_cost") * moq).alias("moq_spend"))
    return _key_join(budgets, ms, bkeys).withColumn("avail", F.col("budget") - F.col("moq_spend"))


def _key_join(left: DataFrame, right: DataFrame, bkeys, how: str = "inner") -> DataFrame:
    """Null-safe join on the budget keys; ``right`` has one row per key (a
    configuration-sized table), so it is broadcast."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in bkeys], *[c for c in right.columns if c not in bkeys])
    if not bkeys:
        return left.crossJoin(F.broadcast(named))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in bkeys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(F.broadcast(named), cond, how).drop(*[f"_r_{k}" for k in bkeys])


def cut_per_key(iv: DataFrame, avail: DataFrame, bkeys) -> DataFrame:
    """The cut of each budget key: (bkeys, cut_ratio, cut_share).

    Spend is summed per distinct ratio, then along falling ratios by a two-level
    prefix sum: over ``RATIO_STEPS`` ratio ranges per doubling (a bounded table), and
    inside each range.  The cut is the highest ratio whose bucket does not fit whole
    (null: all fits), with the share of it that fits.  Spend is summed as decimals, so
    both levels agree to the last digit in whatever order rows arrive, and a budget equal
    to the spend of whole buckets still finds its cut."""
    spend = F.sum((F.col("length") * F.col("unit_cost")).cast("decimal(28,9)")).cast(MONEY)
    buckets = (iv.groupBy(*bkeys, "ratio").agg(spend.alias("spend"))
               .withColumn("_range", F.floor(F.log2("ratio") * RATIO_STEPS)))
    avail = avail.select(*bkeys, F.col("avail").cast(MONEY).alias("avail"))
    w1 = Window.partitionBy(*bkeys).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = (buckets.groupBy(*bkeys, "_range").agg(F.sum("spend").cast(MONEY).alias("_rs"))
              .withColumn("_above", F.coalesce(F.sum("_rs").over(w1).cast(MONEY), F.lit(0).cast(MONEY))))
    # a range matters only where the budget runs out inside it
    ranges = _key_join(ranges, avail, bkeys).where(F.col("_above") + F.col("_rs") > F.col("avail"))
    first = ranges.groupBy(*bkeys).agg(F.max(F.struct("_range", "_above", "avail")).alias("_c")).select(
        *bkeys, F.col("_c._range").alias("_cut_range"), F.col("_c._above").alias("_above"), F.col("_c.avail").alias("avail"))
    w2 = Window.partitionBy(*bkeys).orderBy(F.col("ratio").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = (_key_join(buckets, first, bkeys).where(F.col("_range") == F.col("_cut_range"))
              .withColumn("_cum", F.col("_above") + F.sum("spend").over(w2).cast(MONEY)))
    room = (F.col("avail") - (F.col("_cum") - F.col("spend"))).cast("double")
    share = F.greatest(F.lit(0.0), room / F.col("spend").cast("double"))
    return (inside.where(F.col("_cum") > F.col("avail"))
            .groupBy(*bkeys).agg(F.max(F.struct("ratio", share.alias("share"))).alias("_c"))
            .select(*bkeys, F.col("_c.ratio").alias("cut_ratio"), F.col("_c.share").alias("cut_share")))


def _share(ratio: Column) -> Column:
    """Share taken of an interval: whole above the cut, the cut's share at it."""
    return (F.when(F.col("cut_ratio").isNull() | (ratio > F.col("cut_ratio")), 1.0)
            .when(ratio == F.col("cut_ratio"), F.col("cut_share")).otherwise(0.0))


def with_fraction(iv: DataFrame, cut: DataFrame, bkeys) -> DataFrame:
    """Intervals with the fraction taken: whole above the cut, its share at it."""
    return (_key_join(iv, cut, bkeys, "left").withColumn("frac", _share(F.col("ratio")))
            .drop("cut_ratio", "cut_share"))


def shadow_prices(cut: DataFrame, avail: DataFrame, bkeys) -> DataFrame:
    """Per budget key, the benefit per extra dollar: the cut ratio (0 when the
    budget does not bind)."""
    return (_key_join(avail, cut, bkeys, "left")
            .select(*bkeys, "budget", "moq_spend", (F.col("avail") < 0).alias("infeasible"),
                    F.when(F.col("avail") < 0, None).otherwise(F.coalesce(F.col("cut_ratio"), F.lit(0.0)))
                    .alias("shadow_price")))


def allocate(items: DataFrame, budgets: DataFrame, bkeys, moq: int, keys):
    """Continuous SAA-optimal quantities under the budgets.

    Returns (plan, prices): plan = items + ``q``; prices = per budget key the
    shadow price (N11)."""
    avail = _available(items, budgets, bkeys, moq)
    cut = cut_per_key(continuous_intervals(items, moq), avail, bkeys)
    # the cut, one row per budget key, comes to the items: their intervals stay on the row
    extra = F.aggregate(F.col("_iv"), F.lit(0.0), lambda acc, x: acc + x["length"] * _share(x["ratio"]))
    plan = (_key_join(items.withColumn("_iv", interval_array(moq)), cut, bkeys, "left")
            .withColumn("q", F.lit(float(moq)) + extra).drop("_iv", "cut_ratio", "cut_share"))
    return plan, shadow_prices(cut, avail, bkeys)


# ---------------------------------------------------------------- two budgets

def _small(df: DataFrame) -> DataFrame:
    """One row per budget key (a configuration-sized table) held by the driver between rounds."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _units_at(steps: DataFrame, prices: DataFrame, bkeys) -> DataFrame:
    """``prices`` (bkeys, _id, _mu, avail) with the units bought under the money budget when
    every unit costs ``_mu`` of its benefit."""
    k = [*bkeys, "_id"]
    s = (_key_join(steps, prices.select(*bkeys, "_id", "_mu"), bkeys)
         .withColumn("ratio", F.round((F.col("benefit") - F.col("_mu")) / F.col("unit_cost"), RATIO_DIGITS)).where("ratio > 0"))
    used = (with_fraction(s, cut_per_key(s, prices.select(*k, "avail"), k), k)
            .groupBy(*k).agg(F.sum(F.col("length") * F.col("frac")).alias("_used")))
    return _key_join(prices, used, k, "left").withColumn("_used", F.coalesce("_used", F.lit(0.0)))


def allocate_capped(items: DataFrame, budgets: DataFrame, bkeys, moq: int, tol: float = 1e-9, sections: int = 32):
    """Continuous quantities under a money budget and a cap on units, per budget key
    (``budgets``: bkeys, budget, unit_cap).

    A price ``mu`` per unit is taken off every benefit; under it the money budget alone is
    the cut of N6.  Units fall as ``mu`` rises, so the smallest price that keeps the cap is
    bracketed: ``sections`` prices of all keys are tried in one job, until the bracket is
    under ``tol`` of the largest benefit.  The plans at both ends of the bracket keep the
    money budget; their mixture that meets the cap exactly costs at most
    (bracket width) x (units) more than the optimum.  Returns (plan, prices) with the
    benefit per extra dollar and per extra unit (0 where a budget does not bind)."""
    from orderlab.session import cut_lineage
    x = cut_lineage(items.withColumn("_iv", interval_array(moq)))
    each = x.select(*bkeys, "unit_cost", F.explode("_iv").alias("_s"))
    steps = cut_lineage(each.groupBy(*bkeys, "unit_cost", F.col("_s.benefit").alias("benefit")).agg(
        F.sum("_s.length").alias("length")))
    least = x.groupBy(*bkeys).agg(F.sum(F.col("unit_cost") * moq).alias("moq_spend"), F.count(F.lit(1)).alias("_n"))
    top = steps.groupBy(*bkeys).agg(F.max("benefit").alias("_top"))
    keys = _key_join(_key_join(budgets, least, bkeys), top, bkeys, "left").select(
        *bkeys, "budget", "unit_cap", "moq_spend", (F.col("budget") - F.col("moq_spend")).alias("avail"),
        (F.col("unit_cap") - moq * F.col("_n")).alias("_room"), F.coalesce("_top", F.lit(0.0)).alias("_top"))
    # low: a price under which too many units are bought, high: one that keeps the cap (both 0: none is needed)
    at = keys.withColumn("_id", F.lit(0)).withColumn("_mu", F.lit(0.0))
    free = _units_at(steps, at, bkeys).withColumn("_fits", F.col("_used") <= F.col("_room"))
    state = _small(free.select(*keys.columns, F.lit(0.0).alias("_low"),
                               F.when(F.col("_fits"), 0.0).otherwise(F.col("_top")).alias("_high")))
    width = (F.col("_high") - F.col("_low")) > tol * F.greatest(F.col("_top"), F.lit(1e-300))
    while not state.where(width).isEmpty():
        grid = F.explode(F.sequence(F.lit(1), F.lit(sections - 1))).alias("_id")
        at = state.select("*", grid).withColumn("_mu", F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_id") / sections)
        fits = F.col("_used") <= F.col("_room")
        found = _units_at(steps, at, bkeys).groupBy(*bkeys).agg(
            F.max(F.when(~fits, F.col("_mu"))).alias("_l"), F.min(F.when(fits, F.col("_mu"))).alias("_h"))
        state = _small(_key_join(state, found, bkeys).withColumn("_low", F.coalesce("_l", "_low"))
                       .withColumn("_high", F.coalesce("_h", "_high")).drop("_l", "_h"))
    ends = state.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_id")).withColumn(
        "_mu", F.when(F.col("_id") == 0, F.col("_low")).otherwise(F.col("_high")))
    k = [*bkeys, "_id"]
    used = _units_at(steps, ends, bkeys)
    s = (_key_join(steps, ends.select(*bkeys, "_id", "_mu"), bkeys)
         .withColumn("ratio", F.round((F.col("benefit") - F.col("_mu")) / F.col("unit_cost"), RATIO_DIGITS)).where("ratio > 0"))
    cut = _key_join(used, cut_per_key(s, ends.select(*k, "avail"), k), k, "left")
    both = cut.groupBy(*bkeys).agg(
        *[F.max(F.when(F.col("_id") == i, F.col(c))).alias(f"{c}{i}") for i in (0, 1)
          for c in ("_mu", "_used", "cut_ratio", "cut_share")], F.first("_room").alias("_room"), F.first("avail").alias("avail"))
    # share of the plan at the low price, so that the mixture uses the whole cap
    mix = F.when((F.col("_used0") > F.col("_room")) & (F.col("_used0") > F.col("_used1")),
                 F.greatest((F.col("_room") - F.col("_used1")) / (F.col("_used0") - F.col("_used1")), F.lit(0.0))).otherwise(0.0)
    both = _small(both.withColumn("_mix", mix).withColumn("_ok", (F.col("_room") >= 0) & (F.col("avail") >= 0)))

    def extra(i):
        r = lambda x: F.round((x["benefit"] - F.col(f"_mu{i}")) / F.col("unit_cost"), RATIO_DIGITS)
        part = lambda x: (F.when(r(x) <= 0, 0.0).when(F.col(f"cut_ratio{i}").isNull() | (r(x) > F.col(f"cut_ratio{i}")), 1.0)
                          .when(r(x) == F.col(f"cut_ratio{i}"), F.col(f"cut_share{i}")).otherwise(0.0))
        return F.aggregate(F.col("_iv"), F.lit(0.0), lambda acc, x: acc + x["length"] * part(x))

    q = F.lit(float(moq)) + F.when(F.col("_ok"), F.col("_mix") * extra(0) + (1 - F.col("_mix")) * extra(1)).otherwise(0.0)
    plan = _key_join(x, both, bkeys).withColumn("q", q).select(*items.columns, "q")
    prices = _key_join(state, both.drop("avail", "_room"), bkeys).select(
        *bkeys, "budget", "unit_cap", "moq_spend", (~F.col("_ok")).alias("infeasible"),
        F.when(F.col("_ok"), F.coalesce("cut_ratio1", F.lit(0.0))).alias("money_price"),
        F.when(F.col("_ok"), F.col("_mu1")).alias("unit_price"))
    return plan, prices


def allocate_units(items: DataFrame, budgets: DataFrame, bkeys, moq: int, keys) -> DataFrame:
    """Integer quantities.  Whole runs above the cut; in the cut bucket each
    run takes floor(share * length) units; the leftover budget then buys one
    more unit per run of the cut bucket in md5(item key) order until the next
    unit no longer fits.  The order is found with a two-level prefix sum
    (md5-prefix buckets, then rows inside the one crossing bucket), so no task
    ever ranks all items of a season."""
    runs = unit_runs(items, moq)
    avail = _available(items, budgets, bkeys, moq)
    r = with_fraction(runs, cut_per_key(runs, avail, bkeys), bkeys)
    r = r.withColumn("units", F.floor(F.col("frac") * F.col("length") + 1e-9).cast("double"))
    spent = r.groupBy(*bkeys).agg(F.sum(F.col("units") * F.col("unit_cost")).alias("_spent"))
    slack = _key_join(avail, spent, bkeys, "left").select(
        *bkeys, (F.col("avail") - F.coalesce("_spent", F.lit(0.0))).alias("slack"))
    # candidates for one more unit: runs of the cut bucket with room left
    cand = (r.filter((F.col("frac") > 0) & (F.col("frac") < 1) & (F.col("units") < F.col("length")))
            .withColumn("_h", F.md5(item_key_text(keys)))
            .withColumn("_hb", F.substring("_h", 1, HASH_PREFIX)))
    hb = cand.groupBy(*bkeys, "_hb").agg(F.sum("unit_cost").alias("_hs"))
    w1 = Window.partitionBy(*bkeys).orderBy("_hb").rowsBetween(Window.unboundedPreceding, 0)
    hb = hb.withColumn("_hcum", F.sum("_hs").over(w1)).withColumn("_hbefore", F.col("_hcum") - F.col("_hs"))
    w2 = Window.partitionBy(*bkeys, "_hb").orderBy("_h", *keys).rowsBetween(Window.unboundedPreceding, 0)
    hb = hb.select(*[F.col(k).alias(f"_h_{k}") for k in bkeys], F.col("_hb").alias("_p"), "_hbefore")
    same = F.col("_hb") == F.col("_p")
    for k in bkeys:
        same = same & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    plus = (_key_join(cand.join(hb, same), slack, bkeys)
            .filter(F.col("_hbefore") < F.col("slack"))
            .withColumn("_cum", F.col("_hbefore") + F.sum("unit_cost").over(w2))
            .filter(F.col("_cum") <= F.col("slack") + 1e-9)
            .select(*keys, "a", F.lit(1.0).alias("_plus")))
    r = r.join(plus, [*keys, "a"], "left").withColumn("units", F.col("units") + F.coalesce("_plus", F.lit(0.0)))
    taken = r.groupBy(*keys).agg(F.sum("units").alias("_extra"))
    return (items.join(taken, keys, "left")
            .withColumn("q", (F.lit(float(moq)) + F.coalesce(F.col("_extra"), F.lit(0.0))).cast("long"))
            .drop("_extra"))


# ---------------------------------------------------------------- evaluation of plans

def budget_diagnostics(plan: DataFrame, q: str, budgets: DataFrame, bkeys, tol: float = 1e-6) -> DataFrame:
    """Spend and violation per budget key, plus max violation and feasibility."""
    s = (plan.groupBy(*bkeys).agg(F.sum(F.col("unit_cost") * F.col(q)).alias("spend"))
         .join(budgets, bkeys)
         .withColumn("violation", F.greatest(F.col("spend") - F.col("budget"), F.lit(0.0))))
    mx = s.agg(F.max("violation").alias("max_violation"))
    return s.crossJoin(F.broadcast(mx)).withColumn("feasible", F.col("max_violation") <= tol)


def order_plan(plan: DataFrame, q: str, keys) -> DataFrame:
    """N9 (+Q8): plan columns at the mean scenario, plus the true SAA expectations."""
    mean = expected_mean()
    qq = F.col(q).cast("double")
    over_m, under_m = F.greatest(qq - mean, F.lit(0.0)), F.greatest(mean - qq, F.lit(0.0))
    return plan.select(
        *keys, F.col(q).cast("long").alias("recommended_order_qty"),
        (F.col(q).cast("long") * F.col("unit_cost")).alias("procurement_spend"),
        mean.alias("expected_demand_saa"), over_m.alias("expected_overage_units"),
        under_m.alias("expected_underage_units"),
        (F.col("co") * over_m + F.col("cu") * under_m).alias("expected_nv_cost"),
        saa_cost(qq).alias("saa_expected_cost"))


def plan_objective(plan: DataFrame, q: str) -> Column:
    return F.sum(saa_cost(F.col(q).cast("double")))


def policy_summary(long_plans: DataFrame, budgets: DataFrame, bkeys, tol: float = 1e-6) -> DataFrame:
    """N10 + O4: one row per policy: exact SAA objective, spend, max violation,
    feasibility, and the rank (feasible first, then objective)."""
    per = (long_plans.groupBy("policy", *bkeys)
           .agg(F.sum(saa_cost(F.col("q").cast("double"))).alias("_obj"),
                F.sum(F.col("unit_cost") * F.col("q")).alias("_spend"))
           .join(F.broadcast(budgets), bkeys)
           .withColumn("_viol", F.greatest(F.col("_spend") - F.col("budget"), F.lit(0.0))))
    s = per.groupBy("policy").agg(F.sum("_obj").alias("objective_value"), F.sum("_spend").alias("total_spend"),
                                  F.max("_viol").alias("max_budget_violation"))
    s = s.withColumn("feasible", F.col("max_budget_violation") <= tol)
    w = Window.orderBy(F.col("feasible").desc(), F.col("objective_value").asc(), F.col("policy"))
    return s.withColumn("rank", F.row_number().over(w))  # one row per policy: a handful
