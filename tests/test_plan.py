"""Model A allocation against brute force on small random instances."""

import itertools
import random

from pyspark.sql import functions as F

from orderlab.operators import plan as PL

MOQ = 2


def cost(q, d, co, cu):
    return sum(co * max(q - x, 0) + cu * max(x - q, 0) for x in d) / len(d)


def instance(seed):
    rnd = random.Random(seed)
    items = []
    for i in range(3):
        d = sorted(round(rnd.uniform(0, 12), 1) for _ in range(3))
        items.append((f"i{i}", "fall", float(rnd.choice([1, 2, 3])), float(rnd.choice([1, 2, 5])),
                      float(rnd.choice([3, 6, 12])), d))
    budget = float(rnd.choice([15, 25, 40, 200]))
    return items, budget


def frames(spark, items, budget):
    it = spark.createDataFrame(items, "item string, season string, unit_cost double, co double, cu double, d array<double>")
    bud = spark.createDataFrame([("fall", budget)], "season string, budget double")
    return it, bud


def brute_int(items, budget):
    best = None
    rng = [range(MOQ, 15)] * len(items)
    for qs in itertools.product(*rng):
        if sum(q * it[2] for q, it in zip(qs, items)) > budget + 1e-9:
            continue
        v = sum(cost(q, it[5], it[3], it[4]) for q, it in zip(qs, items))
        best = v if best is None or v < best else best
    return best


def test_allocation_vs_brute_force(spark):
    for seed in range(6):
        items, budget = instance(seed)
        it, bud = frames(spark, items, budget)
        plan, prices = PL.allocate(it, bud, ["season"], MOQ, ["item"])
        rows = {r.item: r.q for r in plan.collect()}
        spend = sum(rows[i[0]] * i[2] for i in items)
        assert spend <= budget + 1e-6
        cont = sum(cost(rows[i[0]], i[5], i[3], i[4]) for i in items)
        units = {r.item: r.q for r in PL.allocate_units(it, bud, ["season"], MOQ, ["item"]).collect()}
        assert all(float(q).is_integer() and q >= MOQ for q in units.values())
        uspend = sum(units[i[0]] * i[2] for i in items)
        assert uspend <= budget + 1e-6
        uobj = sum(cost(units[i[0]], i[5], i[3], i[4]) for i in items)
        opt = brute_int(items, budget)
        # continuous optimum is a lower bound of the integer optimum; the unit plan is feasible
        assert cont <= opt + 1e-6 and uobj >= opt - 1e-6
        # greedy by benefit per dollar: within one unit of marginal cost per item of the optimum
        assert uobj <= opt + sum(max(i[3], i[4]) for i in items) + 1e-6


def test_shadow_price_matches_finite_difference(spark):
    items, budget = instance(3)
    it, bud = frames(spark, items, 20.0)
    _, p0 = PL.allocate(it, bud, ["season"], MOQ, ["item"])
    lam = p0.first().shadow_price
    plans = {}
    for b in (20.0, 20.5):
        plan, _ = PL.allocate(it, bud.withColumn("budget", F.lit(b)), ["season"], MOQ, ["item"])
        plans[b] = sum(cost(r.q, r.d, r.co, r.cu) for r in plan.collect())
    assert abs((plans[20.0] - plans[20.5]) / 0.5 - lam) < 1e-6


def test_projection_and_infeasible(spark):
    items = [("a", "fall", 2.0, 1.0, 3.0, [10.0]), ("b", "fall", 1.0, 1.0, 3.0, [10.0])]
    it, bud = frames(spark, items, 12.0)
    x = PL.project_budget(it.withColumn("q0", F.lit(10.0)), "q0", bud, ["season"], MOQ).collect()
    assert abs(sum(r.q_projected * r.unit_cost for r in x) - 12.0) < 1e-9
    it, bud = frames(spark, items, 3.0)
    x = PL.project_budget(it.withColumn("q0", F.lit(10.0)), "q0", bud, ["season"], MOQ).collect()
    assert all(r.infeasible for r in x)


def test_cut_with_many_distinct_ratios_levels_and_null_keys(spark):
    """Item-specific costs (a ratio per interval), levels of very different size and a
    null level agree with a sort of all intervals."""
    n = 100_000
    it = spark.range(n).select(
        F.concat(F.lit("i"), F.col("id")).alias("item"), (1 + F.pmod(F.xxhash64("id"), F.lit(9973)) / 1000).alias("unit_cost"),
        F.lit(1.0).alias("co"), (2 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9941)) / 500).alias("cu"),
        F.array(F.lit(5.0), 8.0 + F.pmod(F.col("id"), F.lit(5)).cast("double")).alias("d"))
    levels = [(2e4, 2e6), (2e7, 4e6), (None, 3e6)]
    bud = spark.createDataFrame(levels, "level double, budget double")
    itl = it.crossJoin(bud.select("level"))
    plan, prices = PL.allocate(itl, bud, ["level"], MOQ, ["level", "item"])
    got = {r.level: r.shadow_price for r in prices.collect()}
    assert set(got) == {2e4, 2e7, None}
    iv = PL.continuous_intervals(it, MOQ).select("ratio", (F.col("length") * F.col("unit_cost")).alias("spend")).toPandas()
    base = it.agg(F.sum(F.col("unit_cost") * MOQ)).first()[0]
    iv = iv.sort_values("ratio", ascending=False)
    cum = iv.spend.cumsum().to_numpy()
    for level, budget in levels:
        over = (cum > budget - base).nonzero()[0]
        want = 0.0 if not len(over) else float(iv.ratio.iloc[over[0]])
        assert abs(got[level] - want) < 1e-9


def test_nv_loss_model_learns(spark):
    from orderlab.operators import forecast as FC
    rnd = random.Random(5)
    rows = [(float(x), 20.0 + 60.0 * x + rnd.uniform(-5, 5), 2.0, 6.0) for x in [rnd.random() for _ in range(200)]]
    df = spark.createDataFrame(rows, "f double, demand double, co double, cu double")
    seen = []
    b, hi = FC.nv_loss_fit(df, ["f"], epochs=60, history=seen)
    assert seen[-1] < seen[0]
    out = FC.nv_loss_predict(df, ["f"], b, hi).collect()
    assert len({round(r.pred, 6) for r in out}) > 100
    mean = sum(r.demand for r in out) / len(out)
    loss = lambda q, d: 2 * max(q - d, 0) + 6 * max(d - q, 0)
    assert sum(loss(r.pred, r.demand) for r in out) < sum(loss(mean, r.demand) for r in out)


def test_budgets_equal_to_whole_buckets_are_kept(spark):
    """A budget that is the spend of the best buckets, added in any order, buys those and no more."""
    rnd = random.Random(9)
    items, budgets = [], []
    for key in range(200):
        spend = []
        for i in range(12):
            c, cu = rnd.uniform(0.1, 3), 2.0 + i * rnd.uniform(0.001, 0.01)
            d = [float(MOQ) + rnd.uniform(0.1, 9)]
            items.append((f"k{key}", f"i{i}", c, 1.0, cu, d))
            spend.append((round(cu / c, 10), (d[0] - MOQ) * c, c * MOQ))
        spend.sort(reverse=True)
        whole = rnd.randint(1, 11)
        budgets.append((f"k{key}", sum(x[2] for x in spend) + sum(x[1] for x in rnd.sample(spend[:whole], whole))))
    it = spark.createDataFrame(items, "season string, item string, unit_cost double, co double, cu double, d array<double>")
    bud = spark.createDataFrame(budgets, "season string, budget double")
    plan, prices = PL.allocate(it, bud, ["season"], MOQ, ["season", "item"])
    over = plan.groupBy("season").agg(F.sum(F.col("unit_cost") * F.col("q")).alias("spend")).join(bud, "season")
    assert over.where("spend > budget + 1e-6").count() == 0
    assert over.where("spend < budget - 1e-6").count() == 0
    assert prices.where("shadow_price <= 0").count() == 0


def test_many_scenarios_per_item(spark):
    """300 scenarios a row (with duplicates) equal a direct evaluation of every kink."""
    rnd = random.Random(4)
    rows = []
    for i in range(20):
        d = sorted(float(rnd.randint(0, 80)) if rnd.random() < 0.5 else rnd.uniform(0, 80) for _ in range(300))
        rows.append((f"i{i}", 2.0, 1.5, 4.0, d))
    it = spark.createDataFrame(rows, "item string, unit_cost double, co double, cu double, d array<double>")
    got = {}
    for r in PL.continuous_intervals(it, MOQ).collect():
        got.setdefault(r.item, []).append((r.a, round(r.length, 9), r.ratio))
    for item, c, co, cu, d in rows:
        pts = sorted({float(MOQ), *[x for x in d if x > MOQ]})
        want = []
        for a, b in zip(pts, pts[1:]):  # noqa: B905
            k = sum(x <= a for x in d)
            ratio = round((cu * (300 - k) - co * k) / 300 / c, 10)
            if ratio > 0:
                want.append((a, round(b - a, 9), ratio))
        assert len(want) == len(got[item])
        assert all(abs(x - y) < 1e-8 for g, w in zip(sorted(got[item]), want, strict=True) for x, y in zip(g, w, strict=True))


def test_money_and_unit_caps_together(spark):
    """Both budgets are kept, and the cost is the optimum of the linear program (its dual
    bound at the reported prices)."""
    rnd = random.Random(21)
    items, budgets, base = [], [], {}
    for key in range(30):
        mine = [(f"k{key}", f"i{i}", rnd.choice([1.0, 2.0, 5.0, rnd.uniform(1, 6)]), rnd.uniform(0.5, 2), rnd.uniform(2, 9),
                 sorted(rnd.uniform(0, 20) for _ in range(4))) for i in range(6)]
        items += mine
        money = sum(x[2] * MOQ for x in mine)
        budgets.append((f"k{key}", money + rnd.uniform(5, 200), 6 * MOQ + rnd.uniform(2, 70)))
        base[f"k{key}"] = mine
    budgets[0] = ("k0", budgets[0][1], 1e6)          # only the money binds
    budgets[1] = ("k1", 1e6, budgets[1][2])          # only the units bind
    budgets[2] = ("k2", 1e6, 1e6)                    # neither
    budgets[3] = ("k3", 1.0, 50.0)                   # not even the MOQ
    it = spark.createDataFrame(items, "season string, item string, unit_cost double, co double, cu double, d array<double>")
    bud = spark.createDataFrame(budgets, "season string, budget double, unit_cap double")
    plan, prices = PL.allocate_capped(it, bud, ["season"], MOQ)
    rows, price = plan.collect(), {r.season: r for r in prices.collect()}
    assert len(rows) == len(items) and price["k3"].infeasible
    assert price["k0"].unit_price == 0 and price["k1"].money_price == 0
    assert price["k2"].unit_price == 0 and price["k2"].money_price == 0
    two = 0
    for key, money, cap in budgets:
        if key == "k3":
            continue
        mine = [r for r in rows if r.season == key]
        assert sum(r.q * r.unit_cost for r in mine) <= money + 1e-6 and sum(r.q for r in mine) <= cap + 1e-6
        value = sum(cost(r.q, r.d, r.co, r.cu) for r in mine)
        lam, mu = price[key].money_price, price[key].unit_price
        two += lam > 0 and mu > 0
        bound = -lam * money - mu * cap + sum(
            min(cost(q, d, co, cu) + (lam * c + mu) * q for q in [MOQ, *[x for x in d if x > MOQ]])
            for _, _, c, co, cu, d in base[key])
        assert bound - 1e-6 <= value <= bound + 1e-4
    assert two > 3
