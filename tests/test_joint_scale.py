"""Model B with many scenarios and item-specific costs: corners against all candidates,
prices to a tolerance, the shadow price between its bounds, repair against a plain loop."""

import hashlib
import math
import random

import numpy as np
import pytest

from orderlab.operators import joint as J
from tests.test_joint import SCHEMA, jcost


def brute_best(d1, d2, cu1, co2, cu2, moq, p1, p2):
    A = {moq, *[a for a in d1 if a >= moq]}
    B = {moq, *[b for b in d2 if b >= moq]}
    S = {a + b for a, b in zip(d1, d2)}
    pts = {(a, b) for a in A for b in B} | {(a, s - a) for a in A for s in S} | {(s - b, b) for b in B for s in S}
    return min(jcost(x, y, d1, d2, cu1, co2, cu2) + p1 * x + p2 * y for x, y in pts if x >= moq and y >= moq)


def test_corners_hold_the_best_choice():
    rnd = random.Random(5)
    for _ in range(120):
        n = rnd.choice([1, 2, 5, 9])
        d1 = [float(rnd.randint(0, 30)) if rnd.random() < 0.5 else round(rnd.uniform(0, 30), 2) for _ in range(n)]
        d2 = [float(rnd.randint(0, 30)) for _ in range(n)]
        cu1, co2, cu2 = (float(rnd.choice([0, 3, 12, 60])) for _ in range(3))
        q1, q2, cost = J._corner_points(d1, d2, cu1, co2, cu2, 6.0)
        for x, y, c in zip(q1, q2, cost):
            assert x >= 6 and y >= 6
            assert c == pytest.approx(jcost(x, y, d1, d2, cu1, co2, cu2), abs=1e-6)
        for p1, p2 in [(0, 0), (2.5, 0), (0, 7), (4, 9), (30, 30)]:
            got = (cost + p1 * q1 + p2 * q2).min()
            assert got == pytest.approx(brute_best(d1, d2, cu1, co2, cu2, 6.0, p1, p2), abs=1e-6)


def _items(spark, n_items, n_scen, seed):
    rnd = np.random.default_rng(seed)
    rows = [(f"i{i}", s, 12.0, 15.0, 60.0, float(np.round(rnd.uniform(5, 30), 4)),
             [float(x) for x in rnd.uniform(0, 60, n_scen)], [float(x) for x in rnd.uniform(0, 60, n_scen)])
            for i in range(n_items) for s in ("fall", "winter")]
    return spark.createDataFrame(rows, SCHEMA), rows


def _budgets(spark, rows, moq, x1, x2):
    base = {s: moq * sum(r[5] for r in rows if r[1] == s) for s in ("fall", "winter")}
    return spark.createDataFrame([(s, v * x1, v * x2) for s, v in base.items()],
                                 "season string, budget1 double, budget2 double")


def test_hundred_scenarios_to_a_tolerance(spark):
    it, rows = _items(spark, 30, 100, 1)
    bud = _budgets(spark, rows, 6, 3.0, 2.0)
    plan, duals = J.joint_orders(it, bud, "season", 6)
    d = {r.season: r for r in duals.collect()}
    sp = {r.season: r for r in J.joint_spend(plan, bud, "season").collect()}
    got = {}
    for r in plan.collect():
        got[r.season] = got.get(r.season, 0.0) + jcost(r.q1, r.q2, r.d1, r.d2, r.cu1, r.co2, r.cu2)
    for s in d:
        assert d[s].gap <= 1e-6 * max(1.0, abs(d[s].dual_bound))
        assert sp[s].max_violation <= 1e-6
        assert d[s].l1 > 0 and d[s].l2 > 0
        # a plan that meets the budgets costs at least the bound, and here not much more
        assert d[s].dual_bound - 1e-6 <= got[s] <= d[s].dual_bound * 1.02


def test_shadow_price_between_its_bounds(spark):
    it, rows = _items(spark, 20, 4, 2)
    bud = _budgets(spark, rows, 6, 2.0, 2.5)
    more = bud.withColumn("budget1", bud.budget1 + 50.0)
    a, b = J.joint_orders(it, bud, "season", 6), J.joint_orders(it, more, "season", 6)
    rows = J.shadow_price(*a, *b, "season", 50.0).collect()
    assert len(rows) == 2
    for r in rows:
        slack = r.gap / 50 + 1e-9
        assert r.y1_dual_after - slack <= r.finite_difference <= r.y1_dual + slack


@pytest.mark.parametrize("costs", ["distinct", "mixed"])
def test_repair_equals_a_plain_loop(spark, costs):
    rnd = random.Random(11)
    rows = []
    for i in range(1500):
        uc = {"distinct": 5 + i / 128, "one": 8.0, "mixed": 8.0 if i % 3 else 5 + i / 128}[costs]
        rows.append((f"i{i}", "fall" if i % 5 else "winter", uc, float(rnd.randint(6, 30)), float(rnd.randint(4, 9))))
    plan = spark.createDataFrame(rows, "item string, season string, unit_cost double, q1 double, q2 double")
    total = {s: sum(r[2] * max(r[3], 6) for r in rows if r[1] == s) for s in ("fall", "winter")}
    floor = {s: sum(r[2] * 6 for r in rows if r[1] == s) for s in total}
    for share in (0.37, 1.0):
        b = {s: floor[s] + share * (total[s] - floor[s]) for s in total}
        bud = spark.createDataFrame(list(b.items()), "season string, budget1 double")
        got = {r.item: r.q1 for r in J._repair_one(plan, "q1", "budget1", bud, "season", 6, ["item"]).collect()}
        assert len(got) == len(rows)
        for s in total:
            own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], hashlib.md5(r[0].encode()).hexdigest()))
            need = total[s] - b[s]
            for r in own:
                cut = 0.0
                if need > 1e-6:
                    cut = min(math.ceil(need / r[2] - 1e-9), r[3] - 6)
                    need -= cut * r[2]
                assert got[r[0]] == r[3] - cut, (r, share)
