"""Model B: joint objective goldens (FIXTURES F6), vertex solver vs grid search, repair."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from orderlab.operators import joint as J

SCHEMA = "item string, season string, cu1 double, co2 double, cu2 double, unit_cost double, d1 array<double>, d2 array<double>"


def jcost(q1, q2, d1, d2, cu1, co2, cu2):
    t = 0.0
    for a, b in zip(d1, d2):
        inv = max(q1 - a, 0)
        t += cu1 * max(a - q1, 0) + co2 * max(q2 + inv - b, 0) + cu2 * max(b - q2 - inv, 0)
    return t / len(d1)


@pytest.mark.parametrize("q1,q2,d1,d2,expected", [
    (10, 12, [10], [12], 0.0), (8, 12, [10], [12], 24.0), (15, 7, [10], [12], 0.0), (20, 10, [10], [10], 150.0),
    (14, 6, [10], [12], 120.0), (11, 10, [10, 12], [10, 10], 13.5)])
def test_joint_goldens(spark, q1, q2, d1, d2, expected):
    df = spark.createDataFrame([("a", "fall", 12.0, 15.0, 60.0, 25.0, [float(x) for x in d1], [float(x) for x in d2])],
                               SCHEMA)
    got = df.select(J.joint_cost(F.lit(float(q1)), F.lit(float(q2)))).first()[0]
    assert abs(got - expected) < 1e-9


def test_two_items_zero(spark):
    df = spark.createDataFrame([("a", "fall", 12.0, 15.0, 60.0, 25.0, [10.0], [12.0]),
                                ("b", "fall", 12.0, 15.0, 60.0, 25.0, [8.0], [6.0])], SCHEMA)
    q = {"a": (10.0, 12.0), "b": (8.0, 6.0)}
    rows = df.collect()
    assert sum(jcost(*q[r.item], r.d1, r.d2, r.cu1, r.co2, r.cu2) for r in rows) == 0.0


def test_vertex_candidates_vs_grid(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(25):
        d1 = [round(rnd.uniform(0, 10), 1) for _ in range(3)]
        d2 = [round(rnd.uniform(0, 10), 1) for _ in range(3)]
        rows.append((f"i{i}", "fall", float(rnd.choice([2, 8, 12])), float(rnd.choice([1, 8, 15])),
                     float(rnd.choice([5, 25, 60])), 10.0, d1, d2))
    df = J.with_candidates(spark.createDataFrame(rows, SCHEMA), 1)
    best = {r.item: r.b for r in df.select("item", F.array_min("cands").alias("b")).collect()}
    grid = [x / 10 for x in range(10, 221)]
    for r in rows:
        g = min(jcost(a, b, r[6], r[7], r[2], r[3], r[4]) for a, b in itertools.product(grid, grid))
        assert best[r[0]].cost <= g + 1e-6


def test_orders_and_repair_feasible(spark):
    rnd = random.Random(3)
    rows = [(f"i{i}", s, 12.0, 15.0, 60.0, float(rnd.choice([10, 16, 25])),
             [float(rnd.randint(5, 40)) for _ in range(3)], [float(rnd.randint(5, 40)) for _ in range(3)])
            for i in range(12) for s in ("fall", "winter")]
    it = spark.createDataFrame(rows, SCHEMA).withColumn("item", F.concat("item", F.lit("_"), "season"))
    # budgets above the MOQ spend of each season (6 units of every item)
    moq_spend = {s: 6 * sum(r[5] for r in rows if r[1] == s) for s in ("fall", "winter")}
    b1 = {s: moq_spend[s] + 400.0 for s in moq_spend}
    b2 = {s: moq_spend[s] + 300.0 for s in moq_spend}
    bud = spark.createDataFrame([(s, b1[s], b2[s]) for s in moq_spend], "season string, budget1 double, budget2 double")
    plan, duals = J.joint_orders(it, bud, "season", 6, rounds=24)
    rep = J.joint_repair(plan, bud, "season", 6, ["item"])
    sp = {r.season: r for r in J.joint_spend(rep, bud, "season").collect()}
    for s in ("fall", "winter"):
        assert sp[s].y1_spend <= b1[s] + 1e-6 and sp[s].y2_spend <= b2[s] + 1e-6 and sp[s].feasible
    assert rep.filter((F.col("q1") < 6) | (F.col("q2") < 6)).count() == 0
    # the Lagrangian bound never exceeds the objective of a feasible plan
    obj = rep.select(F.sum(J.joint_cost(F.col("q1").cast("double"), F.col("q2").cast("double")))).first()[0]
    assert sum(r.dual_bound for r in duals.collect()) <= obj + 1e-6
    carry = rep.select(F.min(J.expected_carryover(F.col("q1").cast("double")))).first()[0]
    assert carry >= 0.0
