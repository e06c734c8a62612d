"""The forecast winner inside a plan (M15 -> M13) and the settings grid."""

import random
import statistics

from pyspark.sql import functions as F

from orderlab.operators import forecast as FC

KEYS = ["item"]


def data(spark):
    rows = []
    for i in range(30):
        for y in range(2020, 2026):
            rows.append((f"i{i}", y, 10.0 + i + 5.0 * (y - 2020) + (i + y) % 2))
    rows.append(("new", 2025, 7.0))
    g = spark.createDataFrame(rows, "item string, year int, demand double")
    return g.where("year < 2025"), g.where("year = 2025"), rows


def test_candidates_and_winner(spark):
    train, test, rows = data(spark)
    long = FC.candidate_forecasts(train, test, KEYS)
    got = {(r.item, r.model): r.pred for r in long.collect()}
    past = [r[2] for r in rows if r[1] < 2025]
    assert all(abs(got["new", m] - statistics.mean(past)) < 1e-9 for m in ("Baseline", "Trend", "Last", "Median"))
    own = [r[2] for r in rows if r[0] == "i4" and r[1] < 2025]
    assert abs(got["i4", "Baseline"] - statistics.mean(own)) < 1e-9
    assert got["i4", "Last"] == own[-1] and got["i4", "Median"] == statistics.median(own)
    scored = long.withColumn("base", F.col("model")).withColumn("co", F.lit(1.0)).withColumn("cu", F.lit(3.0))
    sig = FC.model_sigma(FC.candidate_forecasts(train, train, KEYS))
    sigmas = {r.base: r.sigma for r in sig.collect()}
    cost = {}
    actual = {r[0]: r[2] for r in rows if r[1] == 2025}
    for (item, m), p in got.items():
        cost[m] = cost.get(m, 0) + max(p - actual[item], 0) + 3 * max(actual[item] - p, 0)
    want = min((c, m) for m, c in cost.items() if m != "Baseline")[1]
    for sigma_from in (None, "Last"):
        out = FC.winner_forecast(scored, sig, 12, sigma_from=sigma_from).collect()
        assert len(out) == 31 and {r.model for r in out} == {want} == {"Trend"}
        assert {r.sigma for r in out} == {sigmas[sigma_from or want]}
        assert all(r.pred == max(got[r.item, want], 12.0) for r in out)


def test_settings_are_scored_and_the_best_wins(spark):
    rnd = random.Random(3)
    rows = [(float(x), 5.0 + 40.0 * x + rnd.uniform(-1, 1), 1.0, 2.0) for x in [rnd.random() for _ in range(120)]]
    df = spark.createDataFrame(rows, "f double, demand double, co double, cu double")
    settings = [(f"alpha={a}", FC.ridge(df, ["f"], a), {}) for a in (0.01, 1.0, 1000.0)]
    settings.append(("override", FC.ridge(df, ["f"], 1.0), {"regParam": 1e6}))
    long = FC.GridFit(settings, ["f"]).predictions(df, df)
    base = df.withColumn("model", F.lit("Baseline")).withColumn("pred", F.lit(25.0))
    out = {r.model: r for r in FC.score_models(long.unionByName(base)).collect()}
    assert len(out) == 5 and [m for m, r in out.items() if r.winner] == ["alpha=0.01"]
    assert out["alpha=0.01"].nv_cost < out["alpha=1000.0"].nv_cost < out["override"].nv_cost * 1.5
    assert out["override"].nv_cost > 2 * out["alpha=0.01"].nv_cost
