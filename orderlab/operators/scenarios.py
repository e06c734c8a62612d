"""Demand scenarios in long form (M13, M14): one row per (item, scenario).

Scenario tables stay long (``scenario_id``, ``demand``); optimisation
operators collect an item's scenarios into an array only per item, which is
bounded by the number of scenarios, never by the data volume.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# z values of the P10, P50 and P90 scenarios.
Z_P10_P50_P90 = [NormalDist().inv_cdf(0.10), 0.0, NormalDist().inv_cdf(0.90)]


def normal_scenarios(preds: DataFrame, keys, moq: int, pred: str = "pred", sigma: str = "sigma",
                     z=tuple(Z_P10_P50_P90)) -> DataFrame:
    """P10/P50/P90 = max(p + sigma*z, 0) with p = max(pred, moq) first."""
    spark = preds.sparkSession
    zt = spark.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "scenario_id int, z double")
    p = F.greatest(F.col(pred), F.lit(float(moq)))
    return (preds.crossJoin(F.broadcast(zt))  # the z table has len(z) rows
            .select(*keys, "scenario_id", F.greatest(p + F.col(sigma) * F.col("z"), F.lit(0.0)).alias("demand")))


def empirical_scenarios(groups: DataFrame, keys, train_years) -> DataFrame:
    """One scenario per train year per item (SAA over the item's history)."""
    return (groups.filter(F.col("year").isin(*train_years))
            .select(*keys, F.col("year").alias("scenario_id"), F.col("demand").cast("double").alias("demand")))


def scenario_arrays(scen: DataFrame, keys) -> DataFrame:
    """Per item: sorted scenario demands (bounded by the scenario count)."""
    return scen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("demand").cast("double"))).alias("d"))


def scenario_mean(scen: DataFrame, keys) -> DataFrame:
    return scen.groupBy(*keys).agg(F.avg("demand").alias("expected_demand"))
