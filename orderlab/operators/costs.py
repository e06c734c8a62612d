"""Cost resolution (J6, J7), critical ratio and safety factors (M10), PTO
adjustments (M11, M12) and newsvendor totals (N1, N2).

Look-ups are resolved once per distinct (category, period) of the data, never
per row: the distinct combinations (bounded by the category rules and the
period rule) are crossed with the cost rows (a configuration list), each cost
row gets a priority, and the best one wins by (priority, list position).  The
resolved table is then broadcast into the item table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlab.functions.newsvendor import critical_ratio, nv_cost
from orderlab.functions.normal import norm_ppf
from orderlab.sources.config import COST_ALIASES

COST_NAMES = ("unit_cost", "overage_cost", "underage_cost")
_NONE = 1 << 30


def _priority(name: str, mode: str) -> Column:
    """Priority of a cost row (aliases ``c_``) for the query (``q_category``, ``q_period``)."""
    same_name = F.col("c_name") == name
    same_cat = F.col("c_category").eqNullSafe(F.col("q_category"))
    if mode == "optimizer":
        # exact (category, period) -> category, no period -> any row of that name -> aliases
        p = (F.when(same_name & same_cat & F.col("c_period").eqNullSafe(F.col("q_period")), 1)
             .when(same_name & same_cat & F.col("c_period").isNull(), 2)
             .when(same_name, 3))
        for k, alias in enumerate(COST_ALIASES.get(name, [])):
            p = p.when(F.col("c_name") == alias, 4 + k)
        return p
    if mode == "strict":
        # exact -> category, no period -> no category, no period; else not found
        return (F.when(same_name & same_cat & F.col("c_period").eqNullSafe(F.col("q_period")), 1)
                .when(same_name & same_cat & F.col("c_period").isNull(), 2)
                .when(same_name & F.col("c_period").isNull() & F.col("c_category").isNull(), 3))
    raise ValueError(mode)


def resolve_costs(combos: DataFrame, cost_table: DataFrame, mode: str = "optimizer",
                  names=COST_NAMES, default: float | None = 1.0) -> DataFrame:
    """(product_category, period) -> one column per cost name.

    ``mode='optimizer'`` is J6 (the optimiser's fallback chain, missing -> ``default``),
    ``mode='strict'`` is J7 (missing -> NULL; the scorer then uses 1.0/1.0).
    """
    q = combos.select(F.col("product_category").alias("q_category"),
                      F.col("period").cast("int").alias("q_period")).distinct()
    c = cost_table.select(F.col("ord").alias("c_ord"), F.col("name").alias("c_name"),
                          F.col("value").alias("c_value"), F.col("product_category").alias("c_category"),
                          F.col("period").alias("c_period"))
    j = q.crossJoin(F.broadcast(c))  # distinct combos x configuration rows
    aggs = []
    for n in names:
        key = F.coalesce(_priority(n, mode) * 100000 + F.col("c_ord"), F.lit(_NONE))
        best = F.min(F.struct(key.alias("k"), F.col("c_value").alias("v")))
        v = F.when(best["k"] < _NONE, best["v"])
        if mode == "optimizer" and default is not None:
            v = F.coalesce(v, F.lit(float(default)))
        aggs.append(v.alias(n))
    return (j.groupBy("q_category", "q_period").agg(*aggs)
            .withColumnRenamed("q_category", "product_category").withColumnRenamed("q_period", "period"))


def attach_costs(items: DataFrame, resolved: DataFrame, period_col: str | None = "lifecycle_year") -> DataFrame:
    """Broadcast join of resolved costs on (category, period), NULL-safe."""
    r = resolved.withColumnRenamed("product_category", "_rc").withColumnRenamed("period", "_rp")
    per = F.col(period_col).cast("int") if period_col else F.lit(None).cast("int")
    cond = F.col("product_category").eqNullSafe(F.col("_rc")) & per.eqNullSafe(F.col("_rp"))
    return items.join(F.broadcast(r), cond, "left").drop("_rc", "_rp")


def item_combos(items: DataFrame, period_col: str | None = "lifecycle_year") -> DataFrame:
    per = F.col(period_col).cast("int") if period_col else F.lit(None).cast("int")
    return items.select("product_category", per.alias("period")).distinct()


def with_costs(items: DataFrame, cost_table: DataFrame, mode: str = "optimizer",
               period_col: str | None = "lifecycle_year", names=COST_NAMES) -> DataFrame:
    return attach_costs(items, resolve_costs(item_combos(items, period_col), cost_table, mode, names), period_col)


def strict_scoring_costs(items: DataFrame, cost_table: DataFrame, period_col: str = "lifecycle_year") -> DataFrame:
    """J7 as the model scorer uses it: co and cu from the strict look-up; if
    either is missing both become 1.0 (symmetric fallback)."""
    x = with_costs(items, cost_table, "strict", period_col, ("overage_cost", "underage_cost"))
    missing = F.col("overage_cost").isNull() | F.col("underage_cost").isNull()
    return (x.withColumn("co", F.when(missing, 1.0).otherwise(F.col("overage_cost")))
             .withColumn("cu", F.when(missing, 1.0).otherwise(F.col("underage_cost")))
             .drop("overage_cost", "underage_cost"))


def critical_ratio_table(resolved_strict: DataFrame, strength: float = 0.8) -> DataFrame:
    """CR = cu/(cu+co) and safety factor 1+(CR-0.5)*strength per (category, period);
    factor 1.0 where a cost is missing.  Adds the normal quantile z = Phi^-1(CR) (M12)."""
    co, cu = F.col("overage_cost"), F.col("underage_cost")
    cr = critical_ratio(co, cu)
    return resolved_strict.select(
        "product_category", "period", co.alias("co"), cu.alias("cu"), cr.alias("critical_ratio"),
        F.coalesce(1.0 + (cr - 0.5) * strength, F.lit(1.0)).alias("safety_factor"),
        norm_ppf(cr).alias("z_cr"))


def pto_adjust(preds: DataFrame, cr_table: DataFrame, pred_col: str = "pred",
               period_col: str = "lifecycle_year") -> DataFrame:
    """Prediction x safety factor of its (category, period), floored at 0."""
    x = attach_costs(preds, cr_table.select("product_category", "period", "safety_factor"), period_col)
    return x.withColumn("pred_pto", F.greatest(F.col(pred_col) * F.coalesce(F.col("safety_factor"), F.lit(1.0)),
                                               F.lit(0.0)))


def pto_quantile(preds: DataFrame, cr_table: DataFrame, sigma_col: str = "sigma", pred_col: str = "pred",
                 period_col: str = "lifecycle_year") -> DataFrame:
    """D + sigma * Phi^-1(CR), floored at 0."""
    x = attach_costs(preds, cr_table.select("product_category", "period", "z_cr"), period_col)
    return x.withColumn("pred_quantile", F.greatest(F.col(pred_col) + F.col(sigma_col) * F.col("z_cr"), F.lit(0.0)))


def nv_totals(scored: DataFrame, q: str, d: str, co: str = "co", cu: str = "cu",
              by=("product_category", "lifecycle_year")) -> DataFrame:
    """NV cost of a plan, by (category, period) and in total (rollup)."""
    cost = nv_cost(F.col(q), F.col(d), F.col(co), F.col(cu))
    return (scored.rollup(*by).agg(F.count(F.lit(1)).alias("items"), F.sum(cost).alias("nv_cost"))
            .select(*[F.coalesce(F.col(b).cast("string"), F.lit("ALL")).alias(b) for b in by], "items", "nv_cost"))
