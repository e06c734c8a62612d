"""Forecasting operators: historical-mean baselines (A2, A3, J1), residual spread
(A12, A13), model scoring and selection (M15, O5), validation report (A10, A14,
A15, O2, M17), and Spark ML forecasters (M5-M9) plus a grouped pandas
forecaster (F2).

Forecasts are made per demand group, so their inputs are already aggregated
(one row per item and year); the line-level work happened in ``demand``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlab.functions.newsvendor import nv_cost
from orderlab.operators.demand import ITEM_KEYS


def string_keys(df: DataFrame, exclude=("demand",)) -> list:
    """Non-numeric columns other than the target (the reference's baseline keys)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def baseline_by_item(train: DataFrame, keys=("product_category", "gender_age", "size"), target: str = "demand",
                     digits: int | None = 2) -> DataFrame:
    """A2: mean target over train rows per item, rounded (half away from zero, Q17)."""
    m = F.avg(target)
    return train.groupBy(*keys).agg((F.round(m, digits) if digits is not None else m).alias("baseline_qty"))


def baseline_predict(train: DataFrame, test: DataFrame, keys=None, target: str = "demand") -> DataFrame:
    """A3 + J1: per-key train mean joined to the test rows; missing keys (or no
    keys at all) get the global train mean, joined as a one-row table."""
    keys = list(keys) if keys is not None else string_keys(train, (target,))
    g = train.agg(F.avg(target).alias("_global"))
    if not keys:
        return test.crossJoin(F.broadcast(g)).withColumnRenamed("_global", "pred")
    per = train.groupBy(*keys).agg(F.avg(target).alias("_bq"))
    return (test.join(per, keys, "left").crossJoin(F.broadcast(g))
            .withColumn("pred", F.coalesce(F.col("_bq"), F.col("_global"))).drop("_bq", "_global"))


def residual_sigma(scored_train: DataFrame, pred: str = "pred", target: str = "demand",
                   by: str = "product_category", default: float = 10.0) -> DataFrame:
    """A12 + A13: residual spread, global population std (0 -> default) and per
    group sample std (NULL -> default); scope 'ALL' is the global row."""
    r = F.col(target) - F.col(pred)
    g = scored_train.agg(F.lit("ALL").alias("scope"), F.stddev_pop(r).alias("sigma"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("sigma", F.when(F.col("sigma") == 0, default).otherwise(F.col("sigma")))
    c = scored_train.groupBy(F.col(by).alias("scope")).agg(F.stddev_samp(r).alias("sigma"), F.count(F.lit(1)).alias("n"))
    c = c.withColumn("sigma", F.coalesce(F.when(~F.isnan("sigma"), F.col("sigma")), F.lit(default)))
    return g.unionByName(c)


def score_models(long_preds: DataFrame, model: str = "model", pred: str = "pred", target: str = "demand",
                 baseline: str = "Baseline") -> DataFrame:
    """M15 + O5: total NV cost per model (co, cu on the rows), % change versus
    the baseline and the winner (lowest cost, ties by name, baseline excluded)."""
    tot = long_preds.groupBy(model).agg(F.sum(nv_cost(F.col(pred), F.col(target), F.col("co"), F.col("cu")))
                                        .alias("nv_cost"), F.count(F.lit(1)).alias("items"))
    base = tot.filter(F.col(model) == baseline).select(F.col("nv_cost").alias("_base"))
    win = (tot.filter(F.col(model) != baseline)
           .agg(F.min_by(F.col(model), F.struct(F.col("nv_cost"), F.col(model))).alias("_winner")))
    return (tot.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(win))
            .select(model, "items", "nv_cost",
                    F.when(F.col("_base") > 0, (F.col("nv_cost") / F.col("_base") - 1) * 100).otherwise(0.0)
                    .alias("pct_vs_baseline"),
                    (F.col(model) == F.col("_winner")).alias("winner")))


def candidate_forecasts(train: DataFrame, rows: DataFrame, keys=ITEM_KEYS, target: str = "demand") -> DataFrame:
    """The non-ML candidates of M15 for every row of ``rows``, long (rows + model, pred): the
    item's mean (Baseline), least-squares trend, last year and median over its train years;
    items without history get the global mean.  One aggregate and one join for all of them."""
    year, y = F.col("year").cast("double"), F.col(target).cast("double")
    fit = train.groupBy(*keys).agg(
        F.avg(y).alias("_mean"), F.regr_slope(y, year).alias("_slope"), F.regr_intercept(y, year).alias("_icpt"),
        F.max_by(y, F.col("year")).alias("_last"), F.percentile(y, F.lit(0.5)).alias("_median"))
    glob = train.agg(F.avg(y).alias("_global"))
    trend = F.coalesce(F.col("_icpt") + F.col("_slope") * year, F.col("_mean"))
    models = [("Baseline", F.col("_mean")), ("Trend", trend), ("Last", F.col("_last")), ("Median", F.col("_median"))]
    each = F.array(*[F.struct(F.lit(n).alias("model"), F.greatest(F.coalesce(c, F.col("_global")), F.lit(0.0)).alias("pred"))
                     for n, c in models])
    return (rows.join(fit, list(keys), "left").crossJoin(F.broadcast(glob))  # one row
            .select(*rows.columns, F.explode(each).alias("_m")).select(*rows.columns, "_m.model", "_m.pred"))


def model_sigma(train_preds: DataFrame, target: str = "demand", default: float = 10.0) -> DataFrame:
    """(base, sigma): population spread of each model's residuals on train rows (0 -> default)."""
    s = F.stddev_pop(F.col(target) - F.col("pred"))
    return train_preds.groupBy(F.col("model").alias("base")).agg(s.alias("sigma")).withColumn(
        "sigma", F.when(F.col("sigma") == 0, default).otherwise(F.col("sigma")))


def winner_forecast(scored: DataFrame, sigmas: DataFrame, moq: int, baseline: str = "Baseline",
                    sigma_from: str | None = None) -> DataFrame:
    """M15 inside a plan: the rows of the model with the lowest total NV cost (long predictions
    ``scored`` with model, base, pred, demand, co, cu; ties by name, the baseline only compared),
    pred floored at MOQ, with the residual spread of that model or of ``sigma_from``.  The
    choice is a one-row table that is joined back; nothing is collected."""
    cost = F.sum(nv_cost(F.col("pred"), F.col("demand"), F.col("co"), F.col("cu")))
    tot = scored.where(F.col("model") != baseline).groupBy(F.col("model").alias("_best")).agg(cost.alias("_c"))
    best = tot.agg(F.min_by("_best", F.struct("_c", "_best")).alias("_best"))
    won = scored.join(F.broadcast(best), F.col("model") == F.col("_best")).drop("_best")
    base = F.col("base") if sigma_from is None else F.lit(sigma_from)
    return (won.withColumn("_b", base).join(F.broadcast(sigmas.withColumnRenamed("base", "_b")), "_b")  # one row a model
            .drop("_b").withColumn("pred", F.greatest(F.col("pred"), F.lit(float(moq)))))


class GridFit:
    """Settings of one or more estimators scored by M15.

    ``settings``: (name, estimator, {param: value}) triples.  All fits run on one cached,
    assembled frame, ``parallelism`` at a time."""

    def __init__(self, settings, features, parallelism: int = 4):
        self.settings, self.features, self.parallelism = list(settings), list(features), parallelism

    def predictions(self, train: DataFrame, test: DataFrame, floor: float = 0.0) -> DataFrame:
        """Long test predictions (test + model, pred) of every setting."""
        from multiprocessing.pool import ThreadPool
        frame = _assemble(train, self.features).persist()
        frame.count()
        rows = _assemble(test, self.features)
        pool = ThreadPool(self.parallelism)
        try:
            fits = pool.map(lambda s: s[1].copy({s[1].getParam(k): v for k, v in s[2].items()}).fit(frame), self.settings)
        finally:
            pool.close()
            frame.unpersist()
        out = None
        for (name, _, _), model in zip(self.settings, fits, strict=True):
            one = model.transform(rows).select(*test.columns, F.lit(name).alias("model"),
                                               F.greatest(F.col("prediction"), F.lit(floor)).alias("pred"))
            out = one if out is None else out.unionByName(one)
        return out


def with_errors(df: DataFrame, pred: str = "predicted_order", actual: str = "demand") -> DataFrame:
    e = F.col(pred) - F.col(actual)
    return df.select("*", e.alias("error"), F.abs(e).alias("abs_error"),
                     (e / F.greatest(F.col(actual), F.lit(1)) * 100).alias("pct_error"))


def error_report(df: DataFrame, by: str = "product_category") -> DataFrame:
    """A10 + A14 + A15: per category and overall ('ALL'): items, mean error, MAE,
    RMSE, mean and median % error, sums, over/under/exact counts."""
    aggs = [F.count(F.lit(1)).alias("items"), F.avg("error").alias("mean_error"),
            F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("error") ** 2)).alias("rmse"),
            F.avg("pct_error").alias("mean_pct_error"),
            F.percentile(F.col("pct_error"), F.lit(0.5)).alias("median_pct_error"),
            F.sum("predicted_order").alias("total_predicted"), F.sum("demand").alias("total_actual"),
            F.count_if(F.col("error") > 0).alias("over_orders"), F.count_if(F.col("error") < 0).alias("under_orders"),
            F.count_if(F.col("error") == 0).alias("exact")]
    per = df.groupBy(by).agg(*aggs)
    allr = df.agg(*aggs).select(F.lit("ALL").alias(by), "*")
    return per.unionByName(allr)


def worst_orders(df: DataFrame, keys, n: int = 10) -> DataFrame:
    """O2: the n largest over-orders and n largest under-orders, ties by keys."""
    over = df.orderBy(F.col("error").desc(), *keys).limit(n).withColumn("kind", F.lit("over"))
    under = df.orderBy(F.col("error").asc(), *keys).limit(n).withColumn("kind", F.lit("under"))
    return over.unionByName(under)


# ---------------------------------------------------------------- Spark ML forecasters

def _assemble(df: DataFrame, features):
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def fit_predict(train: DataFrame, test: DataFrame, features, estimator, floor: float = 0.0):
    """Fit a Spark ML regressor on train groups, predict test groups (floored)."""
    model = estimator.fit(_assemble(train, features))
    pred = model.transform(_assemble(test, features)).withColumn(
        "pred", F.greatest(F.col("prediction"), F.lit(floor))).drop("features", "prediction")
    return model, pred


def gbt(seed: int = 42, trees: int = 300, depth: int = 4, rate: float = 0.05, sample: float = 0.8,
        col_sample: str = "0.8"):
    """M5: boosted trees (``trees`` rounds)."""
    from pyspark.ml.regression import GBTRegressor
    return GBTRegressor(labelCol="demand", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=sample,
                        featureSubsetStrategy=col_sample, seed=seed)


def forest(seed: int = 42, trees: int = 300, depth: int = 4, sample: float = 0.8):
    """M6: the second tree family (random forest) as the documented substitute."""
    from pyspark.ml.regression import RandomForestRegressor
    return RandomForestRegressor(labelCol="demand", numTrees=trees, maxDepth=depth, subsamplingRate=sample, seed=seed)


def ridge(train: DataFrame, features, alpha: float = 1.0):
    """M7: ridge with penalty alpha on population-standardised features.

    Spark scales the L2 term by the label's std and the row count, so
    regParam = alpha * std_pop(y) / n reproduces sum-of-squares + alpha*|b|^2
    (with ``standardization=False`` on features already standardised)."""
    from pyspark.ml.regression import LinearRegression
    st = train.agg(F.stddev_pop("demand").alias("s"), F.count(F.lit(1)).alias("n")).first()
    reg = alpha * (st["s"] or 1.0) / max(st["n"], 1)
    return LinearRegression(labelCol="demand", regParam=reg, elasticNetParam=0.0, standardization=False,
                            solver="normal")


def feature_importance(model, features) -> list:
    """M9: (feature, importance) sorted descending (driver-side, one value per feature)."""
    imp = model.featureImportances.toArray().tolist()
    return sorted(zip(features, imp), key=lambda t: (-t[1], t[0]))


def nv_loss_fit(train: DataFrame, features, co: str | float = "co", cu: str | float = "cu", epochs: int = 80,
                lr: float = 0.05, penalty: float = 0.01, history: list | None = None):
    """M8: decision-focused log-linear model d = expm1(clip(x.b, 0, hi)), fitted on the
    (smoothed) NV loss by full-batch Adam; returns (b, hi).

    ``co`` and ``cu`` are cost columns of the rows (by category and period) or
    numbers.  The fit starts at the log of the mean demand, the upper clip is the
    log of twice the largest train demand, and the gradient is not cut at the lower
    clip, so a row predicted at zero can still move.  Each epoch is one distributed
    aggregate over the persisted training rows; only the coefficient vector (one
    number per feature) lives on the driver.  ``history`` gets the mean loss of each
    epoch before its step.
    """
    import math

    from orderlab.functions.newsvendor import sigmoid, softplus
    cost = [F.col(c).cast("double") if isinstance(c, str) else F.lit(float(c)) for c in (co, cu)]
    x = train.select(*[F.col(c).cast("double").alias(c) for c in features], F.col("demand").cast("double").alias("demand"),
                     cost[0].alias("_co"), cost[1].alias("_cu")).persist()
    first = x.agg(F.count(F.lit(1)).alias("n"), F.avg("demand").alias("mean"), F.max("demand").alias("top")).first()
    n, hi = first["n"] or 1, math.log1p(2 * (first["top"] or 1.0))
    nb = len(features) + 1
    b = [math.log1p(first["mean"] or 0.0)] + [0.0] * len(features)
    m, v = [0.0] * nb, [0.0] * nb
    b1, b2, eps = 0.9, 0.999, 1e-8
    cols = [F.lit(1.0)] + [F.col(c) for c in features]
    for t in range(1, epochs + 1):
        z = sum((c * bj for c, bj in zip(cols, b)), F.lit(0.0))
        zc = F.least(F.greatest(z, F.lit(0.0)), F.lit(hi))
        pred = F.expm1(zc)
        dpred = F.when(z < hi, F.exp(zc)).otherwise(0.0)
        over, under = pred - F.col("demand"), F.col("demand") - pred
        dloss = F.col("_co") * sigmoid(over, 5.0) - F.col("_cu") * sigmoid(under, 5.0)
        loss = F.col("_co") * softplus(over, 5.0) + F.col("_cu") * softplus(under, 5.0)
        g = x.agg(F.avg(loss).alias("loss"), *[F.sum(dloss * dpred * c).alias(f"g{j}") for j, c in enumerate(cols)]).first()
        if history is not None:
            history.append(g["loss"])
        grad = [(g[f"g{j}"] or 0.0) / n + (penalty * b[j] if j else 0.0) for j in range(nb)]
        for j in range(nb):
            m[j] = b1 * m[j] + (1 - b1) * grad[j]
            v[j] = b2 * v[j] + (1 - b2) * grad[j] ** 2
            b[j] -= lr * (m[j] / (1 - b1 ** t)) / (math.sqrt(v[j] / (1 - b2 ** t)) + eps)
    x.unpersist()
    return b, hi


def nv_loss_predict(df: DataFrame, features, b, clip_hi: float) -> DataFrame:
    cols = [F.lit(1.0)] + [F.col(c).cast("double") for c in features]
    z = sum((c * bj for c, bj in zip(cols, b)), F.lit(0.0))
    return df.withColumn("pred", F.expm1(F.least(F.greatest(z, F.lit(0.0)), F.lit(clip_hi))))


def grouped_forecast(groups: DataFrame, train_years, test_years, keys=ITEM_KEYS, model=None) -> DataFrame:
    """a user forecaster ``model(years, demand, year) -> number`` fitted per group via
    ``applyInPandas`` (default: a least-squares trend over an item's train years);
    predictions are floored at 0.  Each group is one item's yearly demand (bounded by the number of
    years), never raw lines, so no group can grow with the data volume."""
    import numpy as np
    import pandas as pd

    train_years, test_years = list(train_years), list(test_years)
    keys = list(keys)
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in keys],
                           T.StructField("year", T.IntegerType()), T.StructField("pred", T.DoubleType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf[pdf["year"].isin(train_years)]
        if g.empty:
            return pd.DataFrame(columns=[*keys, "year", "pred"])
        yrs, d = g["year"].to_numpy(float), g["demand"].to_numpy(float)
        key = [pdf[k].iloc[0] for k in keys]
        own = model or (lambda x, y, at: np.polyval(np.polyfit(x, y, 1), at) if len(x) >= 2 else y.mean())
        return pd.DataFrame([(*key, int(ty), max(float(own(yrs, d, ty)), 0.0)) for ty in test_years],
                            columns=[*keys, "year", "pred"])

    return (groups.select(*keys, F.col("year").cast("int"), F.col("demand").cast("double"))
            .groupBy(*keys).applyInPandas(fit, schema))


def trend_forecast(groups: DataFrame, train_years, test_years, keys=ITEM_KEYS) -> DataFrame:
    """F2, the built-in trend: least squares over an item's train years, extrapolated to
    the test years and floored at 0, as one aggregate (a single year: its mean)."""
    year, demand = F.col("year").cast("double"), F.col("demand").cast("double")
    fit = (groups.where(F.col("year").isin(*train_years)).groupBy(*keys)
           .agg(F.regr_slope(demand, year).alias("slope"), F.regr_intercept(demand, year).alias("icpt"),
                F.avg(demand).alias("mean")))
    years = F.explode(F.array(*[F.lit(int(y)) for y in test_years])).alias("year")
    return fit.select(*keys, "slope", "icpt", "mean", years).select(
        *keys, "year", F.greatest(F.coalesce(F.col("icpt") + F.col("slope") * F.col("year"), F.col("mean")), F.lit(0.0))
        .alias("pred"))
