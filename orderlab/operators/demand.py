"""Demand groups, pivots, features and splits.

All group-level operators take the clean lines (or groups derived from them).
Line-level work is one partial + final hash aggregate: map-side combining sends
one row per group and task through the shuffle, so a group holding a third of
all lines costs the same shuffle bytes as any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlab.functions import rules as R

GROUP_KEYS = ["year", "season", "product_category", "gender_age", "size"]
ITEM_KEYS = ["season", "product_category", "gender_age", "size"]


def complete_groups(lines: DataFrame, keys, *aggs) -> DataFrame:
    """``aggs`` per group of lines whose keys are all present.

    The test is an aggregate of the group, not a filter on the lines: Catalyst would move
    that filter below the projection of the keys and run their text rules a second time
    for every line."""
    floats = {f.name for f in lines.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & ~F.isnan(k) if k in floats else F.col(k).isNotNull()
                                        for k in keys])
    return (lines.groupBy(*keys).agg(F.bool_and(whole).alias("_whole"), *aggs)
            .where("_whole").drop("_whole"))


def demand_groups(lines: DataFrame, keys=None, target: str = "quantity") -> DataFrame:
    """A1 (+P8, P15): sum of the target per group; rows with a NULL key are dropped.

    Keys missing from the data are silently ignored; with no key left the
    lines themselves are returned with the target renamed to ``demand``.
    """
    keys = [k for k in (keys or GROUP_KEYS) if k in lines.columns]
    if not keys:
        return lines.withColumnRenamed(target, "demand")
    return complete_groups(lines, keys, F.sum(target).alias("demand"))


def demand_price_groups(lines: DataFrame, keys=None) -> DataFrame:
    """A5: demand sum and mean unit price in one pass."""
    keys = keys or GROUP_KEYS
    return complete_groups(lines, keys, F.sum("quantity").alias("demand"), F.avg("unit_price").alias("unit_price"))


def year_pivot(lines: DataFrame, col: str, values: list) -> DataFrame:
    """Yearly totals with one column per fixed value of ``col`` (0 when absent).

    The value list is fixed, so no extra job discovers the pivot values.
    """
    p = lines.groupBy("year").pivot(col, values).agg(F.sum("quantity"))
    return (p.na.fill(0, subset=values)
            .join(lines.groupBy("year").agg(F.sum("quantity").alias("total")), "year")
            .select("year", "total", *values))


def history_depth(groups: DataFrame, item_keys=None, train_years=None) -> DataFrame:
    """Train years per item, then the number of items by depth."""
    item_keys = item_keys or ITEM_KEYS
    g = groups if train_years is None else groups.filter(F.col("year").isin(*train_years))
    per_item = g.groupBy(*item_keys).agg(F.countDistinct("year").alias("n_years"))
    return per_item.groupBy("n_years").agg(F.count(F.lit(1)).alias("items"))


def with_year_index(groups: DataFrame) -> DataFrame:
    """Year - min(year), the minimum joined as a one-row aggregate (no global window)."""
    m = groups.agg(F.min("year").alias("_min_year"))
    return groups.crossJoin(F.broadcast(m)).withColumn(
        "year_idx", F.col("year") - F.col("_min_year")).drop("_min_year")


def label_encode(groups: DataFrame, cols) -> DataFrame:
    """code = rank of the value among the sorted distinct values, NULL -> -1.

    The rank is computed over the distinct values only and without a global
    window: a range-partitioned sort plus per-partition offsets (``ordinal``),
    then joined back."""
    out = groups
    for c in cols:
        vals = groups.select(c).where(F.col(c).isNotNull()).distinct()
        codes = ordinal(vals, [c]).withColumnRenamed("_idx", f"{c}_encoded")
        out = out.join(codes, c, "left").withColumn(
            f"{c}_encoded", F.coalesce(F.col(f"{c}_encoded"), F.lit(-1)))
    return out


def ordinal(df: DataFrame, order_cols) -> DataFrame:
    """0-based position of every row in ``order_cols`` order (ties must be broken
    by the caller), without a global window: rows are range-partitioned and
    sorted, tagged with partition id and a per-partition increasing id, and a
    small per-partition count table gives each partition's offset.  The tagged
    rows are checkpointed so both uses see the same partitioning."""
    from pyspark.sql import Window

    from orderlab.session import cut_lineage
    tagged = cut_lineage(df.orderBy(*order_cols)
                         .withColumn("_pos", F.monotonically_increasing_id())
                         .withColumn("_pid", F.spark_partition_id()))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_p0"))
    # one row per partition
    offs = counts.select("_pid", "_p0", F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_off"))
    return (tagged.join(F.broadcast(offs), "_pid")
            .withColumn("_idx", F.coalesce(F.col("_off"), F.lit(0)) + F.col("_pos") - F.col("_p0"))
            .drop("_pos", "_pid", "_p0", "_off"))


def split_by_years(groups: DataFrame, train_years, test_years):
    """M1/P5: chronological split by configured years (two filters)."""
    return (groups.filter(F.col("year").isin(*train_years)),
            groups.filter(F.col("year").isin(*test_years)))


def positional_split(df: DataFrame, order_cols, train_share: float = 0.8):
    """First ``int(n * train_share)`` rows in ``order_cols`` order -> train.

    Positions come from ``ordinal`` (no global window); ties in ``order_cols``
    must be broken by the caller for a deterministic split."""
    idx = ordinal(df, order_cols)
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (idx.crossJoin(F.broadcast(total))
            .withColumn("is_train", F.col("_idx") < (F.col("_total") * train_share).cast("bigint"))
            .drop("_idx", "_total"))


def size_features(groups: DataFrame, first_period_years) -> DataFrame:
    """T8-T10 + M3: size group, ordinal ranks, lifecycle year, one-hot flags."""
    return groups.select(
        "*",
        R.size_group_col(F.col("size")).alias("size_group"),
        R.size_rank_col(F.col("size")).alias("size_rank"),
        R.season_num_col(F.col("season")).alias("season_num"),
        R.lifecycle_year_col(F.col("year"), first_period_years).alias("lifecycle_year"),
    ).select(
        "*",
        (F.col("size_group") == "youth").cast("int").alias("is_youth"),
        (F.col("size_group") == "women").cast("int").alias("is_women"),
        (F.col("product_category") == "top").cast("int").alias("is_top"),
        (F.col("product_category") == "bottom").cast("int").alias("is_bottom"),
        (F.col("product_category") == "socks").cast("int").alias("is_socks"),
    )


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def feature_columns(df: DataFrame, exclude=("demand", "year"), keys=()) -> list:
    """M2: numeric columns that are not the target, year or raw keys."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in set(exclude) | set(keys)]


def feature_table(df: DataFrame, exclude=("demand", "year"), keys=()) -> DataFrame:
    """M2: the feature columns with NULL -> 0, plus the target."""
    cols = feature_columns(df, exclude, keys)
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols],
                     F.col("demand").cast("double").alias("demand"))


def standardize(train: DataFrame, other: DataFrame, cols) -> DataFrame:
    """M4: (x - mean_train) / std_pop_train (std 0 -> 1), one aggregate on train."""
    stats = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                      *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = other.crossJoin(F.broadcast(stats))
    return j.select(*[c for c in other.columns if c not in cols],
                    *[((F.col(c) - F.col(f"_m_{c}")) /
                       F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))).alias(c)
                      for c in cols])
