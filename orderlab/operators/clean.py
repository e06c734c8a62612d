"""Cleaning of storefront order lines (P1-P16, T1-T6) and the row-drop audit.

One narrow pipeline: every step is a projection or a filter, so the whole
cleaning runs in a single stage without a shuffle.  The reference's global sort
by date is not applied (it would add a range shuffle for presentation only);
``write_clean_lines`` sorts within partitions at write time instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlab.functions import rules as R

CLEAN_COLUMNS = ["order_id", "order_date", "season", "year", "uniform_set",
                 "product_category", "gender_age", "size", "color", "number",
                 "quantity", "unit_price"]

RAW = {"order_id": "Order ID", "created_at": "Created at", "status": "Financial Status",
       "name": "Lineitem name", "variant": "Lineitem variant",
       "quantity": "Lineitem quantity", "price": "Lineitem price"}


def _is_string(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def parsed_timestamp(df: DataFrame, c: str) -> Column:
    """Text with an offset -> UTC timestamp (bad text -> NULL); timestamps pass."""
    return F.try_to_timestamp(F.col(c)) if _is_string(df, c) else F.col(c).cast("timestamp")


# Plain or scientific decimal numbers; a Java cast would also take suffixes like ``5d``.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _number(df: DataFrame, c: str) -> Column:
    """Finite double of a numeric or text column, else NULL."""
    x = F.col(c).cast("double")
    if _is_string(df, c):
        x = F.when(F.col(c).rlike(NUMBER_TEXT), F.trim(F.regexp_replace(c, r"\s", "")).try_cast("double"))
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def coerce_quantity(df: DataFrame, c: str) -> Column:
    """P10: unparsable, non-finite or out-of-range quantity -> 1, else truncated to an
    integer."""
    return F.coalesce(_number(df, c).try_cast("int"), F.lit(1))


def coerce_price(df: DataFrame, c: str) -> Column:
    """P10: unparsable or non-finite price -> NULL."""
    return _number(df, c)


def require_columns(df: DataFrame, required) -> None:
    """Metadata-only check, error names the missing columns."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def with_line_fields(raw: DataFrame, category_rules: R.CategoryRules = R.REFERENCE_CATEGORY_RULES,
                     size_phrases: list | None = None) -> DataFrame:
    """Adds the parsed fields to raw lines without filtering (shared by clean and audit)."""
    require_columns(raw, RAW.values())
    ts = parsed_timestamp(raw, RAW["created_at"])
    # lowered texts projected once; the rule cascades test them many times
    x = raw.select("*", ts.alias("_ts"),
                   F.lower(F.col(RAW["name"])).alias("_name_low"),
                   F.lower(F.col(RAW["variant"])).alias("_var_low"),
                   F.lower(F.regexp_replace(F.col(RAW["variant"]), r"^\s+|\s+$", "")).alias("_var_lt"))
    return x.select("*", F.month("_ts").alias("_month"),
                    R.classify_product_col(F.col(RAW["name"]), category_rules, F.col("_name_low")).alias("_category"))


def clean_order_lines(raw: DataFrame, category_rules: R.CategoryRules = R.REFERENCE_CATEGORY_RULES,
                      size_phrases: list | None = None) -> DataFrame:
    """Raw storefront lines -> the 12 clean columns.

    Lines whose timestamp does not parse cannot carry a year (Q6); they are
    dropped here and counted by ``clean_audit``.
    """
    x = with_line_fields(raw, category_rules, size_phrases)
    name, variant = F.col(RAW["name"]), F.col(RAW["variant"])
    month = F.col("_month")
    x = (x.filter(F.col(RAW["status"]) == "PAID")            # P1 (exact, case-sensitive)
          .filter(name.isNotNull())                          # P2
          .filter(F.col("_category").isNotNull())            # P3
          .filter(F.col("_ts").isNotNull()))                 # Q6 reject
    is_top = F.col("_category") == "top"
    return x.select(
        F.col(RAW["order_id"]).cast("bigint").alias("order_id"),       # P16 strict cast
        F.to_date(F.col("_ts")).alias("order_date"),
        R.season_col(month).alias("season"),                            # P12
        F.year(F.col("_ts")).alias("year"),
        R.uniform_set_col(name, month, F.col("_name_low")).alias("uniform_set"),            # T2
        F.col("_category").alias("product_category"),                   # T1
        R.gender_age_col(name, F.col("_name_low")).alias("gender_age"),                     # T3
        R.size_col(variant, size_phrases, F.col("_var_lt")).alias("size"),                # T4
        F.when(is_top, R.color_col(name, F.col("_name_low"))).alias("color"),               # T5 / P13
        F.when(is_top, R.number_col(variant, F.col("_var_low"))).alias("number"),          # T6 / P13
        coerce_quantity(x, RAW["quantity"]).alias("quantity"),          # P10
        coerce_price(x, RAW["price"]).alias("unit_price"),              # P10
    )


def clean_audit(raw: DataFrame, category_rules: R.CategoryRules = R.REFERENCE_CATEGORY_RULES,
                drop_flag_share: float = 0.5) -> DataFrame:
    """Rows left after each cleaning step, in one pass (one aggregate).

    Output (long form): step_no, step, rows_after, dropped, drop_share, flagged
    (a step that drops more than ``drop_flag_share`` of its input).
    """
    x = with_line_fields(raw, category_rules)
    paid = F.col(RAW["status"]) == "PAID"
    named = paid & F.col(RAW["name"]).isNotNull()
    classified = named & F.col("_category").isNotNull()
    dated = classified & F.col("_ts").isNotNull()
    steps = [("raw", F.lit(True)), ("paid", paid), ("named", named),
             ("classified", classified), ("dated", dated)]
    counts = x.agg(*[F.count_if(c).alias(f"n{i}") for i, (_, c) in enumerate(steps)])
    stack = ", ".join(f"{i}, '{s}', n{i}, n{max(i - 1, 0)}" for i, (s, _) in enumerate(steps))
    long = counts.selectExpr(f"stack({len(steps)}, {stack}) AS (step_no, step, rows_after, rows_before)")
    return long.select(
        F.col("step_no").cast("bigint").alias("step_no"), "step",
        F.col("rows_after").cast("bigint").alias("rows_after"),
        (F.col("rows_before") - F.col("rows_after")).cast("bigint").alias("dropped"),
        F.round(F.try_divide(F.col("rows_before") - F.col("rows_after"), F.col("rows_before")), 4)
         .alias("drop_share"),
        (F.try_divide(F.col("rows_before") - F.col("rows_after"), F.col("rows_before"))
         > F.lit(drop_flag_share)).alias("flagged"),
    )


def normalize_strings(df: DataFrame) -> DataFrame:
    """Trim (all white space, tabs and line ends too) + lower every string column,
    driven by the schema."""
    return df.select(*[F.lower(F.regexp_replace(F.col(f.name), r"(?U)^\s+|\s+$", "")).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name)
                       for f in df.schema.fields])


def drop_nonpositive_target(df: DataFrame, target: str) -> DataFrame:
    """Drop null and non-positive targets."""
    return df.filter(F.col(target).isNotNull() & (F.col(target) > 0))


def drop_and_report(df: DataFrame, target: str) -> tuple[DataFrame, Observation]:
    """P4 with its count: the filtered rows and an Observation of ``rows``, ``null_target`` and
    ``nonpositive``.  They are counted in the pass that computes the rows, not in one of their
    own; the values can be read once an action on the rows has run."""
    seen = Observation()
    t = F.col(target)
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(t.isNull()).alias("null_target"),
                     F.count_if(t <= 0).alias("nonpositive"))
    return drop_nonpositive_target(out, target), seen


def write_clean_lines(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S3 + O1: partitioned by year, sorted by (order_date, order_id) inside files.

    No repartition by year (that would send a whole year to one task); every
    task writes its own sorted file per year directory.
    """
    w = df.sortWithinPartitions("year", "order_date", "order_id").write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).partitionBy("year").csv(path)
    else:
        w.partitionBy("year").parquet(path)
