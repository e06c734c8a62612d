"""Shared inputs of the registered queries: clean lines from the driver tables
(Spark) and the same derivation as DuckDB CTEs (oracle)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlab.functions import rules as R
from orderlab.operators.clean import clean_order_lines
from orderlab.sources.tables import CATALOG_RULES, TEST_YEARS, TRAIN_YEARS, raw_order_lines, raw_order_lines_sql

TRAIN = TRAIN_YEARS
Y1, Y2 = TEST_YEARS
# Newsvendor settings of the backtest: co and cu as fractions of unit price.
CO_FRAC, CU_FRAC, MOQ = 0.70, 0.40, 6
CR = CU_FRAC / (CU_FRAC + CO_FRAC)
# Baseline / sensitivity multipliers (overage, underage) on unit price.
CO_MULT, CU_MULT = 1.0, 1.3


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_order_lines(raw_order_lines(spark, sf_dir), CATALOG_RULES)


def yrs(ys) -> str:
    return "(" + ", ".join(str(y) for y in ys) + ")"


def lines_cte() -> str:
    """`raw` and `lines` CTE bodies (without WITH)."""
    name, var = '"Lineitem name"', '"Lineitem variant"'
    return f"""raw AS ({raw_order_lines_sql()}),
    _parsed AS (SELECT *, CAST("Created at" AS TIMESTAMP) AS _ts, month(CAST("Created at" AS TIMESTAMP)) AS _month,
                {R.classify_product_sql(name, CATALOG_RULES)} AS _category FROM raw),
    lines AS (
      SELECT CAST("Order ID" AS BIGINT) AS order_id, CAST(_ts AS DATE) AS order_date,
             {R.season_sql('_month')} AS season, CAST(year(_ts) AS INTEGER) AS year,
             {R.uniform_set_sql(name, '_month')} AS uniform_set,
             _category AS product_category, {R.gender_age_sql(name)} AS gender_age,
             {R.size_sql(var)} AS size,
             CASE WHEN _category = 'top' THEN {R.color_sql(name)} END AS color,
             CASE WHEN _category = 'top' THEN {R.number_sql(var)} END AS number,
             CAST(trunc(coalesce(TRY_CAST("Lineitem quantity" AS DOUBLE), 1.0)) AS INTEGER) AS quantity,
             TRY_CAST("Lineitem price" AS DOUBLE) AS unit_price
      FROM _parsed
      WHERE "Financial Status" = 'PAID' AND "Lineitem name" IS NOT NULL
        AND _category IS NOT NULL AND _ts IS NOT NULL)"""


def groups_cte() -> str:
    """`groups`: demand and mean price per (year, season, category, gender, size)."""
    return """groups AS (
      SELECT year, season, product_category, gender_age, size,
             sum(quantity) AS demand, avg(unit_price) AS unit_price
      FROM lines WHERE year IS NOT NULL AND season IS NOT NULL AND product_category IS NOT NULL
        AND gender_age IS NOT NULL AND size IS NOT NULL
      GROUP BY ALL)"""


def with_lines(*ctes: str) -> str:
    parts = [lines_cte(), groups_cte(), *ctes]
    return "WITH " + ",\n    ".join(parts)
