"""Problem configuration: cost items, budget and MOQ (S2, cfg).

The configuration is a handful of rows (costs, constraints).  It lives on the
driver as plain Python and enters plans as small broadcast DataFrames.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default cost structure (name, value, product_category, period),
# budget per season and minimum order quantity per size of the default config.
DEFAULT_COST_ITEMS = [
    ("unit_cost", 25.0, "top", None),
    ("overage_cost", 5.0, "top", 1),
    ("overage_cost", 15.0, "top", 2),
    ("underage_cost", 12.0, "top", 1),
    ("underage_cost", 60.0, "top", 2),
    ("unit_cost", 16.0, "bottom", None),
    ("overage_cost", 3.0, "bottom", 1),
    ("overage_cost", 8.0, "bottom", 2),
    ("underage_cost", 8.0, "bottom", 1),
    ("underage_cost", 25.0, "bottom", 2),
    ("unit_cost", 10.0, "socks", None),
    ("overage_cost", 1.0, "socks", None),
    ("underage_cost", 5.0, "socks", None),
]
DEFAULT_BUDGET = 40000.0
DEFAULT_MOQ = 6

# Alternative cost names tried last by the optimiser look-up.
COST_ALIASES = {
    "unit_cost": ["purchase_cost", "cost_per_unit", "base_cost"],
    "purchase_cost": ["unit_cost", "cost_per_unit", "base_cost"],
    "overage_cost": ["overstock_cost", "excess_cost", "surplus_cost"],
    "underage_cost": ["stockout_cost", "shortage_cost", "backorder_cost"],
}
# Parameter keys recognised for the budget and the MOQ (Q14: documented alias list).
BUDGET_KEYS = ["budget_usd", "budget", "max_spend", "max_budget"]
MOQ_KEYS = ["moq_per_size", "moq", "min_qty", "minimum"]

COST_SCHEMA = "ord int, name string, value double, product_category string, period int"


@dataclass
class ProblemConfig:
    cost_items: list = field(default_factory=lambda: list(DEFAULT_COST_ITEMS))
    budget: float = DEFAULT_BUDGET
    moq: int = DEFAULT_MOQ

    def cost_table(self, spark: SparkSession) -> DataFrame:
        """Cost rows with their list position (``ord``), the tie-break of every look-up."""
        rows = [(i, n, float(v), c, None if p is None else int(p)) for i, (n, v, c, p) in enumerate(self.cost_items)]
        return spark.createDataFrame(rows, COST_SCHEMA)

    def cost_values_sql(self) -> str:
        def lit(x):
            return "NULL" if x is None else (f"'{x}'" if isinstance(x, str) else repr(x))
        rows = ", ".join(f"({i}, '{n}', {float(v)!r}, {lit(c)}, {lit(p)})"
                         for i, (n, v, c, p) in enumerate(self.cost_items))
        return f"(SELECT * FROM (VALUES {rows}) AS t(ord, name, value, product_category, period))"


def _budget_from(constraints: list) -> float:
    for c in constraints:
        if "budget" in str(c.get("name", "")).lower():
            for k in BUDGET_KEYS:
                if k in (c.get("parameters") or {}):
                    return float(c["parameters"][k])
    return float("inf")


def _moq_from(constraints: list) -> int:
    for c in constraints:
        n = str(c.get("name", "")).lower()
        if "minimum" in n or "moq" in n:
            for k in MOQ_KEYS:
                if k in (c.get("parameters") or {}):
                    return int(c["parameters"][k])
    return 0


def config_from_dict(d: dict) -> ProblemConfig:
    """Cost items accept ``period`` or ``lifecycle_year`` (Q1); budget/MOQ from constraints."""
    items = []
    for it in d.get("cost_structure", []):
        period = it.get("period", it.get("lifecycle_year"))
        items.append((it["name"], float(it["value"]), it.get("product_category"),
                      None if period is None else int(period)))
    cons = d.get("constraints", [])
    return ProblemConfig(items or list(DEFAULT_COST_ITEMS), _budget_from(cons), _moq_from(cons))


def load_config(path: str) -> ProblemConfig:
    """S2 (driver side): a JSON config file -> ProblemConfig."""
    with open(path, encoding="utf-8") as f:
        return config_from_dict(json.load(f))


def config_json(cfg: ProblemConfig) -> str:
    """The JSON text that ``load_config`` and ``read_cost_structure`` read back."""
    items = [{"name": n, "value": float(v), "product_category": c, "lifecycle_year": p} for n, v, c, p in cfg.cost_items]
    return json.dumps({"cost_structure": items, "constraints": [
        {"name": "season budget", "parameters": {"budget_usd": cfg.budget}},
        {"name": "minimum order", "parameters": {"moq_per_size": cfg.moq}}]})


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    """S2 (Spark side): JSON config(s) -> one row (budget, moq) per file; the first key of the
    alias lists that a matching constraint holds, else no budget limit and MOQ 0."""
    par = "map<string,double>"
    raw = spark.read.schema(f"constraints array<struct<name:string,parameters:{par}>>").option("multiLine", True).json(path)

    def value(match, keys):
        # per matching constraint the first known key; then the first constraint that has one
        found = F.transform(F.filter("constraints", lambda c: F.lower(c["name"]).rlike(match)),
                            lambda c: F.coalesce(*[c["parameters"][k] for k in keys]))
        return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))
    return raw.select(F.coalesce(value("budget", BUDGET_KEYS), F.lit(float("inf"))).alias("budget"),
                      F.coalesce(value("minimum|moq", MOQ_KEYS), F.lit(0.0)).cast("int").alias("moq"))


def read_cost_structure(spark: SparkSession, path: str) -> DataFrame:
    """S2 (Spark side): JSON config(s) -> cost rows, ``lifecycle_year`` accepted as ``period``."""
    raw = spark.read.option("multiLine", True).json(path)
    items = raw.select(F.posexplode("cost_structure").alias("ord", "it"))
    fields = items.schema["it"].dataType.fieldNames()
    period = F.coalesce(*[F.col(f"it.{f}").cast("int") for f in ("period", "lifecycle_year") if f in fields]) \
        if any(f in fields for f in ("period", "lifecycle_year")) else F.lit(None).cast("int")
    return items.select(F.col("ord").cast("int"), F.col("it.name").alias("name"),
                        F.col("it.value").cast("double").alias("value"),
                        F.col("it.product_category").alias("product_category"), period.alias("period"))
