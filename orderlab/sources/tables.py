"""Scans of the driver tables and the adapter to raw order lines (S1, SURVEY 7.3).

The driver's TPC-H-style tables stand in for a storefront export.  The adapter
joins line items to their order, part and customer and renders the columns the
export would carry (order id, timestamp, payment status, product name, variant
text, quantity, price).  The cleaning operators then run their text rules on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlab.functions.rules import DEFAULT_SIZES, SIZE_PHRASES, CategoryRules

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Category table for the test catalogue: products are named "<adjective> <noun>".
# Anvils are excluded, as practice gear is in the storefront rules.
CATALOG_RULES = CategoryRules(
    exclude=["anvil"],
    ordered=[("socks", ["ring", "bolt"]), ("bottom", ["rod", "gear"]),
             ("top", ["plate", "widget", "gizmo"])],
)

# Train years and the two test years of the adapted data (orders run 1995-2001).
TRAIN_YEARS = [1995, 1996, 1997, 1998, 1999]
TEST_YEARS = [2000, 2001]

RAW_COLUMNS = ["Order ID", "Created at", "Financial Status", "Lineitem name",
               "Lineitem variant", "Lineitem quantity", "Lineitem price"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _first_phrase_by_code() -> dict:
    out = {}
    for phrase, code in SIZE_PHRASES:
        out.setdefault(code, phrase.title())
    return out


def _variant_col(partkey: Column, brand: Column, psize: Column) -> Column:
    """Variant text in five storefront styles, chosen by part key."""
    code = F.element_at(F.array(*[F.lit(s) for s in DEFAULT_SIZES]),
                        (F.pmod(psize, F.lit(len(DEFAULT_SIZES))) + 1).cast("int"))
    phrases = _first_phrase_by_code()
    phrase = F.element_at(F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv]), code)
    form = F.pmod(partkey, F.lit(5))
    return (F.when(form == 0, F.concat(brand, F.lit("/"), code))
            .when(form == 1, F.concat(code, F.lit(" - #"), psize.cast("string")))
            .when(form == 2, F.lower(code))
            .when(form == 3, F.concat(brand, F.lit(", "), code, F.lit(", With Name & Number")))
            .otherwise(F.concat(phrase, F.lit(" / Navy"))))


def raw_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storefront-shaped order lines from lineitem x orders x part x customer.

    Only the needed columns are read (parquet column pruning).  Join strategy
    is left to AQE: part and customer become broadcast hash joins at runtime only
    when their measured size is under ``spark.sql.autoBroadcastJoinThreshold``;
    otherwise they stay sort-merge joins.  lineitem-orders is always a shuffle
    join on the order key (both sides grow with the data).  The customer's segment
    meets the orders first, so that lines are never shuffled by customer.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = (li.join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)
         .join(p, li.l_partkey == p.p_partkey))
    return j.select(
        F.col("o_orderkey").alias("Order ID"),
        F.col("o_orderdate").alias("Created at"),
        F.when(F.col("o_orderstatus") == "F", "PAID")
         .when(F.col("o_orderstatus") == "O", "PENDING")
         .otherwise("PARTIALLY_REFUNDED").alias("Financial Status"),
        F.concat(F.col("p_name"), F.lit(" - "),
                 F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Womens").otherwise("Mens/Youth")
                 ).alias("Lineitem name"),
        _variant_col(F.col("p_partkey"), F.col("p_brand"), F.col("p_size")).alias("Lineitem variant"),
        F.col("l_quantity").alias("Lineitem quantity"),
        F.col("p_retailprice").alias("Lineitem price"),
    )


def raw_order_lines_sql() -> str:
    """The adapter as DuckDB SQL (oracle side)."""
    sizes = ", ".join(f"'{s}'" for s in DEFAULT_SIZES)
    phrases = _first_phrase_by_code()
    phrase_case = "CASE " + " ".join(f"WHEN code = '{k}' THEN '{v}'" for k, v in phrases.items()) + " END"
    return f"""
      SELECT o_orderkey AS "Order ID", o_orderdate AS "Created at",
             CASE WHEN o_orderstatus = 'F' THEN 'PAID' WHEN o_orderstatus = 'O' THEN 'PENDING'
                  ELSE 'PARTIALLY_REFUNDED' END AS "Financial Status",
             p_name || ' - ' || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Womens' ELSE 'Mens/Youth' END
                 AS "Lineitem name",
             CASE WHEN p_partkey % 5 = 0 THEN p_brand || '/' || code
                  WHEN p_partkey % 5 = 1 THEN code || ' - #' || CAST(p_size AS VARCHAR)
                  WHEN p_partkey % 5 = 2 THEN lower(code)
                  WHEN p_partkey % 5 = 3 THEN p_brand || ', ' || code || ', With Name & Number'
                  ELSE {phrase_case} || ' / Navy' END AS "Lineitem variant",
             l_quantity AS "Lineitem quantity", p_retailprice AS "Lineitem price"
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN (SELECT *, ([{sizes}])[(p_size % {len(DEFAULT_SIZES)}) + 1] AS code FROM part) pp
             ON l_partkey = p_partkey
           JOIN customer ON o_custkey = c_custkey"""
