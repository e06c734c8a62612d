"""Registered queries: profiling and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlab.functions import rules as R
from orderlab.operators import clean as C
from orderlab.operators import demand as D
from orderlab.operators import profile as P
from orderlab.plans.common import TRAIN, Y1, Y2, lines, with_lines, yrs
from orderlab.plans.registry import register
from orderlab.sources.tables import TABLES, raw_order_lines, table

# Type family of every column of the driver tables (fixed facts about the inputs).
TABLE_COLUMNS = {
    "region": [("r_regionkey", "integer"), ("r_name", "string")],
    "nation": [("n_nationkey", "integer"), ("n_name", "string"), ("n_regionkey", "integer")],
    "customer": [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"),
                 ("c_acctbal", "float"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "integer"), ("s_name", "string"), ("s_nationkey", "integer"), ("s_acctbal", "float")],
    "part": [("p_partkey", "integer"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "integer"), ("p_retailprice", "float")],
    "orders": [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"),
               ("o_totalprice", "float"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"),
                 ("l_linenumber", "integer"), ("l_quantity", "float"), ("l_extendedprice", "float"),
                 ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp")],
    "events": [("event_id", "integer"), ("ts", "timestamp"), ("user_id", "integer"), ("event_type", "string"),
               ("value", "float"), ("props", "string")],
    "documents": [("doc_id", "integer"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "integer")],
    "embeddings": [("vec_id", "integer"), ("embedding", "array"), ("label", "integer")],
    "pages": [("page_id", "integer"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "integer"), ("text", "string")],
    "labels": [("doc_id", "integer"), ("quality", "integer"), ("toxic", "integer")],
    "conversations": [("conv_id", "integer"), ("turn", "integer"), ("role", "string"), ("text", "string")],
}

RAW_TYPES = [("Order ID", "integer"), ("Created at", "timestamp"), ("Financial Status", "string"),
             ("Lineitem name", "string"), ("Lineitem variant", "string"), ("Lineitem quantity", "float"),
             ("Lineitem price", "float")]


def _txt(c: str, fam: str) -> str:
    q = f'"{c}"'
    if fam == "timestamp":
        return f"strftime({q}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({q} AS VARCHAR)"


def _long_sql(src: str, cols) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_txt(c, fam)} AS value FROM {src}" for c, fam in cols)


# ------------------------------------------------------------------ D1 manifest

def _manifest_sql() -> str:
    parts = []
    for t in TABLES:
        for i, (c, fam) in enumerate(TABLE_COLUMNS[t]):
            parts.append(f"SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS column_name, '{fam}' AS dtype, "
                         f"count(*) AS rows, count(*) - count({c}) AS nulls FROM {t}")
    return "\nUNION ALL ".join(parts)


@register("manifest", "table_name:string, ordinal:long, column_name:string, dtype:string, rows:long, nulls:long",
          _manifest_sql, ops="D1 D2")
def q_manifest(spark, sf_dir):
    out = None
    for t in TABLES:
        m = P.manifest(table(spark, sf_dir, t), t)
        out = m if out is None else out.unionByName(m)
    return out


# ------------------------------------------------------------------ profiles of the raw lines

def _raw_cte() -> str:
    return with_lines()


def _column_profile_sql() -> str:
    stats = []
    for c, fam in RAW_TYPES:
        if fam in ("integer", "float"):
            vals = (f'CAST(min("{c}") AS DOUBLE) AS min_num, CAST(max("{c}") AS DOUBLE) AS max_num, '
                    f'avg("{c}") AS mean_num, CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text')
        else:
            vals = (f"CAST(NULL AS DOUBLE) AS min_num, CAST(NULL AS DOUBLE) AS max_num, CAST(NULL AS DOUBLE) AS mean_num, "
                    f"min({_txt(c, fam)}) AS min_text, max({_txt(c, fam)}) AS max_text")
        stats.append(f"""SELECT '{c}' AS "column", '{fam}' AS dtype, count("{c}") AS count, """
                     f"""count(*) - count("{c}") AS nulls, {vals} FROM raw""")
    return (_raw_cte() + ", long AS (" + _long_sql("raw", RAW_TYPES) + "), "
            'dist AS (SELECT "column", count(DISTINCT value) AS distinct FROM long GROUP BY 1), '
            "stats AS (" + " UNION ALL ".join(stats) + ") "
            'SELECT s.*, coalesce(d.distinct, 0) AS distinct FROM stats s LEFT JOIN dist d USING ("column")')


@register("column_profile",
          "column:string, dtype:string, count:long, nulls:long, distinct:long, min_num:double, max_num:double, "
          "mean_num:double, min_text:string, max_text:string",
          _column_profile_sql, ops="A8 D3")
def q_column_profile(spark, sf_dir):
    return P.column_profile(raw_order_lines(spark, sf_dir))


STRING_RAW = ["Financial Status", "Lineitem name", "Lineitem variant"]


@register("top_values", "column:string, value:string, count:long, rank:long",
          lambda: _raw_cte() + ", long AS (" + _long_sql("raw", [(c, "string") for c in STRING_RAW]) + "), "
          "vc AS (SELECT \"column\", value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY ALL) "
          "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY count DESC, value) AS rank "
          "FROM vc) WHERE rank <= 5",
          ops="O3 D3")
def q_top_values(spark, sf_dir):
    return P.top_values(raw_order_lines(spark, sf_dir), STRING_RAW, 5)


VC_COLS = ["product_category", "uniform_set", "gender_age", "size", "color"]


@register("value_counts", "column:string, value:string, count:long",
          lambda: with_lines() + ", long AS (" + _long_sql("lines", [(c, "string") for c in VC_COLS]) + ") "
          "SELECT \"column\", value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY ALL",
          ops="A7")
def q_value_counts(spark, sf_dir):
    return P.value_counts(lines(spark, sf_dir), VC_COLS)


@register("unique_values", "value:string, total_distinct:long, cap:long, truncated:bool",
          lambda: _raw_cte() + """, v AS (SELECT DISTINCT "Lineitem variant" AS value FROM raw WHERE "Lineitem variant" IS NOT NULL),
              t AS (SELECT count(*) AS total_distinct FROM v)
              SELECT value, total_distinct, 50 AS cap, total_distinct > 50 AS truncated
              FROM (SELECT value FROM v ORDER BY value LIMIT 50), t""",
          ops="D4")
def q_unique_values(spark, sf_dir):
    return P.unique_values(raw_order_lines(spark, sf_dir), C.RAW["variant"], 50)


# ------------------------------------------------------------------ verification of a user transform

def user_transform(df: DataFrame) -> DataFrame:
    """Example user cleaning step checked by F1: trims and lowercases text (P9),
    drops non-positive quantities (P4) and renders the price as '$' text."""
    out = C.drop_nonpositive_target(C.normalize_strings(df), C.RAW["quantity"])
    return out.withColumn(C.RAW["price"], F.concat(F.lit("$"), F.col(f"`{C.RAW['price']}`").cast("string")))


def _transformed_sql() -> str:
    return """tr AS (SELECT "Order ID", "Created at", lower(trim("Financial Status")) AS "Financial Status",
                 lower(trim("Lineitem name")) AS "Lineitem name", lower(trim("Lineitem variant")) AS "Lineitem variant",
                 "Lineitem quantity", '$' || CAST("Lineitem price" AS VARCHAR) AS "Lineitem price"
                 FROM raw WHERE "Lineitem quantity" IS NOT NULL AND "Lineitem quantity" > 0)"""


@register("type_consistency", "column:string, in_type:string, out_type:string, type_lost:bool, unparsable_share:double",
          lambda: _raw_cte() + ", " + _transformed_sql() + " SELECT * FROM (VALUES "
          + ", ".join(f"('{c}', '{fam}', '{'string' if c == 'Lineitem price' else fam}', "
                      f"{'true' if c == 'Lineitem price' else 'false'})" for c, fam in RAW_TYPES)
          + ") AS s(\"column\", in_type, out_type, type_lost) LEFT JOIN (SELECT 'Lineitem price' AS \"column\", "
          "avg(CASE WHEN TRY_CAST(\"Lineitem price\" AS DOUBLE) IS NULL THEN 1.0 ELSE 0.0 END) AS unparsable_share "
          "FROM tr) u USING (\"column\")",
          ops="D5 P4 P9")
def q_type_consistency(spark, sf_dir):
    raw = raw_order_lines(spark, sf_dir)
    return P.type_consistency(raw, user_transform(raw))


@register("no_fabrication", "column:string, fabricated:long, samples:string",
          lambda: _raw_cte() + ", " + _transformed_sql() + ", lin AS (SELECT DISTINCT * FROM (" + _long_sql("raw", RAW_TYPES)
          + ") WHERE value IS NOT NULL), lout AS (SELECT DISTINCT * FROM (" + _long_sql("tr", RAW_TYPES)
          + """) WHERE value IS NOT NULL), fab AS (SELECT * FROM lout EXCEPT SELECT * FROM lin)
              SELECT "column", count(*) AS fabricated,
                     string_agg(CASE WHEN rn <= 5 THEN value END, '|' ORDER BY value) AS samples
              FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rn FROM fab) GROUP BY 1""",
          ops="D6 J10 U3")
def q_no_fabrication(spark, sf_dir):
    raw = raw_order_lines(spark, sf_dir)
    return P.no_fabrication(raw, user_transform(raw))


@register("verified_transform", "check:string, column:string, detail:string", None, ops="F1")
def q_verified_transform(spark, sf_dir):
    _, findings = P.verified_transform(raw_order_lines(spark, sf_dir), user_transform)
    return findings


DOMAINS = {"product_category": R.CATEGORIES, "size": R.DEFAULT_SIZES, "season": R.SEASONS,
           "gender_age": ["womens", "mens_youth"], "uniform_set": R.SEASONS + ["cfa"]}


@register("domain_check", "column:string, value:string, lines:long",
          lambda: with_lines() + ", long AS (" + _long_sql("lines", [(c, "string") for c in DOMAINS]) + "), "
          "dom AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{v}')" for c, vs in DOMAINS.items() for v in vs)
          + ") AS d(\"column\", value)) SELECT \"column\", value, count(*) AS lines FROM long "
          "WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dom WHERE dom.\"column\" = long.\"column\" "
          "AND dom.value = long.value) GROUP BY ALL",
          ops="D8")
def q_domain_check(spark, sf_dir):
    return P.domain_check(lines(spark, sf_dir), DOMAINS)


@register("duplicate_profile", "rows:long, distinct_rows:long, duplicate_rows:long, duplicate_share:double",
          lambda: with_lines() + """, g AS (SELECT count(*) AS n FROM lines GROUP BY ALL_COLUMNS_PLACEHOLDER)
              SELECT sum(n) AS rows, count(*) AS distinct_rows, sum(n - 1) AS duplicate_rows,
                     CASE WHEN sum(n) > 0 THEN sum(n - 1) / sum(n) ELSE 0.0 END AS duplicate_share FROM g""".replace(
              "ALL_COLUMNS_PLACEHOLDER", ", ".join(C.CLEAN_COLUMNS)),
          ops="D9")
def q_duplicate_profile(spark, sf_dir):
    return P.duplicate_profile(lines(spark, sf_dir))


@register("history_depth", "n_years:long, items:long",
          lambda: with_lines() + f""" SELECT n_years, count(*) AS items FROM (
              SELECT season, product_category, gender_age, size, count(DISTINCT year) AS n_years
              FROM groups WHERE year IN {yrs(TRAIN)} GROUP BY ALL) GROUP BY 1""",
          ops="A16 D12")
def q_history_depth(spark, sf_dir):
    return D.history_depth(D.demand_groups(lines(spark, sf_dir)), train_years=TRAIN)


KEYS = ["season", "product_category", "gender_age", "size"]


@register("dataset_metadata",
          "total_rows:long, demand_groups:long, train_groups:long, test_groups:long, train_years:string, "
          "test_years:string, season_values:string, product_category_values:string, gender_age_values:string, "
          "size_values:string, unknown_size_share:double, groups_over_200:bool",
          lambda: with_lines() + f""", l AS (SELECT count(*) AS total_rows,
                 {', '.join(f"array_to_string(list_sort(list_distinct(list({k}))), ',') AS {k}_values" for k in KEYS)},
                 avg(CASE WHEN size = 'UNKNOWN' THEN 1.0 ELSE 0.0 END) AS unknown_size_share FROM lines),
              g AS (SELECT count(*) AS demand_groups, count_if(year IN {yrs(TRAIN)}) AS train_groups,
                 count_if(year IN {yrs([Y1, Y2])}) AS test_groups,
                 array_to_string(list_sort(list_distinct(list(year) FILTER (WHERE year IN {yrs(TRAIN)}))), ',') AS train_years,
                 array_to_string(list_sort(list_distinct(list(year) FILTER (WHERE year IN {yrs([Y1, Y2])}))), ',') AS test_years
                 FROM groups)
              SELECT total_rows, demand_groups, train_groups, test_groups, train_years, test_years,
                     {', '.join(f'{k}_values' for k in KEYS)}, unknown_size_share, demand_groups > 200 AS groups_over_200
              FROM l, g""",
          ops="D13 D10 D12")
def q_dataset_metadata(spark, sf_dir):
    ln = lines(spark, sf_dir)
    g = D.demand_groups(ln)
    la = ln.agg(F.count(F.lit(1)).alias("total_rows"),
                *[F.array_join(F.array_sort(F.collect_set(k)), ",").alias(f"{k}_values") for k in KEYS],
                F.avg((F.col("size") == "UNKNOWN").cast("double")).alias("unknown_size_share"))
    tr, te = F.col("year").isin(*TRAIN), F.col("year").isin(Y1, Y2)
    ga = g.agg(F.count(F.lit(1)).alias("demand_groups"), F.count_if(tr).alias("train_groups"),
               F.count_if(te).alias("test_groups"),
               F.array_join(F.array_sort(F.collect_set(F.when(tr, F.col("year")))), ",").alias("train_years"),
               F.array_join(F.array_sort(F.collect_set(F.when(te, F.col("year")))), ",").alias("test_years"))
    return la.crossJoin(ga).withColumn("groups_over_200", F.col("demand_groups") > 200)


RED_KEYS = ["season", "uniform_set", "product_category", "gender_age", "size"]


@register("key_redundancy", "key_a:string, key_b:string, distinct_a:long, distinct_ab:long, a_determines_b:bool",
          lambda: with_lines() + ", combos AS (SELECT DISTINCT " + ", ".join(RED_KEYS) + " FROM lines) "
          + " UNION ALL ".join(
              f"SELECT '{a}' AS key_a, '{b}' AS key_b, count(DISTINCT {a}) AS distinct_a, "
              f"count(DISTINCT ({a}, {b})) FILTER (WHERE {a} IS NOT NULL) AS distinct_ab, "
              f"count(DISTINCT {a}) = count(DISTINCT ({a}, {b})) FILTER (WHERE {a} IS NOT NULL) "
              f"AS a_determines_b FROM combos"
              for a in RED_KEYS for b in RED_KEYS if a != b),
          ops="D14")
def q_key_redundancy(spark, sf_dir):
    return P.key_redundancy(lines(spark, sf_dir), RED_KEYS)


@register("sample_rows", "o_orderkey:long, o_orderstatus:string, o_totalprice:double", None, ops="O6")
def q_sample_rows(spark, sf_dir):
    return P.sample_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), 10)
