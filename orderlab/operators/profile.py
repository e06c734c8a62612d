"""Data profiling and verification.

Column-wise statistics over many columns go through one ``unpivot`` to
(column, value) so every column shares a single shuffle.  Per-column top-k
never sorts a whole column in one task: values are first ranked inside
(column, hash bucket) window partitions, and only the k best of each bucket
reach the final per-column ranking (at most ``buckets * k`` rows per column).
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlab.session import checkpoint_dir

TOPK_BUCKETS = 256

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)


def type_family(dt: T.DataType) -> str:
    """Engine-neutral type family used in reports."""
    if isinstance(dt, _INTS):
        return "integer"
    if isinstance(dt, _FLOATS):
        return "float"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.ArrayType):
        return "array"
    return dt.simpleString()


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, _INTS + _FLOATS)


def as_text(df: DataFrame, c: str):
    """Value rendered as text (for cross-column comparison)."""
    dt = df.schema[c].dataType
    col = F.col(f"`{c}`")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    if isinstance(dt, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(dt, T.ArrayType):
        return F.to_json(col)
    return col.cast("string")


def long_values(df: DataFrame, cols=None) -> DataFrame:
    """(column, value) pairs of the given columns, value as text; NULLs kept."""
    cols = cols or df.columns
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), as_text(df, c).alias("value")) for c in cols])).alias("kv")
    ).select("kv.column", "kv.value")


def manifest(df: DataFrame, table: str) -> DataFrame:
    """Rows, columns, type family and NULL count per column, one aggregate."""
    fields = df.schema.fields
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"_n{i}") for i, f in enumerate(fields)])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"),
                 F.lit(type_family(f.dataType)).alias("dtype"), F.col("_rows").alias("rows"),
                 F.col(f"_n{i}").alias("nulls"))
        for i, f in enumerate(fields)])).alias("m")).select("m.*")


def top_k_per_group(counts: DataFrame, group: str, order_cols: list, k: int,
                    key: str = "value", buckets: int = TOPK_BUCKETS) -> DataFrame:
    """Top ``k`` rows per ``group`` by ``order_cols`` with a two-level ranking."""
    b = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets))
    w1 = Window.partitionBy(group, "_b").orderBy(*order_cols)
    w2 = Window.partitionBy(group).orderBy(*order_cols)
    return (counts.withColumn("_b", b).withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
            .withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k).drop("_b", "_r"))


def value_counts(df: DataFrame, cols) -> DataFrame:
    """Count per (column, value), NULL values left out, all columns in one shuffle."""
    return (long_values(df, cols).filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))


def top_values(df: DataFrame, cols, k: int = 5) -> DataFrame:
    """O3/D3: the ``k`` most frequent values per column, ties by value."""
    vc = value_counts(df, cols)
    return top_k_per_group(vc, "column", [F.col("count").desc(), F.col("value")], k)


def column_profile(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Per column count, NULLs, distinct values, min/max/mean.

    Numeric min/max/mean are numbers; other columns report min/max as text.
    Distinct counts come from the (column, value) table: one shuffle for all;
    ``approx_distinct=True`` uses HyperLogLog sketches in the same single
    aggregate instead (no (column, value) shuffle)."""
    fields = df.schema.fields
    stats = df.agg(*[F.struct(
        F.lit(f.name).alias("column"), F.lit(type_family(f.dataType)).alias("dtype"),
        F.count(F.col(f"`{f.name}`")).alias("count"),
        F.count_if(F.col(f"`{f.name}`").isNull()).alias("nulls"),
        (F.min(F.col(f"`{f.name}`")).cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")).alias("min_num"),
        (F.max(F.col(f"`{f.name}`")).cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")).alias("max_num"),
        (F.avg(F.col(f"`{f.name}`")) if is_numeric(f.dataType) else F.lit(None).cast("double")).alias("mean_num"),
        (F.lit(None).cast("string") if is_numeric(f.dataType) else F.min(as_text(df, f.name))).alias("min_text"),
        (F.lit(None).cast("string") if is_numeric(f.dataType) else F.max(as_text(df, f.name))).alias("max_text"),
    ).alias(f"s{i}") for i, f in enumerate(fields)])
    long = stats.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(fields))])).alias("s")).select("s.*")
    if approx_distinct:
        hll = df.agg(*[F.approx_count_distinct(as_text(df, f.name)).alias(f"h{i}") for i, f in enumerate(fields)])
        d = hll.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"h{i}").alias("distinct"))
                                             for i, f in enumerate(fields)])).alias("d")).select("d.*")
        return long.join(d, "column", "left")
    distinct = (long_values(df).filter(F.col("value").isNotNull()).distinct()
                .groupBy("column").agg(F.count(F.lit(1)).alias("distinct")))
    return (long.join(distinct, "column", "left")
            .withColumn("distinct", F.coalesce(F.col("distinct"), F.lit(0))))


def unique_values(df: DataFrame, col: str, cap: int = 50) -> DataFrame:
    """The first ``cap`` distinct values in text order plus the distinct total.

    ``orderBy().limit()`` runs as a per-partition top-k merge (bounded memory).
    """
    vals = df.select(as_text(df, col).alias("value")).filter(F.col("value").isNotNull()).distinct()
    total = vals.agg(F.count(F.lit(1)).alias("total_distinct"))
    firsts = vals.orderBy("value").limit(cap)
    return firsts.crossJoin(F.broadcast(total)).select(
        "value", "total_distinct", F.lit(cap).alias("cap"),
        (F.col("total_distinct") > cap).alias("truncated"))


def type_consistency(inp: DataFrame, out: DataFrame) -> DataFrame:
    """Per shared column, whether a numeric (or date/timestamp) input column
    lost its type in the output.  Schema only, plus the share of output text
    values that do not parse as numbers when an input number became text."""
    shared = [c for c in inp.columns if c in out.columns]
    rows = []
    checks = []
    for c in shared:
        ti, to = inp.schema[c].dataType, out.schema[c].dataType
        fi, fo = type_family(ti), type_family(to)
        lost = (is_numeric(ti) and not is_numeric(to)) or (fi in ("date", "timestamp") and fo not in ("date", "timestamp"))
        rows.append((c, fi, fo, bool(lost)))
        if is_numeric(ti) and isinstance(to, T.StringType):
            checks.append(F.struct(F.lit(c).alias("column"),
                                   F.avg(F.col(f"`{c}`").try_cast("double").isNull().cast("double")
                                         ).alias("unparsable_share")))
    spark = inp.sparkSession
    base = spark.createDataFrame(rows, "column string, in_type string, out_type string, type_lost boolean")
    if not checks:
        return base.withColumn("unparsable_share", F.lit(None).cast("double"))
    shares = out.agg(F.array(*checks).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return base.join(shares, "column", "left")


def no_fabrication(inp: DataFrame, out: DataFrame, samples: int = 5) -> DataFrame:
    """Per shared column, output values (as text) absent from the input,
    with the ``samples`` smallest of them.  Derived (non-shared) columns are
    not checked."""
    shared = [c for c in inp.columns if c in out.columns]
    vin = long_values(inp, shared).filter(F.col("value").isNotNull()).distinct()
    vout = long_values(out, shared).filter(F.col("value").isNotNull()).distinct()
    fab = vout.join(vin, ["column", "value"], "left_anti")
    cnt = fab.groupBy("column").agg(F.count(F.lit(1)).alias("fabricated"))
    smallest = top_k_per_group(fab, "column", [F.col("value")], samples)
    sample = smallest.groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_list("value")), "|").alias("samples"))
    return cnt.join(sample, "column")


def domain_check(df: DataFrame, domains: dict) -> DataFrame:
    """Values of each configured column outside its allowed domain, with line counts.

    The domain table is a fixed configuration list (bounded), broadcast into a
    left-anti join."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(c, v) for c, vs in domains.items() for v in vs], "column string, value string")
    vc = value_counts(df, list(domains))
    return vc.join(F.broadcast(dom), ["column", "value"], "left_anti").withColumnRenamed("count", "lines")


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Exact duplicate rows (copies beyond the first) and their share, nothing dropped.

    Rows are written once with a 64-bit hash (positional column names) in the checkpoint
    folder and grouped by the hash alone; a row whose hash comes once is distinct, and only
    rows whose hash repeats are compared in full."""
    spark = df.sparkSession
    x = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    x = x.select(*[f.name for f in x.schema.fields if not isinstance(f.dataType, T.NullType)])  # a void column tells nothing apart
    cols = x.columns
    x = x.withColumn("_h", F.xxhash64(*[f.name for f in x.schema.fields if "map<" not in f.dataType.simpleString()]))
    path = f"{checkpoint_dir(spark).rstrip('/')}/rows-{uuid4().hex}"
    x.write.parquet(f"{path}/all")
    kept = spark.read.schema(x.schema).parquet(f"{path}/all")
    # written, so that the size of what repeats is known before whole rows would be shuffled
    kept.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").write.parquet(f"{path}/repeated")
    repeated = spark.read.schema("_h long, _n long").parquet(f"{path}/repeated")
    kinds = kept.join(repeated.select("_h"), "_h", "left_semi").groupBy("_h", *cols).agg(F.count(F.lit(1)).alias("_n"))
    one = (kept.agg(F.nullif(F.count(F.lit(1)), F.lit(0)).alias("rows"))
           .crossJoin(repeated.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_again")))
           .crossJoin(kinds.agg(F.count(F.lit(1)).alias("_kinds"))))
    distinct = F.coalesce(F.col("rows") - F.col("_again") + F.col("_kinds"), F.lit(0))
    return one.select("rows", distinct.alias("distinct_rows"), (F.col("rows") - distinct).alias("duplicate_rows")).select(
        "*", F.when(F.col("rows") > 0, F.col("duplicate_rows") / F.col("rows")).otherwise(0.0).alias("duplicate_share"))


def key_redundancy(df: DataFrame, keys) -> DataFrame:
    """Does key a determine key b?  Distinct counts of a and of (a, b)
    for every ordered pair, computed on the distinct key combinations (one
    partial-aggregated shuffle), then one small aggregate."""
    combos = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    pairs = [(a, b) for a in keys for b in keys if a != b]
    agg = combos.agg(*[F.count_distinct(F.col(a)).alias(f"d_{a}") for a in keys],
                     # NULL is a value of b: pairs count whenever a is present
                     *[F.count_distinct(F.when(F.col(a).isNotNull(), F.struct(F.col(a), F.col(b))))
                       .alias(f"d_{a}__{b}") for a, b in pairs])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("key_a"), F.lit(b).alias("key_b"), F.col(f"d_{a}").alias("distinct_a"),
                 F.col(f"d_{a}__{b}").alias("distinct_ab"))
        for a, b in pairs])).alias("p")).select(
        "p.*", (F.col("p.distinct_a") == F.col("p.distinct_ab")).alias("a_determines_b"))


def sample_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows (a preview; the limit is the feature)."""
    return df.limit(n)


def verified_transform(inp: DataFrame, fn: Callable[[DataFrame], DataFrame]):
    """run a user transform, then the type, fabrication and row-count checks.

    Returns (output, findings) where findings has one row per problem:
    (check, column, detail)."""
    out = inp.transform(fn)
    tc = type_consistency(inp, out).filter("type_lost").select(
        F.lit("type").alias("check"), "column",
        F.concat_ws(" -> ", "in_type", "out_type").alias("detail"))
    fab = no_fabrication(inp, out).select(
        F.lit("fabrication").alias("check"), "column",
        F.concat(F.col("fabricated").cast("string"), F.lit(" new values: "), F.col("samples")).alias("detail"))
    rows = inp.agg(F.count(F.lit(1)).alias("a")).crossJoin(out.agg(F.count(F.lit(1)).alias("b")))
    drop = rows.filter(F.col("b") < F.col("a") * 0.5).select(
        F.lit("row_drop").alias("check"), F.lit(None).cast("string").alias("column"),
        F.concat(F.col("a").cast("string"), F.lit(" -> "), F.col("b").cast("string")).alias("detail"))
    return out, tc.unionByName(fab).unionByName(drop)
