"""Query registry: each query has a Spark builder, an output contract and,
where SQL can express it, a DuckDB oracle.

The output contract fixes column order and types (integers as bigint, money
and ratios as double rounded to 4 places) so the Spark result and the oracle
hash alike.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "bool": "BOOLEAN"}


@dataclass
class Query:
    name: str
    build: Callable
    cols: list            # [(name, kind)]
    sql: str | None = None
    ops: str = ""         # SURVEY ids covered


REGISTRY: dict[str, Query] = {}

# Per-build memo: a query that reaches the same materialised input through
# several helpers (e.g. the demand groups) computes it once.
BUILD_MEMO: ContextVar[dict | None] = ContextVar("orderlab_build_memo", default=None)


def memoized(key, make):
    memo = BUILD_MEMO.get()
    if memo is None:
        return make()
    if key not in memo:
        memo[key] = make()
    return memo[key]


def spec(s: str) -> list:
    """'a:long, b:double' -> [(a, long), (b, double)]."""
    out = []
    for part in s.split(","):
        n, k = part.strip().rsplit(":", 1)
        assert k in KINDS, k
        out.append((n.strip(), k))
    return out


def conform(df: DataFrame, cols: list) -> DataFrame:
    exprs = []
    for n, k in cols:
        c = F.col(f"`{n}`")
        if k == "long":
            c = c.cast("bigint")
        elif k == "double":
            c = F.round(c.cast("double"), 4) + F.lit(0.0)
        elif k == "string":
            c = c.cast("string")
        elif k == "date":  # ISO text: identical in every client library
            c = F.date_format(c.cast("date"), "yyyy-MM-dd")
        elif k == "bool":
            c = c.cast("boolean")
        exprs.append(c.alias(n))
    return df.select(*exprs)


def wrap_sql(sql: str, cols: list) -> str:
    sel = []
    for n, k in cols:
        q = f'"{n}"'
        if k == "double":
            sel.append(f"CAST(round(CAST({q} AS DOUBLE), 4) + 0.0 AS DOUBLE) AS {q}")
        elif k == "date":
            sel.append(f"strftime(CAST({q} AS DATE), '%Y-%m-%d') AS {q}")
        else:
            sel.append(f"CAST({q} AS {KINDS[k]}) AS {q}")
    return f"SELECT {', '.join(sel)} FROM (\n{sql}\n) AS _q"


def register(name: str, cols: str, sql: str | Callable | None = None, ops: str = ""):
    def deco(fn):
        c = spec(cols)

        def build(spark, sf_dir, _fn=fn, _c=c):
            token = BUILD_MEMO.set({})  # shared materialisations live for one query build
            try:
                return conform(_fn(spark, sf_dir), _c)
            finally:
                BUILD_MEMO.reset(token)

        s = sql() if callable(sql) else sql
        REGISTRY[name] = Query(name, build, c, wrap_sql(s, c) if s else None, ops)
        return fn
    return deco
