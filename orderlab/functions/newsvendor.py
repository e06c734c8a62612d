"""Newsvendor cost expressions (N1) and the smooth surrogates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def over(q: Column, d: Column) -> Column:
    return F.greatest(q - d, F.lit(0.0))


def under(q: Column, d: Column) -> Column:
    return F.greatest(d - q, F.lit(0.0))


def nv_cost(q: Column, d: Column, co: Column, cu: Column) -> Column:
    """co*max(q-d,0) + cu*max(d-q,0)."""
    return co * over(q, d) + cu * under(q, d)


def nv_cost_sql(q: str, d: str, co: str, cu: str) -> str:
    return f"(({co}) * greatest(({q}) - ({d}), 0) + ({cu}) * greatest(({d}) - ({q}), 0))"


def softplus(z: Column, k: float) -> Column:
    """log(1+exp(k z))/k, written overflow-free: max(z,0) + log1p(exp(-|k z|))/k."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z * k))) / k


def sigmoid(z: Column, k: float) -> Column:
    """1/(1+exp(-k z)) with k z clipped to [-60, 60]."""
    kz = F.least(F.greatest(z * k, F.lit(-60.0)), F.lit(60.0))
    return 1.0 / (1.0 + F.exp(-kz))


def softplus_sql(z: str, k: float) -> str:
    return f"(greatest({z}, 0) + ln(1 + exp(-abs(({z}) * {k}))) / {k})"


def critical_ratio(co: Column, cu: Column) -> Column:
    """cu / (cu + co)."""
    return cu / (cu + co)


def order_up(x: Column, moq: int) -> Column:
    """ceil to whole units, then the MOQ floor; a zero quantity stays zero."""
    return F.when(x > 0, F.greatest(F.ceil(x), F.lit(moq).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def order_up_sql(x: str, moq: int) -> str:
    return f"CASE WHEN {x} > 0 THEN greatest(CAST(ceil({x}) AS BIGINT), {moq}) ELSE 0 END"
