"""Inverse standard normal CDF as a column expression (Wichura, AS 241, PPND16).

Spark has no built-in normal quantile; this rational approximation (relative
error about 1e-16) is plain arithmetic, so it runs inside whole-stage codegen.
The same formula is emitted as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published AS 241 coefficients (numerator, denominator) of
# the central region and of the two tail regions.
_A = [3.3871328727963666080e0, 1.3314166789178437745e+2, 1.9715909503065514427e+3, 1.3731693765509461125e+4,
      4.5921953931549871457e+4, 6.7265770927008700853e+4, 3.3430575583588128105e+4, 2.5090809287301226727e+3]
_B = [1.0, 4.2313330701600911252e+1, 6.8718700749205790830e+2, 5.3941960214247511077e+3,
      2.1213794301586595867e+4, 3.9307895800092710610e+4, 2.8729085735721942674e+4, 5.2264952788528545610e+3]
_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
      1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
      1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
      2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
      7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]


def _horner(coefs, x):
    acc = None
    for c in reversed(coefs):
        acc = c if acc is None else acc * x + c
    return acc


def _horner_sql(coefs, x: str) -> str:
    acc = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        acc = f"(({acc}) * {x} + {c!r})"
    return acc


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile of p in (0, 1); NULL outside."""
    q = p - 0.5
    r_c = F.lit(0.180625) - q * q
    central = q * _horner(_A, r_c) / _horner(_B, r_c)
    tail_p = F.when(q < 0, p).otherwise(1.0 - p)
    r = F.sqrt(-F.log(tail_p))
    near = _horner(_C, r - 1.6) / _horner(_D, r - 1.6)
    far = _horner(_E, r - 5.0) / _horner(_F, r - 5.0)
    tail = F.when(r <= 5.0, near).otherwise(far)
    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(F.abs(q) <= 0.425, central)
            .when(q < 0, -tail).otherwise(tail))


def norm_ppf_sql(p: str) -> str:
    q = f"(({p}) - 0.5)"
    rc = f"(0.180625 - {q} * {q})"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1.0 - ({p}) END))"
    near = f"({_horner_sql(_C, f'({r} - 1.6)')} / {_horner_sql(_D, f'({r} - 1.6)')})"
    far = f"({_horner_sql(_E, f'({r} - 5.0)')} / {_horner_sql(_F, f'({r} - 5.0)')})"
    tail = f"(CASE WHEN {r} <= 5.0 THEN {near} ELSE {far} END)"
    return (f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL "
            f"WHEN abs({q}) <= 0.425 THEN {q} * {_horner_sql(_A, rc)} / {_horner_sql(_B, rc)} "
            f"WHEN {q} < 0 THEN -{tail} ELSE {tail} END)")
