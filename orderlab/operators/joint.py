"""Model B (two periods, Year-1 surplus carried to Year 2): aligned inputs (B1),
exact joint objective (B2), smooth surrogate (B3), projection (B4), joint
order quantities (B5), repair (B6), carry-over (B7), spend checks (B8), Year-1
shadow price (B9) and the comparison with Model A (B10-B12, A17).

Per item the joint cost is piecewise linear in (q1, q2) with kinks on
q1 = D1_n, q2 = D2_n and q1 + q2 = D1_n + D2_n, so with budget duals
(l1, l2) the item problem is solved exactly on a small candidate set (at most
|A|*|B| + (|A|+|B|)*N points for N paired scenarios).  Candidates and their
costs are computed once and kept as an array on the item row; each dual round
is then a per-row ``array_min`` plus one small per-budget-key aggregate.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlab.functions.newsvendor import sigmoid, softplus
from orderlab.session import cut_lineage

COST_DIGITS = 9
HASH_PREFIX = 3    # hex digits of the md5 ranges of one cost
COST_RANGES = 256  # quantiles of a cost level
LAST = 2**31 - 1   # beyond every bucket


def two_test_years(items: DataFrame, year: str = "year") -> tuple[int, int]:
    """B1: the first two years of the test items; fewer are an error."""
    found = sorted(r[0] for r in items.select(year).distinct().collect() if r[0] is not None)  # one row per year
    if len(found) < 2:
        raise ValueError(f"two test years are needed, found {found}")
    return found[0], found[1]


def joint_items(y1: DataFrame, y2: DataFrame, keys, scen1: DataFrame, scen2: DataFrame,
                costs: DataFrame) -> DataFrame:
    """B1: Year-1 and Year-2 items aligned on ``keys`` (inner), with paired
    scenario arrays d1/d2 (ordered by scenario_id) and the cost vector
    (cu1 = underage Y1, co2 / cu2 = overage / underage Y2, unit cost).

    ``costs`` has product_category, period and the resolved cost columns."""
    def arr(s):
        return s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("scenario_id", "demand"))).alias("_s"))
    a1 = arr(scen1).select(*keys, F.transform("_s", lambda x: x["demand"]).alias("d1"))
    a2 = arr(scen2).select(*keys, F.transform("_s", lambda x: x["demand"]).alias("d2"))
    it = y1.select(*keys).join(y2.select(*keys), keys).join(a1, keys).join(a2, keys)

    def pick(period, name, alias):
        c = costs.filter(F.col("period").eqNullSafe(F.lit(period)) if period is not None
                         else F.col("period").isNull())
        return c.select(F.col("product_category").alias("_c"), F.col(name).alias(alias))
    for period, name, alias in [(1, "underage_cost", "cu1"), (2, "overage_cost", "co2"),
                                (2, "underage_cost", "cu2"), (None, "unit_cost", "unit_cost")]:
        p = pick(period, name, alias)
        it = (it.join(F.broadcast(p), it["product_category"].eqNullSafe(p["_c"]), "left").drop("_c"))
    return it


def _cols(c: Column | None, name: str) -> Column:
    return F.col(name) if c is None else c


def joint_cost(q1: Column, q2: Column, d1: Column | None = None, d2: Column | None = None,
               cu1: Column | None = None, co2: Column | None = None, cu2: Column | None = None) -> Column:
    """B2: mean over paired scenarios of cu1*(D1-q1)+ + co2*(q2+I-D2)+ + cu2*(D2-q2-I)+,
    I = (q1-D1)+ (no Year-1 overage term)."""
    d1, d2 = _cols(d1, "d1"), _cols(d2, "d2")
    cu1, co2, cu2 = _cols(cu1, "cu1"), _cols(co2, "co2"), _cols(cu2, "cu2")
    z = F.arrays_zip(d1.alias("a"), d2.alias("b"))

    def step(acc, p):
        inv = F.greatest(q1 - p["a"], F.lit(0.0))
        eff = q2 + inv
        return (acc + cu1 * F.greatest(p["a"] - q1, F.lit(0.0)) + co2 * F.greatest(eff - p["b"], F.lit(0.0))
                + cu2 * F.greatest(p["b"] - eff, F.lit(0.0)))
    return F.aggregate(z, F.lit(0.0), step) / F.size(d1)


def joint_smooth(q1: Column, q2: Column, k: float = 10.0):
    """Softplus-smoothed joint cost and its gradient (dq1, dq2)."""
    z = F.arrays_zip(F.col("d1").alias("a"), F.col("d2").alias("b"))
    cu1, co2, cu2 = F.col("cu1"), F.col("co2"), F.col("cu2")

    def parts(p):
        inv = softplus(q1 - p["a"], k)
        eff = q2 + inv
        dobj = co2 * sigmoid(eff - p["b"], k) - cu2 * sigmoid(p["b"] - eff, k)
        obj = cu1 * softplus(p["a"] - q1, k) + co2 * softplus(eff - p["b"], k) + cu2 * softplus(p["b"] - eff, k)
        g1 = -cu1 * sigmoid(p["a"] - q1, k) + dobj * sigmoid(q1 - p["a"], k)
        return obj, g1, dobj
    n = F.size("d1")
    obj = F.aggregate(z, F.lit(0.0), lambda acc, p: acc + parts(p)[0]) / n
    g1 = F.aggregate(z, F.lit(0.0), lambda acc, p: acc + parts(p)[1]) / n
    g2 = F.aggregate(z, F.lit(0.0), lambda acc, p: acc + parts(p)[2]) / n
    return obj, g1, g2


def with_candidates(items: DataFrame, moq: int) -> DataFrame:
    """Vertex candidates (q1, q2) >= MOQ per item with their exact joint cost."""
    m = F.lit(float(moq))
    A = F.array_distinct(F.concat(F.array(m), F.filter("d1", lambda x: x >= m)))
    B = F.array_distinct(F.concat(F.array(m), F.filter("d2", lambda x: x >= m)))
    S = F.array_distinct(F.zip_with("d1", "d2", lambda a, b: a + b))
    grid = F.flatten(F.transform(A, lambda a: F.transform(B, lambda b: F.struct(a.alias("q1"), b.alias("q2")))))
    via_a = F.flatten(F.transform(A, lambda a: F.transform(F.filter(S, lambda s: s - a >= m),
                                                           lambda s: F.struct(a.alias("q1"), (s - a).alias("q2")))))
    via_b = F.flatten(F.transform(B, lambda b: F.transform(F.filter(S, lambda s: s - b >= m),
                                                           lambda s: F.struct((s - b).alias("q1"), b.alias("q2")))))
    cands = F.array_distinct(F.concat(grid, via_a, via_b))
    costed = F.transform(cands, lambda c: F.struct(
        F.round(joint_cost(c["q1"], c["q2"]), COST_DIGITS).alias("cost"), c["q1"].alias("q1"), c["q2"].alias("q2")))
    return items.withColumn("cands", costed)


def _choose(lam1: Column, lam2: Column) -> Column:
    """argmin over candidates of cost + l1*uc*q1 + l2*uc*q2 (ties: smaller q1, then q2)."""
    uc = F.col("unit_cost")
    return F.array_min(F.transform("cands", lambda c: F.struct(
        F.round(c["cost"] + lam1 * uc * c["q1"] + lam2 * uc * c["q2"], COST_DIGITS).alias("v"),
        c["q1"].alias("q1"), c["q2"].alias("q2"), c["cost"].alias("cost"))))


def _corner_points(d1, d2, cu1: float, co2: float, cu2: float, moq: float):
    """Corners (q1, q2, cost) of the joint cost that can be best at some prices >= 0.

    With q1 fixed the cost is a newsvendor cost of q2 on the demands left over, with q2
    fixed a sum of hinges of q1; sorted once, prefix sums give it at every kink, so N
    scenarios cost N^2 log N.  A corner with another one no larger in q1, q2 and cost
    is left out."""
    a, b = np.asarray(d1, float), np.asarray(d2, float)
    n, s = len(a), a + b

    # q1 at a Year-1 kink or the MOQ, q2 at every kink of what is left
    A = np.unique(np.append(a[a >= moq], moq))
    left = np.sort(np.where(a >= A[:, None], b, s - A[:, None]), axis=1)
    before = np.concatenate([np.zeros((len(A), 1)), np.cumsum(left, axis=1)], axis=1)
    below = (left <= moq).sum(axis=1)[:, None]
    k = np.concatenate([below, np.maximum(np.arange(1, n + 1), below)], axis=1)
    q = np.concatenate([np.full((len(A), 1), moq), np.maximum(left, moq)], axis=1)
    pre = np.take_along_axis(before, k, axis=1)
    y2 = co2 * (k * q - pre) + cu2 * (before[:, -1:] - pre - (n - k) * q)
    y1 = cu1 * np.maximum(a - A[:, None], 0).sum(axis=1)[:, None]
    q1, q2, cost = [np.broadcast_to(A[:, None], q.shape).ravel()], [q.ravel()], [(y1 + y2).ravel()]

    # q2 at a Year-2 kink or the MOQ, q1 where both years' demand is just met
    order = np.argsort(a, kind="stable")
    sa, sb, ss = a[order], b[order], np.sort(s)
    from_a = np.concatenate([[0.0], np.cumsum(sa)])
    from_s = np.concatenate([[0.0], np.cumsum(ss)])
    for v in np.unique(np.append(b[b >= moq], moq)):
        x = ss - v
        x = np.unique(x[x >= moq])
        if not len(x):
            continue
        w = np.where(sb <= v, co2, -cu2)
        at = np.searchsorted(sa, x, side="right")
        w0, w1 = np.concatenate([[0.0], np.cumsum(w)]), np.concatenate([[0.0], np.cumsum(w * sa)])
        short = sb > v
        kink = np.sort((sa + sb - v)[short])
        kat, ksum = np.searchsorted(kink, x, side="right"), np.concatenate([[0.0], np.cumsum(kink)])
        f = (cu1 * (from_a[-1] - from_a[at] - (n - at) * x) + w0[at] * x - w1[at]
             + (cu2 + co2) * (kat * x - ksum[kat])
             + co2 * (v - sb[~short]).sum() + cu2 * (sb[short] - v).sum())
        q1.append(x)
        q2.append(np.full(len(x), v))
        cost.append(f)
    q1, q2 = np.concatenate(q1), np.concatenate(q2)
    cost = np.round(np.concatenate(cost) / n, COST_DIGITS)

    # cheapest first; a staircase (q1 up, q2 down) of the kept ones tells what they cover
    keep, xs, ys = [], [], []
    for i in np.lexsort((q2, q1, cost)):
        p, r = q1[i], q2[i]
        j = bisect_right(xs, p)
        if j and ys[j - 1] <= r:
            continue
        keep.append(i)
        lo = j - 1 if j and xs[j - 1] == p else j
        hi = lo
        while hi < len(xs) and ys[hi] >= r:
            hi += 1
        xs[lo:hi], ys[lo:hi] = [p], [r]
    return q1[keep], q2[keep], cost[keep]


def with_corners(items: DataFrame, moq: int) -> DataFrame:
    """Like ``with_candidates`` for many scenarios a row: only the corners that can be best
    at some prices.  An item without costs gets the MOQ at unknown cost."""
    cols = items.columns
    schema = T.StructType([*items.schema.fields, *[T.StructField(c, T.ArrayType(T.DoubleType()))
                                                   for c in ("_k", "_x", "_y")]])

    def run(batches):
        for pdf in batches:
            out = [_corner_points(r.d1, r.d2, r.cu1, r.co2, r.cu2, float(moq))
                   if not any(c is None or c != c for c in (r.cu1, r.co2, r.cu2)) else
                   ([float(moq)], [float(moq)], [None]) for r in pdf.itertuples(index=False)]
            yield pdf.assign(_k=[list(o[2]) for o in out], _x=[list(o[0]) for o in out], _y=[list(o[1]) for o in out])
    return (items.mapInPandas(run, schema)
            .select(*cols, F.arrays_zip(F.col("_k").alias("cost"), F.col("_x").alias("q1"), F.col("_y").alias("q2"))
                    .alias("cands")))


def _best_mix(cuts: list, b1: float, b2: float, top: float):
    """The mix of evaluated choices of least cost that meets both budgets.

    ``cuts``: (cost, spend1, spend2) of choices seen.  Returns (cost, prices, weights by
    cut).  Two budgets and the sum of weights allow three parts at most, so all triples
    of choices, unspent money and (at the top price) missing money are solved at once."""
    g = np.array([(s1 - b1, s2 - b2) for _, s1, s2 in cuts])
    scale = max(np.abs(g).max(), 1e-9)
    cols = np.concatenate([np.column_stack([g / scale, np.ones(len(g))]),
                           [[1, 0, 0], [0, 1, 0], [-1, 0, 0], [0, -1, 0]]])
    price = np.array([c for c, _, _ in cuts] + [0, 0, top * scale, top * scale], float)
    tri = np.array(list(combinations(range(len(cols)), 3)))
    m = cols[tri].transpose(0, 2, 1)
    ok = np.abs(np.linalg.det(m)) > 1e-12
    tri, m = tri[ok], m[ok]
    w = np.linalg.solve(m, np.broadcast_to(np.array([0, 0, 1.0])[:, None], (len(m), 3, 1)))[:, :, 0]
    ok = (w >= -1e-9).all(axis=1)
    tri, m, w = tri[ok], m[ok], np.clip(w[ok], 0, None)
    cost = (w * price[tri]).sum(axis=1)
    near = np.flatnonzero(cost <= cost.min() + 1e-9 * max(1.0, abs(cost.min())))
    y = np.linalg.solve(m[near].transpose(0, 2, 1), price[tri[near]][:, :, None])[:, :, 0]
    # of equal mixes, the one whose prices no other choice contradicts
    slack = (price[None, :] - y @ cols.T).min(axis=1)
    pick = int(slack.argmax())
    i = near[pick]
    lam = np.clip(-y[pick, :2] / scale, 0, top)
    return float(cost[i]), (float(lam[0]), float(lam[1])), {int(t): float(x) for t, x in zip(tri[i], w[i]) if t < len(g) and x > 0}


def joint_orders(items: DataFrame, budgets: DataFrame, bkey: str, moq: int, rounds: int = 60, tol: float = 1e-6):
    """Prices of the Year-1 and Year-2 budgets per key, to a relative tolerance.

    ``budgets``: bkey, budget1, budget2 (one row per budget key, driver-sized).  A round
    prices every item's corners and sums cost and spend per key: one aggregate, two price
    pairs a key.  Each gives a bound from below (the priced cost) and one more choice to
    mix; the best mix that meets the budgets bounds the convexified optimum from above and
    proposes the next prices.  Rounds end when the two are within ``tol`` (``gap`` in the
    duals says how near they came).  Returns (plan, duals): plan has the continuous (q1, q2),
    the mix of at most three choices; duals has the prices l1, l2, ``dual_bound`` and ``gap``.
    """
    spark = items.sparkSession
    # checkpointed (lineage cut, survives executor loss) and kept in memory for the rounds
    cand = cut_lineage(with_corners(items, moq)).persist()
    b = {r[bkey]: (float(r["budget1"]), float(r["budget2"])) for r in budgets.collect()}  # one row per key
    top = float(cand.agg(F.max((F.col("cu1") + F.col("co2") + F.col("cu2")) / F.col("unit_cost"))).first()[0] or 1.0)
    uc = F.col("unit_cost")

    def lam_df(pairs):
        return spark.createDataFrame([(k, v) for k, v in pairs.items()],
                                     f"`{bkey}` string, _lam array<struct<l1:double,l2:double,w:double>>")

    def chosen(pairs):
        """Every item with its choice at each of its key's prices."""
        return (cand.join(F.broadcast(lam_df(pairs)), bkey)
                .withColumn("_ch", F.transform("_lam", lambda p: _choose(p["l1"], p["l2"]))))

    def evaluate(pairs):
        x = chosen(pairs).select(bkey, "unit_cost", F.posexplode("_ch").alias("_i", "_c"))
        rows = x.groupBy(bkey, "_i").agg(F.sum("_c.cost").alias("c"), F.sum(uc * F.col("_c.q1")).alias("s1"),
                                         F.sum(uc * F.col("_c.q2")).alias("s2")).collect()
        for r in rows:
            seen[r[bkey]].append(((r["c"] or 0.0, r["s1"] or 0.0, r["s2"] or 0.0), pairs[r[bkey]][r["_i"]][:2]))

    def bound(k):
        """Largest priced cost seen and its prices."""
        return max((c + l1 * (s1 - b[k][0]) + l2 * (s2 - b[k][1]), (l1, l2)) for (c, s1, s2), (l1, l2) in seen[k])

    seen = {k: [] for k in b}
    evaluate({k: [(x, y, 0.0) for x in (0.0, top) for y in (0.0, top)] for k in b})
    mixes, gaps = {}, {}
    for _ in range(max(rounds, 1)):
        pairs = {}
        for k in b:
            if not seen[k]:  # a key without items
                continue
            mixes[k] = _best_mix([c for c, _ in seen[k]], *b[k], top)
            low, at = bound(k)
            gaps[k] = max(mixes[k][0] - low, 0.0)
            if gaps[k] > tol * max(1.0, abs(low)):
                lam = mixes[k][1]
                pairs[k] = [(*lam, 0.0), ((lam[0] + at[0]) / 2, (lam[1] + at[1]) / 2, 0.0)]
        if not pairs:
            break
        evaluate(pairs)

    mix = {k: [(*seen[k][i][1], w) for i, w in m[2].items()] for k, m in mixes.items()}

    def blend(q):
        return F.aggregate(F.arrays_zip("_lam", "_ch"), F.lit(0.0),
                           lambda acc, z: acc + z["_lam"]["w"] * z["_ch"][q])
    best = {k: bound(k) for k in mixes}
    duals = spark.createDataFrame([(k, *best[k][1], *b[k], best[k][0], gaps[k]) for k in mixes],
                                  f"`{bkey}` string, l1 double, l2 double, budget1 double, budget2 double, "
                                  "dual_bound double, gap double")
    plan = (chosen(mix).join(F.broadcast(duals.select(bkey, "l1", "l2")), bkey)
            .select(*items.columns, "l1", "l2", blend("q1").alias("q1"), blend("q2").alias("q2")))
    cand.unpersist()  # later evaluation of the plan reads the checkpoint
    return plan, duals


def joint_project(plan: DataFrame, budgets: DataFrame, bkey: str, moq: int) -> DataFrame:
    """Both years floored at MOQ and scaled per (key, year) above MOQ to fit (clamp mode)."""
    out = plan
    for q, bcol in (("q1", "budget1"), ("q2", "budget2")):
        qm = F.greatest(F.col(q), F.lit(float(moq)))
        s = (out.groupBy(bkey).agg(F.sum(F.col("unit_cost") * qm).alias("_sp"),
                                   F.sum(F.col("unit_cost") * moq).alias("_mn"))
             .join(budgets.select(bkey, bcol), bkey))
        extra = F.col("_sp") - F.col("_mn")
        s = s.select(bkey, F.when(F.col("_sp") <= F.col(bcol) + 1e-9, 1.0)
                     .when(extra > 0, F.least(F.greatest(F.col(bcol) - F.col("_mn"), F.lit(0.0)) / extra, F.lit(1.0)))
                     .otherwise(0.0).alias("_scale"))
        out = (out.join(F.broadcast(s), bkey)
               .withColumn(q, F.lit(float(moq)) + (qm - moq) * F.col("_scale")).drop("_scale"))
    return out


def _cost_cuts(rows: DataFrame, bkey: str, name: str) -> DataFrame:
    """Quantiles of the unit cost per key (COST_RANGES at most) as array ``name``."""
    at = F.lit([i / COST_RANGES for i in range(COST_RANGES + 1)])
    return rows.groupBy(bkey).agg(F.array_sort(F.array_distinct(F.percentile_approx("unit_cost", at))).alias(name))


def _cost_bucket(cuts: str) -> Column:
    """Bucket of the unit cost: odd ones hold one cost, even ones what lies between two."""
    uc = F.col("unit_cost")
    return 2 * F.size(F.filter(cuts, lambda v: v < uc)) + F.array_contains(cuts, uc).cast("int")


def _cross(rows: DataFrame, state: DataFrame, bkey: str, bucket: Column, name: str) -> DataFrame:
    """``state`` with the bucket ``name`` in which ``_need`` is used up, less what the buckets
    before it give; LAST if all of them give less."""
    sums = rows.groupBy(bkey, bucket.alias("_b")).agg(F.sum("_rem").alias("_s"))
    w = Window.partitionBy(bkey).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cut = (sums.withColumn("_c", F.sum("_s").over(w)).join(F.broadcast(state.select(bkey, "_need")), bkey)
           .filter(F.col("_c") >= F.col("_need")).groupBy(bkey)
           .agg(F.min(F.struct("_b", (F.col("_c") - F.col("_s")).alias("_used"))).alias("_m")))
    out = state.join(F.broadcast(cut), bkey, "left")
    return cut_lineage(out.withColumn(name, F.coalesce("_m._b", F.lit(LAST)))
                       .withColumn("_need", F.col("_need") - F.coalesce("_m._used", F.lit(0.0))).drop("_m"))


def _repair_one(plan: DataFrame, q: str, bcol: str, budgets: DataFrame, bkey: str, moq: int, keys) -> DataFrame:
    """B6 for one year: ceil (noise of 1e-9 aside), then cut the cheapest units first until
    each key fits its budget (never below MOQ).  Order: unit cost, then md5(item key).
    The place where the excess is used up is narrowed by two levels of cost ranges and one
    of md5 prefixes; between the levels only one row per key is kept, and only the rows of
    the last small range are ranked."""
    x = plan.withColumn(q, F.ceil(F.round(q, 9)).cast("double"))
    x = cut_lineage(x.withColumn("_h", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))
                    .withColumn("_rem", F.coalesce((F.col(q) - moq) * F.col("unit_cost"), F.lit(0.0))))
    spend = x.groupBy(bkey).agg(F.sum(F.col("unit_cost") * F.col(q)).alias("_sp")).join(budgets.select(bkey, bcol), bkey)
    can = x.filter(F.col("_rem") > 0)
    state = cut_lineage(spend.select(bkey, (F.col("_sp") - F.col(bcol)).alias("_need")).filter(F.col("_need") > 1e-9)
                        .join(_cost_cuts(can, bkey, "_q1"), bkey))
    b1, b2 = _cost_bucket("_q1"), _cost_bucket("_q2")
    prefix = F.when(F.col("_a2") % 2 == 1, F.conv(F.substring("_h", 1, HASH_PREFIX), 16, 10).cast("int")).otherwise(0)

    def inside(cond: Column = F.lit(True)):
        return can.join(F.broadcast(state), bkey).filter(cond)
    state = _cross(inside(), state, bkey, b1, "_a1")
    state = state.join(F.broadcast(_cost_cuts(inside(b1 == F.col("_a1")), bkey, "_q2")), bkey, "left")
    state = cut_lineage(state.withColumn("_q2", F.coalesce("_q2", F.array().cast("array<double>"))))
    state = _cross(inside(b1 == F.col("_a1")), state, bkey, b2, "_a2")
    state = _cross(inside((b1 == F.col("_a1")) & (b2 == F.col("_a2"))), state, bkey, prefix, "_a3")

    x = x.join(F.broadcast(state), bkey, "left")
    x = x.withColumn("_at", F.struct(b1.alias("a"), b2.alias("b"), prefix.alias("c")))
    cross = F.struct(F.col("_a1").alias("a"), F.col("_a2").alias("b"), F.col("_a3").alias("c"))
    # -1: below the crossing, cut whole; 0: in the crossing range; 1: stays
    x = x.withColumn("_st", F.when(F.col("_need").isNull() | (F.col("_rem") <= 0) | (F.col("_at") > cross), 1)
                     .when(F.col("_at") < cross, -1).otherwise(0))
    w = Window.partitionBy(bkey).orderBy("unit_cost", "_h", *keys).rowsBetween(Window.unboundedPreceding, 0)
    part = x.filter(F.col("_st") == 0).withColumn("_before", F.sum("_rem").over(w) - F.col("_rem"))
    units = F.ceil((F.col("_need") - F.col("_before")) / F.col("unit_cost") - 1e-9).cast("double")
    part = part.withColumn(q, F.col(q) - F.least(F.greatest(units, F.lit(0.0)), F.col(q) - moq))
    done = x.filter(F.col("_st") != 0).withColumn(q, F.when(F.col("_st") < 0, F.lit(float(moq))).otherwise(F.col(q)))
    return done.select(*plan.columns).unionByName(part.select(*plan.columns))


def joint_repair(plan: DataFrame, budgets: DataFrame, bkey: str, moq: int, keys) -> DataFrame:
    """B4 + B6: project, then round up and repair per (key, year); integer q1, q2."""
    p = joint_project(plan, budgets, bkey, moq)
    p = _repair_one(p, "q1", "budget1", budgets, bkey, moq, keys)
    p = _repair_one(p, "q2", "budget2", budgets, bkey, moq, keys)
    return p.withColumn("q1", F.col("q1").cast("long")).withColumn("q2", F.col("q2").cast("long"))


def expected_carryover(q1: Column | None = None, d1: Column | None = None) -> Column:
    """Mean over scenarios of (q1 - D1)+."""
    q1, d1 = _cols(q1, "q1"), _cols(d1, "d1")
    return F.aggregate(d1, F.lit(0.0), lambda acc, x: acc + F.greatest(q1 - x, F.lit(0.0))) / F.size(d1)


def top_carryover(items: DataFrame, keys, n: int = 10) -> DataFrame:
    """The n items with the largest expected carry-over (rounded to 6 places, ties by key)."""
    r = items.withColumn("expected_carryover", F.round("expected_carryover", 6))
    return r.orderBy(F.col("expected_carryover").desc_nulls_last(), *keys).limit(n)


def joint_spend(plan: DataFrame, budgets: DataFrame, bkey: str, tol: float = 1.0) -> DataFrame:
    """Spend per key and year, violation, feasibility with tolerance."""
    s = plan.groupBy(bkey).agg(F.sum(F.col("unit_cost") * F.col("q1")).alias("y1_spend"),
                               F.sum(F.col("unit_cost") * F.col("q2")).alias("y2_spend")).join(budgets, bkey)
    v = F.greatest(F.col("y1_spend") - F.col("budget1"), F.col("y2_spend") - F.col("budget2"))
    return s.withColumn("max_violation", v).withColumn("feasible", v <= tol)


def shadow_price(plan: DataFrame, duals: DataFrame, plan_more: DataFrame, duals_more: DataFrame, bkey: str,
                 step: float) -> DataFrame:
    """Year-1 budget price at a budget and at ``step`` more.  The convexified optimum is
    convex in the budget, so ``finite_difference`` lies between the two prices up to
    ``gap`` / step; ``plan_difference`` compares the exact cost of the two plans."""
    def total(p, name):
        return p.groupBy(bkey).agg(F.sum(joint_cost(F.col("q1"), F.col("q2"))).alias(name))
    d = duals.select(bkey, F.col("l1").alias("y1_dual"), F.col("dual_bound").alias("_v"), F.col("gap").alias("_g"))
    m = duals_more.select(bkey, F.col("l1").alias("y1_dual_after"), F.col("dual_bound").alias("_vm"),
                          F.col("gap").alias("_gm"))
    x = d.join(F.broadcast(m), bkey).join(total(plan, "_o"), bkey).join(total(plan_more, "_om"), bkey)
    return x.select(bkey, "y1_dual", "y1_dual_after", ((F.col("_v") - F.col("_vm")) / step).alias("finite_difference"),
                    ((F.col("_o") - F.col("_om")) / step).alias("plan_difference"),
                    (F.col("_g") + F.col("_gm")).alias("gap"))


def formulation_table(a_plan: DataFrame, b_plan: DataFrame, keys, y1: int, y2: int) -> DataFrame:
    """B10 (J4): per item A-Y1, A-Y2, B-Y1, B-Y2 quantities and carry-over,
    from one union + group-by (a full outer join of four inputs in one shuffle)."""
    a = a_plan.select(*keys, F.when(F.col("year") == y1, F.col("q")).alias("a_y1_qty"),
                      F.when(F.col("year") == y2, F.col("q")).alias("a_y2_qty"),
                      *[F.lit(None).cast(t).alias(c) for c, t in (("b_y1_qty", "long"), ("b_y2_qty", "long"),
                                                                  ("expected_carryover", "double"))])
    b = b_plan.select(*keys, F.lit(None).cast("long").alias("a_y1_qty"), F.lit(None).cast("long").alias("a_y2_qty"),
                      F.col("q1").alias("b_y1_qty"), F.col("q2").alias("b_y2_qty"),
                      F.round(expected_carryover(F.col("q1").cast("double")), 1).alias("expected_carryover"))
    u = a.unionByName(b).groupBy(*keys).agg(*[F.max(c).alias(c) for c in
                                              ("a_y1_qty", "a_y2_qty", "b_y1_qty", "b_y2_qty", "expected_carryover")])
    return (u.withColumn("y1_qty_diff", F.col("b_y1_qty") - F.col("a_y1_qty"))
             .withColumn("y2_qty_diff", F.col("b_y2_qty") - F.col("a_y2_qty")))


def largest_size_shift(table: DataFrame, n: int = 5) -> DataFrame:
    """|sum of Year-2 differences| by size, top n (ties by size)."""
    s = table.groupBy("size").agg(F.abs(F.sum("y2_qty_diff")).alias("abs_y2_shift"))
    return s.orderBy(F.col("abs_y2_shift").desc_nulls_last(), "size").limit(n)
