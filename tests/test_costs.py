"""Cost look-ups (J6, J7), critical ratio (M10) and the inverse normal."""

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from orderlab.functions.normal import norm_ppf
from orderlab.operators.costs import critical_ratio_table, resolve_costs
from orderlab.sources.config import ProblemConfig, config_from_dict


def combos(spark, rows):
    return spark.createDataFrame(rows, "product_category string, period int")


def test_optimizer_lookup(spark):
    cfg = ProblemConfig()
    r = {(x.product_category, x.period): x for x in
         resolve_costs(combos(spark, [("top", 1), ("top", 2), ("socks", 2), ("bottom", None), ("hats", 1)]),
                       cfg.cost_table(spark)).collect()}
    assert (r[("top", 1)].overage_cost, r[("top", 1)].underage_cost, r[("top", 1)].unit_cost) == (5.0, 12.0, 25.0)
    assert (r[("top", 2)].overage_cost, r[("top", 2)].underage_cost) == (15.0, 60.0)
    assert (r[("socks", 2)].overage_cost, r[("socks", 2)].underage_cost) == (1.0, 5.0)
    # no period given: no (bottom, None) overage row -> first overage row of any category (Q3)
    assert r[("bottom", None)].overage_cost == 5.0
    # unknown category: first row of that name
    assert r[("hats", 1)].unit_cost == 25.0


def test_strict_lookup_and_cr(spark):
    cfg = ProblemConfig()
    strict = resolve_costs(combos(spark, [("top", 2), ("bottom", None)]), cfg.cost_table(spark), "strict",
                           ("overage_cost", "underage_cost"))
    s = {(x.product_category, x.period): x for x in strict.collect()}
    assert s[("bottom", None)].overage_cost is None       # scorer falls back to 1.0 / 1.0
    cr = {(x.product_category, x.period): x for x in critical_ratio_table(strict, 0.8).collect()}
    t = cr[("top", 2)]
    assert abs(t.critical_ratio - 0.8) < 1e-12 and abs(t.safety_factor - 1.24) < 1e-12
    assert abs(t.z_cr - NormalDist().inv_cdf(0.8)) < 1e-12
    assert cr[("bottom", None)].safety_factor == 1.0


def test_config_aliases():
    cfg = config_from_dict({"cost_structure": [{"name": "overage_cost", "value": 3, "product_category": "top",
                                                "lifecycle_year": 2}],
                            "constraints": [{"name": "budget", "parameters": {"max_budget": 100}},
                                            {"name": "moq", "parameters": {"moq": 4}}]})
    assert cfg.cost_items == [("overage_cost", 3.0, "top", 2)] and cfg.budget == 100.0 and cfg.moq == 4


def test_read_cost_structure(spark, tmp_path):
    import json
    from orderlab.sources.config import read_cost_structure
    p = tmp_path / "cfg.json"
    p.write_text(json.dumps({"cost_structure": [{"name": "unit_cost", "value": 25.0, "product_category": "top",
                                                 "lifecycle_year": None},
                                                {"name": "overage_cost", "value": 5.0, "product_category": "top",
                                                 "lifecycle_year": 1}]}))
    rows = read_cost_structure(spark, str(p)).orderBy("ord").collect()
    assert [(r.name, r.value, r.period) for r in rows] == [("unit_cost", 25.0, None), ("overage_cost", 5.0, 1)]


@pytest.mark.parametrize("p", [1e-10, 0.001, 0.02425, 0.1, 0.3636, 0.5, 0.8, 0.97575, 0.999, 1 - 1e-12])
def test_norm_ppf(spark, p):
    got = spark.createDataFrame([(p,)], "p double").select(norm_ppf(F.col("p"))).first()[0]
    assert abs(got - NormalDist().inv_cdf(p)) < 1e-9
