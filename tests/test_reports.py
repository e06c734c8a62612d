"""Counts observed with the filter (P4), range ratio (E5), JSON configuration (S2), two test years (B1)."""

import pytest

from orderlab.operators.clean import drop_and_report
from orderlab.operators.evaluate import range_ratio
from orderlab.operators.joint import two_test_years
from orderlab.sources.config import ProblemConfig, config_json, load_config, read_constraints, read_cost_structure


def test_counts_come_with_the_rows(spark):
    df = spark.createDataFrame([(1,), (0,), (-2,), (None,), (5,)], "t int")
    kept, seen = drop_and_report(df, "t")
    assert sorted(r.t for r in kept.collect()) == [1, 5]
    assert seen.get == {"rows": 5, "null_target": 1, "nonpositive": 2}


@pytest.mark.parametrize("under,expected", [([4.0, 6.0], 2.5), ([4.0, 4.0], None)])
def test_range_ratio(spark, under, expected):
    rows = [("overage", 5.0), ("overage", 10.0), *[("underage", u) for u in under]]
    r = range_ratio(spark.createDataFrame(rows, "parameter string, total_cost double")).first()
    assert r.co_range == 5.0 and r.range_ratio == expected


def test_json_configuration(spark, tmp_path):
    cfg = ProblemConfig(budget=123.5, moq=4)
    p = tmp_path / "c.json"
    p.write_text(config_json(cfg))
    back = load_config(str(p))
    assert (back.cost_items, back.budget, back.moq) == (cfg.cost_items, 123.5, 4)
    got = read_cost_structure(spark, str(p)).orderBy("ord").collect()
    assert [(r.name, r.value, r.product_category, r.period) for r in got] == cfg.cost_items
    assert tuple(read_constraints(spark, str(p)).first()) == (123.5, 4)
    bare = tmp_path / "bare.json"
    bare.write_text('{"constraints": [{"name": "Minimum", "parameters": {"other": 3}}, {"name": "MOQ", "parameters": {"moq": 2}}]}')
    assert tuple(read_constraints(spark, str(bare)).first()) == (float("inf"), 2)


def test_two_test_years(spark):
    df = spark.createDataFrame([(2024,), (2023,), (None,), (2025,)], "year int")
    assert two_test_years(df) == (2023, 2024)
    with pytest.raises(ValueError, match="two test years"):
        two_test_years(df.filter("year = 2024"))
