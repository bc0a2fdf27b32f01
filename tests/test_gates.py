"""Gates and refusals where values are missing and tables empty."""

import json

from calibra.operators import gates as G
from calibra.operators import rules as R
from calibra.plans.registry import QUERIES


def test_a_box_without_an_outcome_met_again_is_in_no_arm(spark):
    recorded = spark.createDataFrame(
        [(1, "M", "b", None), (2, "M", "b", 1.0), (3, "C", "a", None), (4, "C", "a", 0.0), (5, "C", "a", 0.5), (6, "missed", "missed", 1.0), (7, None, None, 1.0)],
        "image int, grp string, outcome string, ring_b double",
    )
    local = spark.createDataFrame([(1, "b"), (3, "a"), (4, "a"), (5, "a"), (6, "missed"), (7, None)], "image int, outcome string")
    gate = G.baseline(recorded, local, "image")
    assert {r.image: r.ok for r in gate.collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}
    assert sorted(map(tuple, G.arm_boxes(recorded, gate, "image").collect())) == [(1, "ring"), (1, "sham"), (1, "whole"), (4, "reverse"), (5, "keep")]


def test_records_are_compared_where_one_is_missing(spark):
    one = spark.createDataFrame([(1, "x", None), (2, "x", 3)], "k int, a string, b int")
    other = spark.createDataFrame([(1, "x", 4), (3, None, None)], "k int, a string, b int")
    found = G.record_differences(one, other, ["k"], ["a", "b"])
    assert sorted(map(tuple, found.collect())) == [(1, "b", None, "4"), (2, "a", "x", None), (2, "b", "3", None)]


def test_record_problems(spark):
    rows = spark.createDataFrame([(1, "A", "A", True), (2, "A", "C", True), (3, "A", None, None), (4, "A", "A", False)], "id int, expected string, run string, check_ok boolean")
    found = sorted(map(tuple, G.record_problems(rows, "id").collect()))
    assert found == [(2, "run"), (3, "config_check"), (3, "run"), (4, "config_check")]


def test_equal_categories_and_separate_days(spark):
    cats = spark.createDataFrame([("train", 1, "a"), ("val", 1, "a"), ("test", 1, "a")], "split string, id int, name string")
    assert G.category_differences(cats).count() == 0 and G.category_differences(cats.limit(0)).count() == 0
    assert [tuple(r) for r in G.category_differences(cats.union(spark.createDataFrame([("val", 2, "b")], cats.schema))).collect()] == [(2, "b", 1)]
    days = spark.createDataFrame([("test", "d1"), ("train", "d2"), ("val", "d3")], "split string, day string")
    assert G.shared_days(days).count() == 0
    assert [r.day for r in G.shared_days(days.union(spark.createDataFrame([("val", "d1")], days.schema))).collect()] == ["d1"]


def test_target_refusals(spark):
    gt = spark.createDataFrame([(1, "t"), (2, "t"), (2, "u")], "image int, cls string")
    assert G.target_refusals(gt, "t", 2).count() == 0
    again = gt.union(spark.createDataFrame([(2, "t")], gt.schema))
    assert sorted(map(tuple, G.target_refusals(again, "t", 2).collect())) == [("number", 3), ("several", 1)]
    assert [tuple(r) for r in G.target_refusals(gt.limit(0), "t", 2).collect()] == [("number", 0)]


def test_each_configuration_is_opened_once(spark, sf_dir):
    """Both sides were flattened together, and that twice: once for each side."""
    for name, many in (("config_rule", 2), ("treatment_rule", 2)):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        opened = [line for line in plan.splitlines() if "MapInArrow" in line]
        assert len(opened) == many and not any("side#" in line for line in opened)


def test_leaves_of_every_kind(spark):
    config = {"a": {"b": 1.0, "c": [1.0, {"d": None}], "e": {}, "f": {"g": "x \"y\""}}, "h": True, "i": None, "j": -0.5, "k": 10**30, "l": "", "m": 1e300, "n": []}
    rows = R.flatten(spark.createDataFrame([(1, json.dumps(config)), (2, None), (3, "7"), (4, "{}")], "k int, config string"), "k").collect()
    got = {(r.k, r.path): r.value for r in rows}
    want = {"a.b": "1", "a.c": '[1.0,{"d":null}]', "a.e": "{}", "a.f.g": 'x "y"', "h": "true", "i": "null", "j": "-0.5", "k": "1" + "0" * 30, "l": "", "m": str(int(1e300)), "n": "[]"}
    assert got == {(1, p): v for p, v in want.items()} | {(3, ""): "7", (4, ""): "{}"} and len(rows) == len(got)
