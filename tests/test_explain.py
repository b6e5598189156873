"""Slices that explain totals, and differences by path in JSON text."""

import json
import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from verdigris.operators.explain import explain_totals
from verdigris.operators.json_paths import json_diff, json_paths


def test_exactly_the_damaged_slices_are_named(spark):
    made = [(a, b, c, 1.25, k) for a, b, c, k in product("xyz", ["p", "q", None], [1, 2, 3], range(2))]
    src = spark.createDataFrame(made, "`a.a` string, b string, c int, v double, k int")
    tgt = src.withColumn("v", F.when((F.col("`a.a`") == "x") & F.col("b").isNull(), F.col("v") + 1).otherwise(F.col("v"))).where("c <> 2 or k <> 1")
    found = sorted(tuple(r) for r in explain_totals(src, tgt, ["a.a", "b", "c"], "v").collect())
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in found] == [("a.a=x,b=null", 2, 3, 6, 5), ("c=2", 1, 9, 18, 9)]
    assert explain_totals(src, src, ["a.a", "b"], "v").count() == explain_totals(src.limit(0), src.limit(0), ["b"]).count() == 0
    assert [r["slice"] for r in explain_totals(src, src.limit(0), ["a.a", "b"]).collect()] == ["all"]
    with pytest.raises(ValueError):
        explain_totals(src, tgt, [])


def test_slices_cover_all_that_differs_and_nothing_else(spark):
    rng = random.Random(8)
    for _ in range(3):
        every = list(product("abc", "def", "gh"))
        bad = {x for x in every if rng.random() < 0.5}
        src = spark.createDataFrame(every, "x string, y string, z string")
        tgt = src.where(~F.concat("x", "y", "z").isin(*("".join(b) for b in bad)))
        told = [dict(p.split("=") for p in r["slice"].split(",")) if r["slice"] != "all" else {} for r in explain_totals(src, tgt, ["x", "y", "z"]).collect()]
        inside = lambda s: {e for e in every if all(dict(zip("xyz", e))[k] == v for k, v in s.items())}
        assert set().union(*map(inside, told)) == bad
        for s in told:  # none can be wider
            assert not any(inside(dict(w)) <= bad for w in combinations(s.items(), len(s) - 1)) or not s


DEEP = '{"a": {"b": [1, {"c": null}, []], "d e": "x"}, "n": 1.50, "t": true, "o": {}}'


def test_every_value_has_its_path(spark):
    df = spark.createDataFrame([(1, DEEP), (2, "[]"), (3, '"7"'), (4, "{oops"), (5, None), (6, "")], "k int, j string")
    found = {(r["k0"], r["path"]): (r["kind"], r["value"]) for r in json_paths(df, ["k"], "j").collect()}
    assert found == {
        (1, "$.a.b[0]"): ("number", "1"), (1, "$.a.b[1].c"): ("null", None), (1, "$.a.b[2]"): ("array", "[]"), (1, "$.a['d e']"): ("string", "x"), (1, "$.n"): ("number", "1.5"),
        (1, "$.t"): ("boolean", "true"), (1, "$.o"): ("object", "{}"), (2, "$"): ("array", "[]"), (3, "$"): ("string", "7"), (4, "$"): ("malformed", "{oops"), (6, "$"): ("malformed", ""),
    }


def test_differences_by_path(spark):
    other = json.dumps({"t": True, "o": {}, "n": 1.5, "a": {"d e": "y", "b": [1, {"c": 0}, [], 9]}})
    kind = "path int, j string"
    src = spark.createDataFrame([(1, DEEP), (2, '{"k": 5}'), (None, '{"k": 1}'), (4, "{}"), (5, None)], kind)
    tgt = spark.createDataFrame([(1, other), (2, '{"k": "5"}'), (None, '{"k": 1}'), (6, "[1]"), (5, "null")], kind)
    found = sorted((tuple(r) for r in json_diff(src, tgt, ["path"], "j").collect()), key=str)
    assert found == sorted([
        (1, "$.a['d e']", "changed", "string", "x", "string", "y"), (1, "$.a.b[1].c", "changed", "null", None, "number", "0"), (1, "$.a.b[3]", "extra", None, None, "number", "9"),
        (2, "$.k", "retyped", "number", "5", "string", "5"), (4, "$", "missing", "object", "{}", None, None), (6, "$[0]", "extra", None, None, "number", "1"), (5, "$", "extra", None, None, "null", None),
    ], key=str)
    assert json_diff(src, tgt, ["path"], "j").columns[:3] == ["path", "path_", "status"] and json_diff(src, src, ["path"], "j").count() == 0
    assert json_diff(src.limit(0), tgt.limit(0), ["path"], "j").count() == 0
