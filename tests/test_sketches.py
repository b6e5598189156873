"""Sketch profiles within their bounds, merging, drift, and renamed columns."""

import random

from pyspark.sql import functions as F

from verdigris.operators import inspect
from verdigris.operators import sketches as S
from verdigris.sources.tables import parquet_table


def test_profiles_are_within_their_bounds(spark, data):
    lines = parquet_table(spark, data, "lineitem").withColumn("l_tax", F.when(F.col("l_orderkey") % 7 == 0, None).otherwise(F.col("l_tax")))
    cols = lines.columns
    exact = {r["column"]: r for r in inspect.profile(lines, cols).collect()}
    numbers = lines.toPandas()
    for r in S.sketch_profile(S.sketches(lines, cols)).collect():
        want = exact[r["column"]]
        assert (r["n_rows"], r["n_null"]) == (want["n_rows"], want["n_null"])
        error = 0 if want["n_distinct"] <= 2**S.LOG_DISTINCT else S.DISTINCT_ERROR * want["n_distinct"]
        assert abs(r["n_distinct"] - want["n_distinct"]) <= error
        if r["kind"] in ("double", "bigint", "int"):
            values = numbers[r["column"]].dropna().sort_values()
            for q, value in zip(S.QUANTILES, r["quantiles"]):
                below, upto = (values < value).mean(), (values <= value).mean()
                assert below - S.RANK_ERROR <= q <= upto + S.RANK_ERROR
        if want["n_distinct"] < 100:
            counts = lines.groupBy(r["column"]).count().where(F.col(r["column"]).isNotNull()).collect()
            assert {t["count"] for t in r["top"]} <= {c["count"] for c in counts} and r["top"][0]["count"] == max(c["count"] for c in counts)


def test_parts_merge_into_the_whole(spark, data):
    orders = parquet_table(spark, data, "orders")
    cols = orders.columns
    whole = {r["column"]: r.asDict() for r in S.sketch_profile(S.sketches(orders, cols)).collect()}
    parts = [S.sketches(orders.where(F.col("o_orderkey") % 3 == k), cols) for k in range(3)]
    for r in S.sketch_profile(S.merged(parts)).collect():
        assert {k: v for k, v in r.asDict().items() if k not in ("quantiles", "top")} == {k: v for k, v in whole[r["column"]].items() if k not in ("quantiles", "top")}
        assert (r["quantiles"] is None) == (whole[r["column"]]["quantiles"] is None) and r["top"][0]["count"] == whole[r["column"]]["top"][0]["count"]


def test_drift_tells_moved_columns(spark):
    rng = random.Random(1)
    a = spark.createDataFrame([(i, rng.gauss(0, 1), rng.choice("xyz")) for i in range(4000)], "k int, v double, s string")
    b = a.withColumn("v", F.col("v") + 1).withColumn("s", F.when(F.col("k") % 4 > 0, F.col("s")))
    found = {r["column"]: r for r in S.drift(S.sketches(a, a.columns), S.sketches(b, b.columns)).collect()}
    assert found["k"]["rank_gap"] < 0.03 and found["k"]["shared_values"] == 1 and found["s"]["rank_gap"] is None
    assert abs(found["v"]["rank_gap"] - 0.383) < 0.04 and found["v"]["shared_values"] < 0.01 and found["s"]["null_gap"] == 0.25


def test_empty_tables_nulls_and_special_values(spark):
    df = spark.createDataFrame([(float("nan"), None, {"a": 1}), (None, None, None), (-0.0, None, {"a": 1}), (0.0, None, {})], "v double, `n.n` string, m map<string,int>")
    found = {r["column"]: r for r in S.sketch_profile(S.sketches(df, df.columns)).collect()}
    assert (found["v"]["n_distinct"], found["v"]["n_null"], found["v"]["quantiles"]) == (2, 1, [0.0] * 5)
    assert (found["n.n"]["n_distinct"], found["n.n"]["n_null"], found["n.n"]["quantiles"], found["m"]["n_distinct"]) == (0, 4, None, 2)
    empty = S.sketch_profile(S.sketches(df.limit(0), df.columns)).collect()
    assert [(r["n_rows"], r["n_distinct"], r["quantiles"]) for r in empty] == [(0, 0, None)] * 3
    assert S.drift(S.sketches(df.limit(0), ["v"]), S.sketches(df, ["v"])).first()["rank_gap"] is None


def test_renamed_columns_are_found(spark, data):
    orders = parquet_table(spark, data, "orders")
    moved = orders.selectExpr("o_orderkey", "o_custkey as cust", "cast(o_custkey as string) as text", "o_orderpriority as o_priority", "upper(o_orderstatus) as s", "o_totalprice * 2 as o_total", "cast(o_orderkey + 5 as double) as near", "o_orderdate")
    found = {(r["source_column"], r["target_column"]): r for r in S.renamed_columns(orders, moved).collect()}
    assert set(found) == {("o_custkey", "cust"), ("o_orderpriority", "o_priority"), ("o_orderstatus", "s")}
    assert found["o_orderpriority", "o_priority"]["shared_values"] == 1
    assert S.renamed_columns(orders, orders).count() == S.renamed_columns(orders, moved.limit(0)).count() == 0
    # Two columns of the same values: the nearer null share, then the nearer name.
    twins = orders.selectExpr("o_orderkey", "o_orderpriority as o_orderprior", "if(o_orderkey % 2 = 0, o_orderpriority, null) as o_orderpriority_")
    assert [r["target_column"] for r in S.renamed_columns(orders.select("o_orderkey", "o_orderpriority"), twins).collect()] == ["o_orderprior"]
