"""Comparison by digest trees: the same rows as a keyed comparison, for a fraction of the reading."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import digest_tree as D
from verdigris.operators.compare import key_diff_rows
from verdigris.sources.tables import parquet_table


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def leaf_rows(df):
    """Rows that the scans of an executed plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))


def test_ten_damaged_orders_are_found_in_a_tenth_of_the_rows(spark, data, tmp_path):
    orders = parquet_table(spark, data, "orders")
    many = orders.unionByName(orders.withColumn("o_orderkey", F.col("o_orderkey") + 100_000))
    many.repartitionByRange(40, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(f"{tmp_path}/src")
    src = spark.read.parquet(f"{tmp_path}/src")
    key = F.col("o_orderkey")
    damaged = src.where(key != 100_004).withColumn("o_totalprice", F.when(key.isin(5, 6, 7, 500, 1203), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    damaged = damaged.withColumn("o_orderstatus", F.when(key.isin(8, 100_700), F.lit(None)).otherwise(F.col("o_orderstatus")))
    damaged = damaged.unionByName(src.where(key.isin(9, 100_001)).withColumn("o_orderkey", key + 50_000))
    damaged.repartitionByRange(40, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(f"{tmp_path}/tgt")
    tgt = spark.read.parquet(f"{tmp_path}/tgt")
    cols = src.columns[1:]
    want = rows(key_diff_rows(src, tgt, ["o_orderkey"], cols))
    assert len(want) == 10
    grid = D.grid_of(src, tgt, "o_orderkey")
    trees = []
    for df, name in ((src, "a"), (tgt, "b")):
        D.write_tree(D.tree(df, "o_orderkey", cols, grid), f"{tmp_path}/{name}")
        trees.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert rows(D.tree_diff_rows(src, tgt, ["o_orderkey"], cols, tuple(trees), grid)) == want
    ranges, nulls, _ = D.differing_ranges(src, tgt, "o_orderkey", cols, tuple(trees), grid)
    assert not nulls and sum(high - low + 1 for low, high in ranges) <= 64
    for df in (src, tgt):
        assert 0 < leaf_rows(D.in_ranges(df, "o_orderkey", ranges, nulls, grid)) < df.count() / 4  # whole row groups are read
        plan = D.in_ranges(df, "o_orderkey", ranges, nulls, grid)._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(o_orderkey" in plan.split("PushedFilters")[1]


def test_databases_read_only_the_ranges(spark):
    """Derby evaluates the ranges itself: Spark gets the rows of differing leaves alone."""
    from verdigris.sources.tables import jdbc_table

    url = "jdbc:derby:memory:digests;create=true"
    spark.range(4000).select("id", (F.col("id") * 3).alias("v")).write.jdbc(url, "A", "overwrite")
    spark.range(4000).select("id", F.when(F.col("id") % 1000 == 7, -1).otherwise(F.col("id") * 3).alias("v")).write.jdbc(url, "B", "overwrite")
    a, b = (jdbc_table(spark, url, t) for t in ("A", "B"))
    key = a.columns[0]
    ranges, nulls, grid = D.differing_ranges(a, b, key, a.columns[1:])
    assert ranges == [(7, 7), (1007, 1007), (2007, 2007), (3007, 3007)] and not nulls
    assert leaf_rows(D.in_ranges(a, key, ranges, nulls, grid)) == 4
    assert len(rows(D.tree_diff_rows(a, b, [key], a.columns[1:]))) == 4


@pytest.mark.parametrize("leaves, most, most_rows", [(8, 64, 3), (64, 2, 100)])
def test_equals_the_keyed_comparison(spark, leaves, most, most_rows):
    rng = random.Random(leaves)
    def value():
        return rng.choice([None, "x", "y"])

    one = [(rng.choice([rng.randint(-50, 50), rng.randint(-(2**40), 2**40)]), value(), i) for i in range(60)] + [(None, "n", 1), (2**62, "end", 2)]
    one = list({r[0]: r for r in one}.values())
    two = [(k, rng.choice([v, v, v, v, value()]), w) for k, v, w in one if rng.random() > 0.05] + [(2**50, "more", 0), (-(2**50), "more", 0)]
    a, b = (spark.createDataFrame(x, "`k.1` long, v string, w long") for x in (one, two))
    grid = D.grid_of(a, b, "k.1", leaves, fanout=8)
    want = rows(key_diff_rows(a, b, ["k.1"], ["v", "w"]))
    assert rows(D.tree_diff_rows(a, b, ["k.1"], ["v", "w"], None, grid, most=most, most_rows=most_rows)) == want and want
    # A grid made before rows came that lie outside it.
    old = D.Grid(((-50, 50, 7),), 8)
    assert rows(D.tree_diff_rows(a, b, ["k.1"], ["v", "w"], None, old, most=most, most_rows=most_rows)) == want
    assert D.tree_diff_rows(a, a, ["k.1"], ["v", "w"], None, grid).count() == 0


def test_keys_of_time_and_empty_tables(spark):
    day, at = dt.date(2024, 2, 28), dt.datetime(1969, 12, 31, 23, 59, 59, 999_999)
    kind = "d date, t timestamp_ntz, z timestamp, v int"
    made = [(day + dt.timedelta(i), at + dt.timedelta(microseconds=i), at + dt.timedelta(hours=i), i) for i in range(40)]
    a = spark.createDataFrame(made, kind)
    b = a.withColumn("v", F.when(F.col("v") == 17, 0).otherwise(F.col("v")))
    for key in ("d", "t", "z"):
        assert [(r[0], *r[1:]) for r in rows(D.tree_diff_rows(a, b, [key], ["v"]))] == [(made[17]["dtz".index(key)], "changed", "v")]
    assert D.tree_diff_rows(a.limit(0), b.limit(0), ["d"], ["v"]).count() == 0
    assert len(rows(D.tree_diff_rows(a, b.limit(0), ["d"], ["v"]))) == 40
    with pytest.raises(ValueError):
        D.tree_diff_rows(a.withColumn("d", F.lit("x")), b, ["d"], ["v"])


def test_composite_keys_and_rules(spark):
    a = spark.createDataFrame([(1, "p", "x "), (1, "q", "y"), (2, "p", "z")], "k int, l string, v string")
    b = spark.createDataFrame([(1, "p", "x"), (1, "r", "y"), (2, "p", "z")], "k int, l string, v string")
    assert rows(D.tree_diff_rows(a, b, ["k", "l"], ["v"], rules={"v": F.rtrim})) == [(1, "q", "missing", ""), (1, "r", "extra", "")]
    assert len(rows(D.tree_diff_rows(a, b, ["k", "l"], ["v"]))) == 3
