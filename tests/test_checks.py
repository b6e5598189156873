"""The migration checks: hand-made hard cases, and every registered query against its SQL."""

import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from verdigris.functions.values import approx_equal
from verdigris.operators import compare, inspect
from verdigris.plans import queries as plans
from verdigris.plans import search_queries
from verdigris.plans.report import compare_tables
from verdigris.sources.tables import jdbc_table, parquet_table, write_report


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_null_keys_match_and_nulls_differ_from_values(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "z"), (None, "y"), (4, None)], "k int, v string")
    assert rows(compare.key_diff(a, b, ["k"], ["v"])) == [("changed", 1), ("extra", 1), ("match", 1), ("missing", 1)]
    assert rows(compare.column_diff(a, b, ["k"], ["v"])) == [("v", 2, 1)]


def test_duplicate_keys_are_told_and_not_compared(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "p"), (None, "q")], "k int, v string")
    assert rows(compare.key_diff(a, a, ["k"], ["v"])) == [("duplicate", 2), ("match", 1)]
    assert rows(compare.column_diff(a, a, ["k"], ["v"])) == [("v", 1, 0)]
    assert rows(compare.key_diff_rows(a, a, ["k"], ["v"])) == [(1, "duplicate", ""), (None, "duplicate", "")]
    found = {r["check_name"]: r["status"] for r in compare_tables("t", a, a, ["k"], ["v"]).collect()}
    assert found["duplicate_keys"] == "fail" and found["row_count"] == "pass"


def test_nested_values_and_maps(spark):
    kind = "k int, l array<string>, m map<string,array<int>>, s struct<a:string,b:string>"
    a = spark.createDataFrame([(1, ["a, b"], {"x": [1], "y": None}, ("p", None)), (2, [], {}, (None, "p")), (3, None, None, None)], kind)
    b = spark.createDataFrame([(1, ["a", "b"], {"y": None, "x": [1]}, ("p", None)), (2, [None], {"x": [1]}, (None, "p")), (3, [], None, (None, None))], kind)
    cols = ["l", "m", "s"]
    assert rows(compare.key_diff_rows(a, b, ["k"], cols)) == [(1, "changed", "l"), (2, "changed", "l,m"), (3, "changed", "l,s")]
    for c, same in (("l", 0), ("m", 2), ("s", 2)):
        one, two = (dict(rows(compare.fingerprint(x, ["k"], [c]))) for x in (a, b))
        assert sum(one[k] == two[k] for k in one) == same and len(set(one.values())) == 3
    assert {(r["column"], r["n_null"], r["n_distinct"]) for r in inspect.profile(a, cols).collect()} == {("l", 1, 2), ("m", 1, 2), ("s", 1, 2)}
    assert rows(compare.key_diff(a, a, ["m"], ["k"])) == [("match", 3)]


def test_values_that_round_alike_stay_apart(spark):
    df = spark.createDataFrame([(1, 1.001), (2, 1.002), (3, -0.0), (4, 0.0), (5, float("nan")), (6, 1e300)], "k int, v double")
    assert [r["n_distinct"] for r in inspect.profile(df, ["v"]).collect()] == [5]
    assert len({r[1] for r in compare.fingerprint(df, ["k"], ["v"]).collect()}) == 5
    assert len({r[1] for r in compare.fingerprint(df, ["k"], ["v"], 2).collect()}) == 4


def test_sums_beyond_decimals_do_not_agree(spark):
    a = spark.createDataFrame([("g", 1e17), ("g", 2.0), ("h", 1e40), ("h", 1.0), ("i", 9e35), ("i", 9e35), ("n", None)], "g string, v double")
    found = {r["g"]: (r["v_source"] and float(r["v_source"]), r["v_overflow"], r["agrees"]) for r in compare.group_reconcile(a, a, ["g"], ["v"]).collect()}
    assert found == {"g": (1e17, 0, True), "h": (1.0, 2, False), "i": (None, 0, False), "n": (None, 0, True)}


def test_rules_and_nullability(spark):
    a, b = (spark.createDataFrame([(1, x)], "k int, v string") for x in ("x ", "x"))
    assert rows(compare.key_diff(a, b, ["k"], ["v"])) == [("changed", 1)] and rows(compare.key_diff(a, b, ["k"], ["v"], {"v": F.rtrim})) == [("match", 1)]
    c = spark.createDataFrame([(1, "x")], StructType([StructField("k", IntegerType(), False), StructField("v", StringType())]))
    assert rows(compare.schema_diff(a, c)) == [] and rows(compare.schema_diff(a, c, True)) == [("k", "int", "int not null", "retyped")]


def test_bag_diff_counts_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int")
    b = spark.createDataFrame([(1,), (2,), (3,), (None,)], "v int")
    assert rows(compare.bag_diff(a, b)) == [(1, 1), (3, -1)]


def test_fingerprints_tell_null_places_apart(spark):
    df = spark.createDataFrame([(1, None, "1"), (2, "1", None), (3, "1", "")], "k int, a string, b string")
    assert len({r[1] for r in compare.fingerprint(df, ["k"], ["a", "b"]).collect()}) == 3


def test_approx_equal_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, 1.004), (1.0, 1.1), (float("nan"), float("nan")), (None, None), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(approx_equal(df.a, df.b, 0.01)).collect()] == [True, False, True, True, False]


def test_schema_diff_and_empty_tables(spark):
    a = spark.createDataFrame([], "k int, v string, gone int")
    b = spark.createDataFrame([], "k bigint, v string, more int")
    assert rows(compare.schema_diff(a, b)) == [("gone", "int", None, "missing"), ("k", "int", "bigint", "retyped"), ("more", None, "int", "extra")]
    assert rows(compare.row_count(a, b)) == [(0, 0, 0)]
    assert compare.bag_diff(a, a).count() == 0
    assert {r["status"] for r in compare_tables("t", a, a, ["k"], ["v"]).collect()} == {"pass"}


def test_orphans_duplicates_and_casts(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "fk int")
    parent = spark.createDataFrame([(1,)], "pk int")
    assert rows(inspect.orphans(child, parent, "fk", "pk")) == [(2, 2)]
    assert rows(inspect.duplicate_keys(child, ["fk"])) == [(2, 2)]
    texts = spark.createDataFrame([(1, "7"), (2, "x"), (3, None)], "k int, v string")
    assert rows(inspect.cast_failures(texts, ["k"], "v", "int")) == [(2, "x")]


def test_damaged_orders_have_the_known_differences(spark, data):
    counts = dict(rows(plans.c3_key_diff(spark, "/root/testdata/sf0.01")))
    assert counts == {"match": 14532, "changed": 299, "missing": 169, "extra": 72}


def test_jdbc_round_trip_keeps_timestamps(spark, data, tmp_path):
    url = "jdbc:derby:memory:verdigris;create=true"
    orders = parquet_table(spark, data, "orders").limit(200)
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    orders.write.format("jdbc").option("url", url).option("dbtable", "o").option("createTableColumnTypes", "o_orderstatus varchar(8), o_orderpriority varchar(32)").options(**options).save()
    back = jdbc_table(spark, url, "o", column="o_orderkey", low=0, high=2000, partitions=3, **options)
    assert compare.bag_diff(orders, back.select(*orders.columns)).count() == 0
    write_report(compare.row_count(orders, back), str(tmp_path / "report"))
    assert rows(spark.read.parquet(str(tmp_path / "report"))) == [(200, 200, 0)]


@pytest.mark.parametrize("name", sorted(plans.QUERIES | search_queries.QUERIES))
def test_query_equals_its_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    df = (plans.QUERIES | search_queries.QUERIES)[name](spark, data)
    found = con.execute((plans.ORACLE_SQL | search_queries.ORACLE_SQL)[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    text = lambda values, names: sorted(tuple(str(v) for _, v in sorted(zip(names, r))) for r in values)
    assert text(df.collect(), df.columns) == text(found.fetchall(), columns)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_instants_at_a_clock_change_stay_apart(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("select id as k, timestamp_micros(1636263000000000 + id * 3600000000) as v from range(2)")
        assert [r["n_distinct"] for r in inspect.profile(df, ["v"]).collect()] == [2]
        there = rows(compare.fingerprint(df, ["k"], ["v"]))
        assert there[0][1] != there[1][1] and inspect.profile(df, ["v"]).first()["least"] == "2021-11-07 05:30:00.000000Z"
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert rows(compare.fingerprint(df, ["k"], ["v"])) == there
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_tolerance_beyond_the_type(spark):
    df = spark.sql("select * from values (9223372036854775807, -1L), (-9223372036854775808, 1L), (5L, 6L), (null, 1L), (-9223372036854775808, -9223372036854775807) as t(a, b)")
    assert [r[0] for r in df.select(approx_equal(F.col("a"), F.col("b"), 1.0)).collect()] == [False, False, True, False, True]
    wide = spark.sql("select cast(99999999999999999999999999999999999999 as decimal(38,0)) as a, cast(-99999999999999999999999999999999999999 as decimal(38,0)) as b")
    assert not wide.select(approx_equal(F.col("a"), F.col("b"), 1e9)).first()[0]


def test_retyped_columns_are_changed_and_retyped_keys_refused(spark):
    a = spark.sql("select * from values (1, '7', date'2024-01-01', 1), (2, 'x', null, 2), (3, null, null, 3) as t(k, v, d, n)")
    b = spark.sql("select * from values (1, 7L, timestamp_ntz'2024-01-01', 1.0), (2, 8L, null, 2.5), (3, null, null, 3) as t(k, v, d, n)")
    assert rows(compare.key_diff_rows(a, b, ["k"], ["v", "d", "n"])) == [(1, "changed", "v,d"), (2, "changed", "v,n")]
    assert rows(compare.column_diff(a, b, ["k"], ["v", "d", "n"])) == [("d", 3, 1), ("n", 3, 1), ("v", 3, 2)]
    with pytest.raises(ValueError, match="key v is string"):
        compare.key_diff(a, b, ["v"], ["k"])
    assert rows(compare.key_diff(a.withColumn("v", F.expr("try_cast(v as bigint)")), b, ["v"], ["k"])) == [("duplicate", 1), ("extra", 1), ("match", 1)]


def test_nothing_to_compare_is_reported(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, V string"), spark.createDataFrame([(1, 5), (2, 6)], "k int, w int")
    found = {(r["check_name"], r["column_name"], r["status"]) for r in compare_tables("t", a, b, ["k"], ["V"]).collect()}
    assert found == {("row_count", None, "fail"), ("schema", "V", "fail"), ("schema", "w", "fail"), ("key_diff", "extra", "fail"), ("duplicate_keys", None, "pass")}
    c = spark.createDataFrame([(1, "y")], "k int, v string")
    assert rows(compare.schema_diff(a, c)) == [("V", "string", "string", "recased")]
    assert rows(compare.schema_diff(a, spark.createDataFrame([], "k int, v int"))) == [("V", "string", "int", "recased"), ("V", "string", "int", "retyped")]
    found = {(r["check_name"], r["column_name"]): r["target_value"] for r in compare_tables("t", a, c, ["k"], ["V"]).collect()}
    assert found["column_diff", "V"] == "1" and found["schema", "V"] == "string" and ("key_diff", "changed") in found
    assert compare.column_diff(a, c, ["k"], []).count() == inspect.profile(a, []).count() == 0


def test_names_that_clash_or_hold_dots(spark):
    a = spark.createDataFrame([(1, "x", 1, 2.0), (1, "x", 1, 2.0), (2, "y", 2, 3.0)], "status int, `a.b` string, surplus int, n double")
    b = spark.createDataFrame([(1, "x", 1, 2.0), (3, "y", 2, 3.0)], "status int, `a.b` string, surplus int, n double")
    assert compare.bag_diff(a, b).columns == ["status", "a.b", "surplus", "n", "surplus_"] and compare.bag_diff(a, b).count() == 3
    assert compare.key_diff_rows(a, b, ["status"], ["a.b"]).columns == ["status", "status_", "changed"]
    assert rows(compare.key_diff(a, b, ["a.b"], ["n"])) == [("duplicate", 1), ("match", 1)]
    assert rows(inspect.duplicate_keys(a, ["n"])) == [(2.0, 2)] and inspect.duplicate_keys(a, ["n"]).columns == ["n", "n_"]
    grouped = compare.group_reconcile(a.withColumnRenamed("status", "n_source"), b.withColumnRenamed("status", "n_source"), ["n_source", "a.b"], ["n"])
    assert grouped.columns == ["n_source", "a.b", "n_source_", "n_target", "n_source__", "n_target_", "n_overflow", "agrees"] and grouped.count() == 3
    assert {r["column"]: r["n_distinct"] for r in inspect.profile(a, ["a.b", "n"]).collect()} == {"a.b": 2, "n": 2}
    assert compare.fingerprint(a, ["a.b"], ["n"]).columns == ["a.b", "fingerprint"] and compare.table_checksum(a, a.columns).count() >= 1
    assert rows(inspect.orphans(a, b, "a.b", "a.b")) == [] and compare.domain_diff(a, b, "a.b").count() == 2


def test_maps_as_foreign_keys_and_groups(spark):
    a = spark.createDataFrame([({"x": 1, "y": 2}, 1.0), ({"z": 1}, 2.0), (None, 3.0)], "m map<string,int>, v double")
    b = spark.createDataFrame([({"y": 2, "x": 1}, 1.0)], "m map<string,int>, v double")
    assert [r["n"] for r in inspect.orphans(a, b, "m", "m").collect()] == [1]
    assert sorted(r["agrees"] for r in compare.group_reconcile(a, b, ["m"], ["v"]).collect()) == [False, False, True]
    assert compare.domain_diff(a, b, "m").count() == 3
