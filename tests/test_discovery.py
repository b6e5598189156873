"""Keys, dependencies and inclusions against enumeration of all sets."""

import random
import time
from itertools import combinations

from verdigris.operators import discovery as D
from verdigris.sources.tables import parquet_table


def keys_brute(rows, cols, most):
    found = []
    for size in range(0 if len(rows) < 2 else 1, most + 1):
        for s in combinations(range(len(cols)), size):
            if not any(set(k) <= set(s) for k in found) and len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                found.append(s)
        if len(rows) < 2:
            return [()]
    return [tuple(cols[i] for i in s) for s in found]


def dependencies_brute(rows, cols, most):
    fixes = lambda x, a: len({tuple(r[i] for i in x) for r in rows}) == len({tuple(r[i] for i in (*x, a)) for r in rows})
    found = []
    for size in range(most + 1):
        for x in combinations(range(len(cols)), size):
            for a in range(len(cols)):
                if a not in x and fixes(x, a) and not any(fixes(y, a) for k in range(size) for y in combinations(x, k)):
                    found.append((tuple(cols[i] for i in x), cols[a]))
    return found


def shuffle_files(spark):
    """Names of the shuffle files that are on disk."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for name in found.split("\n") if "/shuffle_" in name}


def test_keys_and_dependencies_equal_enumeration(spark, monkeypatch):
    monkeypatch.setattr(D, "PART", 3)
    monkeypatch.setattr(D, "SETS", 4)
    rng = random.Random(6)
    for n, wide in ((60, 6), (12, 3), (1, 2), (0, 2)):
        rows = [(i % 10, rng.choice([None, "x", "y"]), (i % 10) // 3, i // 10, rng.choice([1.5, float("nan")]), "c") for i in range(n)]
        df = spark.createDataFrame(rows, "`a.b` int, s string, d int, e int, v double, c string").select("`a.b`", "s", "d", "e", "v", "c")
        plain = [tuple("nan" if x != x else x for x in r) for r in rows]
        assert D.candidate_keys(df, most=wide - 1) == keys_brute(plain, df.columns, wide - 1)
        assert sorted(D.dependencies(df, most=2)) == (sorted(dependencies_brute(plain, df.columns, 2)) if n else [])


def test_keys_take_one_digest_of_each_row_at_a_time_and_leave_no_shuffle(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(D, "FEW", 100, raising=False)
    monkeypatch.setattr(D, "DIGESTS", 1, raising=False)
    rng = random.Random(7)
    rows = [(i // 4, i % 4 if i != 801 else 2, rng.random(), -0.0 if i == 3 else 0.0 if i == 7 else float(i // 2), None if i in (5, 900) else i) for i in range(1000)]
    spark.createDataFrame(rows, "x int, y int, u double, v double, w long").selectExpr("*", "w % 10 as z").repartition(3).write.parquet(f"{tmp_path}/t")
    seen, real = [], D._by_set
    monkeypatch.setattr(D, "_by_set", lambda rows, sets, part, whole=False: (seen.append((part, len(sets), rows)), real(rows, sets, part, whole))[1])
    df = spark.read.parquet(f"{tmp_path}/t")
    plain = [tuple(r) for r in df.collect()]
    before = shuffle_files(spark)
    for table in (df, df.withColumn("x", df["x"] + 0)):  # as it lies, and computed
        assert D.candidate_keys(table, most=3) == keys_brute(plain, df.columns, 3) != []
    for _ in range(100):  # they go in the background
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert {n for part, n, rows in seen if part == 1 and rows.count() == 1000} == {1}


def test_lines_have_no_pair_as_a_key(spark, data):
    lines = parquet_table(spark, data, "lineitem")
    rows = [tuple(r) for r in lines.collect()]
    found = D.candidate_keys(lines, most=3)
    assert found == keys_brute(rows, lines.columns, 3) and all(len(k) > 2 for k in found if "l_extendedprice" not in k)


def test_every_foreign_key_is_found_and_no_other(spark, data):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "documents"]
    tables = {t: parquet_table(spark, data, t) for t in names}
    found = {(r["dependent"], r["referenced"]): (r["n_values"], r["n_missing"]) for r in D.foreign_keys(tables).collect()}
    assert set(found) == {
        ("nation.n_regionkey", "region.r_regionkey"), ("customer.c_nationkey", "nation.n_nationkey"), ("supplier.s_nationkey", "nation.n_nationkey"), ("orders.o_custkey", "customer.c_custkey"),
        ("lineitem.l_orderkey", "orders.o_orderkey"), ("lineitem.l_partkey", "part.p_partkey"), ("lineitem.l_suppkey", "supplier.s_suppkey"), ("labels.doc_id", "documents.doc_id"),
    }
    short = tables | {"customer": tables["customer"].where("c_custkey <> 7")}
    lost = tables["orders"].where("o_custkey = 7").count() > 0
    assert ("orders.o_custkey" in {r["dependent"] for r in D.foreign_keys(short).collect()}) != lost
    assert {r["n_missing"] for r in D.foreign_keys(short, most_missing=1).collect() if r["dependent"] == "orders.o_custkey"} == {int(lost)}


def test_inclusions_equal_brute_force(spark):
    a = spark.createDataFrame([(1, "1", 1.0, None), (2, "2", 2.0, None), (None, None, 3.5, None)], "i int, s string, d double, n string")
    b = spark.createDataFrame([(1, "1"), (2, "2"), (3, "2")], "l long, s string")
    got = {tuple(r) for r in D.inclusions({"a": a, "b": b}).collect()}
    assert got == {("a.i", "b.l", 2, 0, True), ("a.i", "a.d", 2, 0, True), ("a.s", "b.s", 2, 0, False), ("b.s", "a.s", 2, 0, True)}
    assert {tuple(r)[:4] for r in D.inclusions({"a": a, "b": b}, 1).collect()} >= {("b.l", "a.i", 3, 1), ("a.d", "b.l", 3, 1)}
    assert D.inclusions({"a": a.limit(0), "b": b.limit(0)}).count() == 0
