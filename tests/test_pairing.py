"""Changed rows are paired with their sources without a key."""

import glob
import random
import time

from pyspark.sql import functions as F

from verdigris.functions import session
from verdigris.operators import pairing
from verdigris.operators.pairing import pair_changed
from verdigris.sources.tables import parquet_table


def told(df):
    return sorted(((r["status"], r["n"], r["changed"], r["source"] and tuple(r["source"]), r["target"] and tuple(r["target"])) for r in df.collect()), key=str)


def test_every_changed_line_finds_its_source(spark, data):
    src = parquet_table(spark, data, "lineitem")
    key = F.col("l_orderkey")
    damaged = src.withColumn("l_quantity", F.when(key % 53 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    tgt = damaged.where(key % 83 != 0).withColumn("l_returnflag", F.when(key % 71 == 0, F.lit(None)).otherwise(F.col("l_returnflag")))
    want = {tuple(r) for r in src.where((key % 53 == 0) & (key % 83 != 0) & (key % 71 != 0)).collect()}
    found = pair_changed(src, tgt).collect()
    pairs = [r for r in found if r["status"] == "changed" and r["changed"] == "l_quantity"]
    assert {tuple(r["source"]) for r in pairs} == want and len(pairs) == len(want)
    for r in pairs:
        one, two = r["source"].asDict(), r["target"].asDict()
        assert two.pop("l_quantity") == one.pop("l_quantity") + 1 and one == two
    assert sum(r["status"] == "extra" and r["source"] is None for r in found) == sum(r["target"]["l_orderkey"] % (53 * 71) == 0 for r in found if r["status"] == "extra")
    assert sum(r["status"] == "missing" for r in found) == src.where(key % 83 == 0).count() + src.where((key % (53 * 71) == 0) & (key % 83 != 0)).count()


def test_copies_nulls_and_ties(spark):
    kind = "`a.b` string, surplus int, v double"
    src = spark.createDataFrame([("p", 1, 1.0)] * 3 + [("q", 2, 5.0), (None, None, None), ("z", 9, 9.0)], kind)
    tgt = spark.createDataFrame([("p", 1, 2.0)] * 2 + [("p", 1, 7.0), ("q", 2, 1.0), ("q", 2, 6.0), (None, 3, None)], kind)
    assert told(pair_changed(src, tgt)) == sorted([
        ("changed", 2, "v", ("p", 1, 1.0), ("p", 1, 2.0)), ("changed", 1, "v", ("p", 1, 1.0), ("p", 1, 7.0)), ("changed", 1, "v", ("q", 2, 5.0), ("q", 2, 6.0)),
        ("extra", 1, "", None, ("q", 2, 1.0)), ("changed", 1, "surplus", (None, None, None), (None, 3, None)), ("missing", 1, "", ("z", 9, 9.0), None),
    ], key=str)
    assert told(pair_changed(src, src)) == [] and pair_changed(src.limit(0), src.limit(0)).count() == 0
    assert {r[0] for r in told(pair_changed(src, tgt.limit(0)))} == {"missing"}


def test_two_changed_columns_and_given_blocks(spark):
    kind = "k string, x int, y int, z int"
    src, tgt = spark.createDataFrame([("a", 1, 1, 1), ("b", 5, 5, 5)], kind), spark.createDataFrame([("a", 1, 2, 2), ("b", 5, 5, 6)], kind)
    assert [r[0] for r in told(pair_changed(src, tgt))] == ["changed", "extra", "missing"]
    both = [("changed", 1, "y,z", ("a", 1, 1, 1), ("a", 1, 2, 2)), ("changed", 1, "z", ("b", 5, 5, 5), ("b", 5, 5, 6))]
    assert told(pair_changed(src, tgt, most_changed=2)) == told(pair_changed(src, tgt, blocks=[["k"]])) == both


def test_large_blocks_are_paired_whole(spark, monkeypatch):
    """A block beyond ``SMALL`` is ranked, one beyond ``PIECE`` dealt out; nobody stays alone, and no pairs of all with all arise."""
    monkeypatch.setattr(pairing, "PIECE", 40)
    rng = random.Random(4)
    src = spark.createDataFrame([("same", i) for i in rng.sample(range(10_000), 300)], "k string, v int")
    tgt = spark.createDataFrame([("same", 10_000 + i) for i in rng.sample(range(10_000), 260)], "k string, v int")
    seen = []
    real = pairing.assigned
    monkeypatch.setattr(pairing, "assigned", lambda pairs: (seen.append(pairs.count()), real(pairs))[1])
    found = told(pair_changed(src, tgt, blocks=[["k"]]))
    assert [r[0] for r in found].count("changed") == 260 and [r[0] for r in found].count("missing") == 40
    assert len({r[3] for r in found}) == 300 and max(seen) <= 300


def test_parts_and_blocks_one_at_a_time_give_the_same_and_leave_no_shuffle(spark, monkeypatch):
    """-0.0 is 0.0, NaN is NaN and null is null in every part; what is on disk is what the result reads."""
    rng = random.Random(8)
    nan = float("nan")
    rows = [(i // 3, rng.choice(["x", "y", None]), rng.choice([nan, 0.0, 1.5, None]), rng.randrange(50), i % 7) for i in range(400)]
    other = [(k, s, -0.0 if v == 0.0 else v, m + 1 if i % 10 == 3 else m, z) for i, (k, s, v, m, z) in enumerate(rows) if i % 23] + rows[:9]
    src = spark.createDataFrame(rows, "k int, s string, v double, m int, z int")
    tgt = spark.createDataFrame(other, "k long, s string, v double, m int, z int")
    files = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    tables = lambda: {f for f in glob.glob(f"{session.shared_folder(spark, 'x').removeprefix('file:').rpartition('/')[0]}/table_*")}
    want = told(pair_changed(src, tgt))
    assert {r[0] for r in want} == {"changed", "missing", "extra"}
    monkeypatch.setattr(pairing, "PART_ROWS", 100, raising=False)
    monkeypatch.setattr(pairing, "DIGESTS", 1, raising=False)
    before = files(), tables()
    found = pair_changed(src, tgt)
    for _ in range(100):  # they go in the background
        if files() <= before[0]:
            break
        time.sleep(0.1)
    assert files() <= before[0]
    # The rows, what is left of them, and the pairs of each round, the last without any.
    pairs = len({f for f in tables() - before[1] if {"a", "b"} <= set(spark.read.parquet(f).columns)})
    assert pairs >= 2 and len(tables() - before[1]) == pairs + 2
    assert str(told(found)) == str(want)  # NaN is not itself in Python
