"""As-of joins and interval sweeps against brute force, whatever the number of stretches."""

import datetime as dt
import random

import pytest

from verdigris.operators.temporal import as_of_join, interval_faults


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("buckets, within", [(1, None), (7, None), (256, 40)])
def test_as_of_join_equals_brute_force(spark, buckets, within):
    rng = random.Random(buckets)
    left = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(-20, 320)]), i) for i in range(150)]
    right = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(0, 300, 7)]), i, rng.choice([None, "x", "y"])) for i in range(120)]
    a, b = spark.createDataFrame(left, "k string, t int, n int"), spark.createDataFrame(right, "`k.r` string, u int, n int, v string")
    want = []
    for k, t, n in left:
        fits = [r for r in right if k is not None and r[0] == k and t is not None and r[1] is not None and r[1] <= t and (within is None or t - r[1] <= within)]
        best = max(fits, key=lambda r: (r[1], r[2])) if fits else (None,) * 4
        want.append((k, t, n, best[2], best[3]))
    found = as_of_join(a, b, [("k", "k.r")], ("t", "u"), ["n", "v"], ["n"], within, buckets)
    assert found.columns == ["k", "t", "n", "n_", "v"] and rows(found) == sorted(want, key=str)
    assert rows(as_of_join(a, b.limit(0), [("k", "k.r")], ("t", "u"), ["v"], buckets=buckets)) == sorted(((*r, None) for r in left), key=str)
    assert as_of_join(a.limit(0), b, [("k", "k.r")], ("t", "u"), ["v"], buckets=buckets).count() == 0


@pytest.mark.parametrize("buckets", [1, 5, 256])
def test_interval_faults_equal_brute_force(spark, buckets):
    rng = random.Random(buckets)
    made = []
    for k in ["a", "b", None]:
        at = 0
        for _ in range(40):
            n = rng.randint(1, 9)
            made.append((k, at + rng.choice([0, 0, 0, 0, -3, 2]), at + n))
            at += n
    made += [("c", 1, None), ("c", 5, 6), ("c", 1, 3), ("d", None, 4), ("d", 4, 4), ("d", 9, 2), ("e", 1, 2), ("e", 1, 2)]
    want = []
    for k in {r[0] for r in made}:
        until = None
        for _, s, e in sorted((r for r in made if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0, r[2] is None, r[2] or 0)):
            if s is None or (e is not None and e <= s):
                want.append((k, s, e, None, "unknown" if s is None else "empty"))
                continue
            if until is not None and until != s:
                want.append((k, s, e, None if until == 10**9 else until, "overlap" if until > s else "gap"))
            until = max(until if until is not None else s, 10**9 if e is None else e)
    df = spark.createDataFrame(made, "k string, s int, e int")
    assert rows(interval_faults(df, ["k"], "s", "e", buckets)) == sorted(want, key=str)
    assert interval_faults(df.limit(0), ["k"], "s", "e", buckets).count() == 0


def test_times_of_other_types(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(1, day, day + dt.timedelta(2)), (1, day + dt.timedelta(3), None)], "k int, fault date, e date")
    assert rows(interval_faults(df, ["k"], "fault", "e")) == [(1, day + dt.timedelta(3), None, day + dt.timedelta(2), "gap")]
    assert interval_faults(df, ["k"], "fault", "e").columns == ["k", "fault", "e", "previous_end", "fault_"]
    at = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 3))], "k int, t timestamp_ntz")
    assert rows(as_of_join(at, at.withColumnRenamed("t", "u"), [("k", "k")], ("t", "u"), ["u"], within=0))[0][2] == dt.datetime(2024, 1, 2, 3)
