"""Checks in time: as-of joins, and gaps and overlaps of validity intervals.

Both carry a running value along the rows of a key. A key may hold much of a table, so its rows are cut into ``BUCKETS`` stretches of time of which each is
sorted by itself; a stretch begins with what the stretches before it end with, which is found from one combined row for each key and stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.values import free_name, named
from verdigris.operators.digest_tree import as_number

BUCKETS = 256


def _bucketed(rows: DataFrame, time: str, edges: tuple[int, int], buckets: int) -> DataFrame:
    """``__bucket``, the stretch of a time number between the edges."""
    low, high = edges
    width = max(1, -(-(high - low + 1) // buckets))
    at = F.greatest(F.lit(low), F.least(F.lit(high), F.col(time)))
    return rows.withColumn("__bucket", F.call_function("div", at - F.lit(low), F.lit(width)).cast("int"))


def as_of_join(left: DataFrame, right: DataFrame, by: list[tuple[str, str]], time: tuple[str, str], values: list[str], order: list[str] = (), within: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``left`` with the ``values`` of the last row of ``right`` that has its key and is not later.

    ``by`` and ``time`` name the columns of both sides (integral, date or timestamp). Rows of ``right`` at one time are told apart by ``order``, the
    largest being last. With ``within`` (units of the time's number: days, microseconds) older rows do not count. Values are null where
    there is none; null keys equal nothing, and null times are neither before nor after anything. Values named like a column of ``left`` get an underscore.
    """
    number = lambda df, c: as_number(named(c), df.select(named(c)).schema[0].dataType)
    keys = [f"__k{i}" for i in range(len(by))]
    names = list(left.columns)
    for v in values:
        names.append(free_name(v, names))
    one = left.select(*(named(a).alias(k) for (a, _), k in zip(by, keys)), number(left, time[0]).alias("__t"), F.struct(*map(named, left.columns)).alias("__row"))
    found = F.struct(number(right, time[1]).alias("t"), *(named(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*(named(v).alias(f"v{i}") for i, v in enumerate(values))).alias("v"))
    two = right.where(named(time[1]).isNotNull()).select(*(named(b).alias(k) for (_, b), k in zip(by, keys)), found.alias("__found")).withColumn("__t", F.col("__found.t"))
    two = two.where(" and ".join(f"{k} is not null" for k in keys) or "true")
    known = one.where(F.col("__t").isNotNull() & (F.expr(" and ".join(f"{k} is not null" for k in keys)) if keys else F.lit(True)))
    unknown = one.where(F.col("__t").isNull() | (F.expr(" or ".join(f"{k} is null" for k in keys)) if keys else F.lit(False)))
    edges = two.agg(F.min("__t"), F.max("__t")).first()
    if edges[0] is None:
        known, unknown = known.limit(0), one
        edges = (0, 0)
    one, two = _bucketed(known, "__t", tuple(edges), buckets), _bucketed(two, "__t", tuple(edges), buckets)
    # The last row of a stretch goes to every later stretch of the key that has left rows, up to the next one that has right rows of its own.
    ends = two.groupBy(*keys, "__bucket").agg(F.max("__found").alias("__found"))
    stretches = one.select(*keys, "__bucket").distinct().join(ends, [*keys, "__bucket"], "full_outer")
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.withColumn("__found", F.last("__found", True).over(before)).where("__found is not null").withColumn("__t", F.lit(-(2**63)).cast("long"))
    rows = one.select(*keys, "__bucket", "__t", "__row").unionByName(two.select(*keys, "__bucket", "__t", "__found"), True).unionByName(carried.select(*keys, "__bucket", "__t", "__found"), True)
    # At one time right rows come first, the largest last; the carried one comes before all.
    order_by = Window.partitionBy(*keys, "__bucket").orderBy("__t", F.col("__row").isNotNull(), "__found").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__found", F.last("__found", True).over(order_by)).where("__row is not null")
    if within is not None:
        rows = rows.withColumn("__found", F.when(F.col("__t") - F.col("__found.t") <= within, F.col("__found")))
    rows = rows.select("__row", "__found").unionByName(unknown.select("__row"), True)
    return rows.select(*(F.col("__row")[c] for c in left.columns), *(F.col("__found.v")[f"v{i}"] for i in range(len(values)))).toDF(*names)


def interval_faults(df: DataFrame, keys: list[str], start: str, end: str, buckets: int = BUCKETS) -> DataFrame:
    """keys, start, end, previous_end and fault of the intervals that do not begin where the key's intervals before them have ended.

    Intervals are [start, end), a null end being open; they are swept by start, then end. ``previous_end`` is the latest end of all before. fault is gap,
    overlap, or empty for an interval that ends no later than it begins, which is not swept; a null start is told as unknown. Null keys are keys.
    """
    number = lambda c: as_number(named(c), df.select(named(c)).schema[0].dataType)
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*(named(k).alias(n) for k, n in zip(keys, names)), named(start).alias("__start"), named(end).alias("__end"), number(start).alias("__s"), number(end).alias("__e"))
    open_end = F.struct(F.col("__end").isNull().alias("open"), F.col("__e").alias("at"), F.col("__end").alias("end"))
    empty = F.col("__e") <= F.col("__s")
    swept = rows.where(F.col("__s").isNotNull() & F.coalesce(~empty, F.lit(True))).withColumn("__until", open_end)
    edges = swept.agg(F.min("__s"), F.max("__s")).first()
    swept = _bucketed(swept, "__s", (edges[0] or 0, edges[1] or 0), buckets)
    flags = [F.col(n).isNull().alias(f"{n}n") for n in names]
    swept, nulls = swept.select("*", *flags), [f"{n}n" for n in names]
    ends = swept.groupBy(*names, *nulls, "__bucket").agg(F.max("__until").alias("__until"))
    earlier = Window.partitionBy(*names, *nulls).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__until", F.max("__until").over(earlier)).where("__until is not null")
    both = swept.unionByName(carried, True)
    order = Window.partitionBy(*names, *nulls, "__bucket").orderBy(F.asc_nulls_first("__s"), F.asc_nulls_last("__e")).rowsBetween(Window.unboundedPreceding, -1)
    told = both.withColumn("__before", F.max("__until").over(order)).where("__s is not null")
    fault = F.when(F.col("__before.open") | (F.col("__before.at") > F.col("__s")), "overlap").when(F.col("__before.at") < F.col("__s"), "gap")
    told = told.withColumn("__fault", fault).where("__fault is not null").select(*names, "__start", "__end", F.col("__before.end").alias("__previous"), "__fault")
    odd = rows.where(F.col("__s").isNull() | empty).select(*names, "__start", "__end", F.lit(None).cast(told.schema["__previous"].dataType).alias("__previous"), F.when(F.col("__s").isNull(), "unknown").otherwise("empty").alias("__fault"))
    taken = [*keys, start, end]
    for name in ("previous_end", "fault"):
        taken.append(free_name(name, taken))
    return told.unionByName(odd).toDF(*taken)
