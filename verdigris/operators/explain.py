"""Explaining totals that differ: the fewest slices of several dimensions that cover every difference and nothing that agrees.

Counts and sums of each cell (a value of every dimension) take one shuffle; the rest works on cells. A slice fixes some dimensions. It explains something only if all its
cells differ; of such slices those are kept that no wider one contains. Then slices are taken that alone cover some cell, and after
them, one by one, the slice that covers most of what is left.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.session import written
from verdigris.functions.values import canonical, named

MOST_DIMENSIONS, MOST_PICKS = 8, 50


def cells(src: DataFrame, tgt: DataFrame, dims: list[str], measure: str | None, scale: int) -> DataFrame:
    """d0, d1 ... (dimensions as text), n and total of both sides, and whether they differ."""
    kind = f"decimal(38,{scale})"

    def side(df: DataFrame, which: str, other: str) -> DataFrame:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        keys = [canonical(named(d), kinds[d]).alias(f"d{i}") for i, d in enumerate(dims)]
        total = (named(measure).try_cast(kind) if measure else F.lit(None)).cast(kind)
        return df.select(*keys, F.lit(1).alias(f"n_{which}"), F.lit(0).alias(f"n_{other}"), total.alias(f"total_{which}"), F.lit(None).cast(kind).alias(f"total_{other}"))

    both = side(src, "source", "target").unionByName(side(tgt, "target", "source"))
    sums = [F.sum(f"n_{x}").alias(f"n_{x}") for x in ("source", "target")] + [F.try_sum(f"total_{x}").cast(kind).alias(f"total_{x}") for x in ("source", "target")]
    rows = both.groupBy(*(f"d{i}" for i in range(len(dims)))).agg(*sums)
    same = F.col("n_source").eqNullSafe(F.col("n_target")) & F.coalesce("total_source", F.lit(0)).eqNullSafe(F.coalesce("total_target", F.lit(0)))
    return rows.withColumn("differs", ~same)


def _slices(count: int) -> list[tuple[int, ...]]:
    return [s for k in range(count + 1) for s in combinations(range(count), k)]


def _in_slices(rows: DataFrame, count: int, keep: list[str]) -> DataFrame:
    """A row for each cell and slice that it lies in: mask (the fixed dimensions) and key, an array with null flags."""
    def key(fixed: tuple[int, ...]) -> Column:
        return F.array(*(F.coalesce(F.concat(F.lit("V"), F.col(f"d{i}")), F.lit("N")) if i in fixed else F.lit("*") for i in range(count)))

    told = F.array(*(F.struct(F.lit(sum(1 << i for i in s)).alias("mask"), F.lit(len(s)).alias("fixed"), key(s).alias("key")) for s in _slices(count)))
    return rows.select(F.explode(told).alias("x"), *keep).select("x.*", *keep)


def explain_totals(src: DataFrame, tgt: DataFrame, dims: list[str], measure: str | None = None, scale: int = 2, most: int = MOST_PICKS) -> DataFrame:
    """slice (dimension=value, comma-joined; "all"), n_dims, n_cells, n_source, n_target, total_source and total_target of the slices that explain what differs.

    Row counts are compared, and with a ``measure`` its decimal sums. Null is a value of a dimension, written as such. Slices may overlap.
    After ``most`` slices that were taken one by one, all others that cover something still open are told, so that nothing stays unexplained.
    """
    if not 0 < len(dims) <= MOST_DIMENSIONS:
        raise ValueError(f"one to {MOST_DIMENSIONS} dimensions, not {len(dims)}")
    count, facts = len(dims), ["n_source", "n_target", "total_source", "total_target"]
    rows = written(cells(src, tgt, dims, measure, scale).withColumn("cell", F.array(*(F.coalesce(F.concat(F.lit("V"), F.col(f"d{i}")), F.lit("N")) for i in range(count)))))
    kind = f"decimal(38,{scale})"
    wide = _in_slices(rows, count, ["differs", *facts]).groupBy("mask", "fixed", "key").agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("differs").alias("full"), *(F.sum(x).alias(x) for x in facts[:2]), *(F.try_sum(x).cast(kind).alias(x) for x in facts[2:])
    )
    full = written(wide.where("full").drop("full"))
    # A slice is contained in those that fix one dimension less.
    parents = F.transform(F.filter(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.get("key", i) != "*"), lambda i: F.transform("key", lambda x, j: F.when(j == i, F.lit("*")).otherwise(x)))
    narrow = full.select("key", F.explode(parents).alias("parent")).join(full.select(F.col("key").alias("parent")), "parent", "left_semi").select("key").distinct()
    widest = written(full.join(narrow, "key", "left_anti"))
    covers = written(_in_slices(rows.where("differs"), count, ["cell"]).select("key", "fixed", "cell").join(widest.select("key"), "key", "left_semi"))
    needed = covers.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n = 1").select("key").distinct()
    taken, left = [needed], written(covers.join(covers.join(needed, "key", "left_semi").select("cell").distinct(), "cell", "left_anti"))
    for _ in range(most):
        best = left.groupBy("key", "fixed").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "fixed", "key").limit(1).collect()
        if not best:
            break
        pick = src.sparkSession.range(1).select(F.array(*map(F.lit, best[0]["key"])).alias("key"))
        taken.append(pick)
        left = written(left.join(left.join(F.broadcast(pick), "key", "left_semi").select("cell").distinct(), "cell", "left_anti"))
    taken.append(left.select("key").distinct())
    chosen = taken[0]
    for more in taken[1:]:
        chosen = chosen.unionByName(more)
    # Flags keep a null and a text apart; the names of the dimensions come back last.
    parts = F.array(*(F.when(F.col("key")[i] != "*", F.concat(F.lit(f"{d}="), F.when(F.col("key")[i] == "N", F.lit("null")).otherwise(F.substr(F.col("key")[i], F.lit(2))))) for i, d in enumerate(dims)))
    name = F.when(F.col("fixed") == 0, F.lit("all")).otherwise(F.array_join(parts, ","))
    return widest.join(chosen.distinct(), "key", "left_semi").select(name.alias("slice"), F.col("fixed").alias("n_dims"), "n_cells", *facts)
