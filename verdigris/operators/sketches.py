"""Profiles by mergeable sketches, and what follows from them: drift between two sides and renamed columns.

One pass over a table gives a row for each column with exact row and null counts and three sketches: of distinct values (theta, the
smallest hashes), of quantiles (KLL, for numbers, dates and times) and of frequent values. Tasks combine theirs before the one small shuffle, no
value is shuffled. Sketches of parts of a table, of days or of shards, merge into those of the whole.

Bounds, of the sketches' own theory: distinct counts are exact up to 2**``LOG_DISTINCT`` values, and beyond within ``DISTINCT_ERROR``
(three standard errors); ranks of quantiles are within ``RANK_ERROR``; counts of frequent values are exact while no more than three quarters of
``TRACKED`` values occur. Profiles that must be exact are ``inspect.profile``'s.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, TimestampNTZType, TimestampType

from verdigris.functions.values import canonical, family, named
from verdigris.operators.digest_tree import as_number

LOG_DISTINCT, TRACKED, KLL = 12, 8192, 400
DISTINCT_ERROR, RANK_ERROR = 3 / 2 ** (LOG_DISTINCT / 2), 0.01
QUANTILES = [0.0, 0.25, 0.5, 0.75, 1.0]


def _text(column: Column, kind: DataType) -> Column:
    """A value as text that is alike for equal numbers of whatever type."""
    return canonical(column.cast("double"), DoubleType()) if family(kind) == "number" else canonical(column, kind)


def _ordered(column: Column, kind: DataType) -> Column | None:
    """A value as a double in the type's order; NaN has no rank."""
    if family(kind) == "number":
        number = column.cast("double")
        return F.when(~F.isnan(number), number)
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return as_number(column, kind).cast("double")
    return None


def sketches(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, kind, n_rows, n_null, distinct, ordered, frequent): the sketches of each column; ordered is null for types without ranks."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    texts = df.select(*(named(c).alias(f"v{i}") for i, c in enumerate(cols)), *(_text(named(c), kinds[c]).alias(f"t{i}") for i, c in enumerate(cols)))
    facts = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(cols):
        number = _ordered(F.col(f"v{i}"), kinds[c])
        facts += [
            F.count(F.when(F.col(f"v{i}").isNull(), 1)).alias(f"n{i}"),
            F.theta_sketch_agg(F.col(f"t{i}"), LOG_DISTINCT).alias(f"d{i}"),
            (F.lit(None).cast("binary") if number is None else F.kll_sketch_agg_double(number, KLL)).alias(f"o{i}"),
            F.expr(f"approx_top_k_accumulate(t{i}, {TRACKED})").alias(f"f{i}"),
        ]
    wide = texts.agg(*facts)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c].simpleString()).alias("kind"), "n_rows", *(F.col(f"{x}{i}").alias(n) for x, n in (("n", "n_null"), ("d", "distinct"), ("o", "ordered"), ("f", "frequent")))) for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def merged(parts: list[DataFrame]) -> DataFrame:
    """The sketches of a whole, of those of its parts; columns are told apart by name and type."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("column", "kind").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.theta_union_agg("distinct", LOG_DISTINCT).alias("distinct"),
        F.kll_merge_agg_double("ordered", KLL).alias("ordered"), F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"),
    )


def sketch_profile(rows: DataFrame, quantiles: list[float] = QUANTILES, top: int = 5) -> DataFrame:
    """(column, kind, n_rows, n_null, n_distinct, quantiles, top) of sketches. quantiles are doubles (days, microseconds for times), null without values."""
    # Null is counted among the frequent values; it is told as n_null.
    values = F.slice(F.filter(F.expr(f"approx_top_k_estimate(frequent, {top + 1})"), lambda x: x["item"].isNotNull()), 1, top)
    known = F.when(F.col("ordered").isNotNull(), F.kll_sketch_get_n_double("ordered"))
    at = F.when(known > 0, F.array(*(F.kll_sketch_get_quantile_double("ordered", F.lit(q)) for q in quantiles)))
    return rows.select("column", "kind", "n_rows", "n_null", F.theta_sketch_estimate("distinct").alias("n_distinct"), at.alias("quantiles"), values.alias("top"))


def shared(a: Column, b: Column) -> Column:
    """The share of the distinct values of two sketches that both have (Jaccard); 0 without any."""
    both = F.theta_sketch_estimate(F.theta_intersection(a, b))
    either = F.theta_sketch_estimate(F.theta_union(a, b, LOG_DISTINCT))
    return F.when(either > 0, F.least(both / either, F.lit(1.0))).otherwise(0.0)


def drift(a: DataFrame, b: DataFrame, steps: int = 100) -> DataFrame:
    """(column, n_rows_source, n_rows_target, null_gap, shared_values, rank_gap) of two sides' sketches, by column.

    null_gap is the difference of the null shares, shared_values the Jaccard share of distinct values, rank_gap the largest difference of ranks at
    any of ``steps`` quantiles of either side (the Kolmogorov-Smirnov distance, within 1 / steps and twice ``RANK_ERROR``), null where there are none.
    """
    one, two = (df.select("column", F.struct("n_rows", "n_null", "distinct", "ordered").alias(x)) for df, x in ((a, "s"), (b, "t")))
    share = lambda x: F.col(f"{x}.n_null") / F.greatest(F.col(f"{x}.n_rows"), F.lit(1))
    ranked = F.when((F.kll_sketch_get_n_double("s.ordered") > 0) & (F.kll_sketch_get_n_double("t.ordered") > 0), F.lit(True))
    cuts = [F.kll_sketch_get_quantile_double(f"{x}.ordered", F.array(*(F.lit(k / steps) for k in range(steps + 1)))) for x in "st"]
    rank = lambda values, v: F.size(F.filter(values, lambda x: x <= v)) / F.lit(steps + 1)
    gap = F.array_max(F.transform(F.concat(*cuts), lambda v: F.abs(rank(cuts[0], v) - rank(cuts[1], v))))
    return one.join(two, "column").select(
        "column", F.col("s.n_rows").alias("n_rows_source"), F.col("t.n_rows").alias("n_rows_target"), (share("t") - share("s")).alias("null_gap"),
        shared(F.col("s.distinct"), F.col("t.distinct")).alias("shared_values"), F.when(ranked, gap).alias("rank_gap"),
    )


def renamed_columns(src: DataFrame, tgt: DataFrame, least: float = 0.8) -> DataFrame:
    """(source_column, target_column, source_type, target_type, shared_values, n_distinct_source, n_distinct_target): likely renamings.

    Columns that the target lacks are held against those that it has in addition, in one pass of each side: pairs of types that
    compare, whose distinct values are shared to ``least``. A pair is told if each is the other's best: most shared values, then the nearest
    null share, the nearest name, and the names themselves. Without candidates the result is empty.
    """
    lacks, more = [c for c in src.columns if c not in tgt.columns], [c for c in tgt.columns if c not in src.columns]
    one, two = (sketches(df, cols) if cols else sketches(df.select(F.lit(None).cast("string").alias("x")), ["x"]).limit(0) for df, cols in ((src, lacks), (tgt, more)))
    alike = [(a, b) for a in lacks for b in more if family(next(f.dataType for f in src.schema.fields if f.name == a)) == family(next(f.dataType for f in tgt.schema.fields if f.name == b))]
    wanted = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in alike)).cast("array<struct<a:string,b:string>>")
    pairs = src.sparkSession.range(1).select(F.explode(wanted).alias("p")).select("p.*")
    facts = lambda df, x, y: df.select(F.col("column").alias(x), F.struct("kind", "n_rows", "n_null", "distinct").alias(y))
    rows = pairs.join(facts(one, "a", "s"), "a").join(facts(two, "b", "t"), "b")
    nulls = F.abs(F.col("s.n_null") / F.greatest(F.col("s.n_rows"), F.lit(1)) - F.col("t.n_null") / F.greatest(F.col("t.n_rows"), F.lit(1)))
    rows = rows.select("a", "b", F.col("s.kind").alias("source_type"), F.col("t.kind").alias("target_type"), shared(F.col("s.distinct"), F.col("t.distinct")).alias("shared_values"), nulls.alias("nulls"), F.theta_sketch_estimate("s.distinct").alias("n_distinct_source"), F.theta_sketch_estimate("t.distinct").alias("n_distinct_target"))
    order = [F.desc("shared_values"), "nulls", F.levenshtein(F.lower("a"), F.lower("b")), "a", "b"]
    first = lambda x: F.row_number().over(Window.partitionBy(x).orderBy(*order)) == 1
    best = rows.where(F.col("shared_values") >= least).withColumn("by_a", first("a")).withColumn("by_b", first("b")).where("by_a and by_b")
    return best.select(F.col("a").alias("source_column"), F.col("b").alias("target_column"), "source_type", "target_type", "shared_values", "n_distinct_source", "n_distinct_target")
