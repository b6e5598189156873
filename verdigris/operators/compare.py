"""Checks of a migrated table (``tgt``) against its source (``src``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from verdigris.functions.values import comparable, family, free_name, named, row_digest


def row_count(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """One row: n_source, n_target, difference."""
    sides = src.select(F.lit(1).alias("s")).unionByName(tgt.select(F.lit(0).alias("s")))
    n = F.coalesce(F.sum("s"), F.lit(0))
    m = F.coalesce(F.sum(1 - F.col("s")), F.lit(0))
    return sides.agg(n.cast("long").alias("n_source"), m.cast("long").alias("n_target"), (m - n).cast("long").alias("difference"))


def schema_diff(src: DataFrame, tgt: DataFrame, nullability: bool = False) -> DataFrame:
    """(column, source_type, target_type, status) of columns that are missing, extra, retyped or recased. Reads schemas only.

    A column whose name differs in case alone is recased (and retyped, if its type differs too), told by the source's name. With ``nullability`` a column that is required on one side alone is retyped too.
    """
    def told(df: DataFrame) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() + (" not null" if nullability and not f.nullable else "") for f in df.schema.fields}

    a, b = told(src), told(tgt)
    rows = []
    for name, other in recased(src, tgt).items():
        rows.append((name, a[name], b[other], "recased"))
        b[name] = b.pop(other)
    for name in sorted({*a, *b}):
        status = "missing" if name not in b else "extra" if name not in a else "retyped" if a[name] != b[name] else None
        if status:
            rows.append((name, a.get(name), b.get(name), status))
    names = ("column", "source_type", "target_type", "status")
    told = F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for x, n in zip(row, names))) for row in rows))
    kind = "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"
    return src.sparkSession.range(1).select(F.explode(told.cast(kind)).alias("x")).select("x.*")


def recased(src: DataFrame, tgt: DataFrame) -> dict[str, str]:
    """By name in the source the target's name of each column whose names differ in case alone, where only one column has it."""
    def by_lower(names: list[str]) -> dict[str, list[str]]:
        return {low: [n for n in names if n.lower() == low] for low in {n.lower() for n in names}}

    a, b = by_lower(src.columns), by_lower(tgt.columns)
    return {a[k][0]: b[k][0] for k in sorted(a) if k in b and len(a[k]) == len(b[k]) == 1 and a[k] != b[k]}


#: By column what is done to both sides before they are compared, such as F.rtrim.
Rules = dict[str, Callable[[Column], Column]]


def doubled_keys(src: DataFrame, tgt: DataFrame, keys: list[str]) -> DataFrame:
    """k<i>: the keys that occur more than once on either side, null-safe. One shuffle of combined keys."""

    def side(df: DataFrame, s: int, t: int) -> DataFrame:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        return df.select(*(comparable(named(k), kinds[k]).alias(f"k{i}") for i, k in enumerate(keys)), F.lit(s).alias("s"), F.lit(t).alias("t"))

    both = side(src, 1, 0).unionByName(side(tgt, 0, 1)).groupBy(*(f"k{i}" for i in range(len(keys)))).agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return both.where("s > 1 or t > 1").drop("s", "t")


def _sides(src: DataFrame, tgt: DataFrame, keys: list[str], cols: list[str], doubled: DataFrame, rules: Rules | None) -> DataFrame:
    """Full outer join on null-safe keys that are unique on both sides: a<i>, b<i>, s<i>, t<i>, and in_source, in_target.

    Values of a column whose type is of another family on each side (text and number) never agree, but null with null.
    """

    def ruled(df: DataFrame) -> list[tuple[Column, DataType]]:
        columns = [(rules or {}).get(c, lambda x: x)(named(c)) for c in cols]
        return list(zip(columns, (f.dataType for f in df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).schema.fields)))

    values = {"s": ruled(src), "t": ruled(tgt)}
    retyped = [family(a) != family(b) for (_, a), (_, b) in zip(values["s"], values["t"])]
    for k in keys:
        one, two = (next(f.dataType for f in df.schema.fields if f.name == k) for df in (src, tgt))
        if family(one) != family(two):
            raise ValueError(f"key {k} is {one.simpleString()} in the source and {two.simpleString()} in the target")

    def side(df: DataFrame, key: str, value: str, flag: str) -> DataFrame:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        told = (F.when(c.isNotNull(), F.lit(value)) if other else comparable(c, kind) for (c, kind), other in zip(values[value], retyped))
        rows = df.select(*(comparable(named(k), kinds[k]).alias(f"{key}{i}") for i, k in enumerate(keys)), *(x.alias(f"{value}{i}") for i, x in enumerate(told)), F.lit(True).alias(flag))
        return rows.join(doubled, [F.col(f"{key}{i}").eqNullSafe(F.col(f"k{i}")) for i in range(len(keys))], "left_anti")

    on = [F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(len(keys))]
    return side(src, "a", "s", "in_source").join(side(tgt, "b", "t", "in_target"), on, "full_outer")


def _changed(i: int) -> Column:
    return ~F.col(f"s{i}").eqNullSafe(F.col(f"t{i}"))


def key_diff_rows(src: DataFrame, tgt: DataFrame, keys: list[str], cols: list[str], rules: Rules | None = None) -> DataFrame:
    """The keys that differ, with status (changed, missing, extra, duplicate) and the names of the changed columns.

    A key that occurs more than once on either side is a duplicate, and not compared; a null key equals a null key. Where a
    key column has the name of a result, the result's gets an underscore.
    """
    doubled = doubled_keys(src, tgt, keys)
    both = F.col("in_source").isNotNull() & F.col("in_target").isNotNull()
    changed = F.concat_ws(",", *(F.when(both & _changed(i), F.lit(c)) for i, c in enumerate(cols)))
    status = F.when(F.col("in_target").isNull(), "missing").when(F.col("in_source").isNull(), "extra").when(F.col("changed") != "", "changed").otherwise("match")
    rows = _sides(src, tgt, keys, cols, doubled, rules).withColumn("changed", changed).withColumn("status", status)
    rows = rows.select(*(F.coalesce(f"a{i}", f"b{i}").alias(f"k{i}") for i in range(len(keys))), "status", "changed").where("status <> 'match'")
    rows = rows.unionByName(doubled.select("*", F.lit("duplicate").alias("status"), F.lit("").alias("changed")))
    return rows.toDF(*keys, free_name("status", keys), free_name("changed", keys))


STATUSES = ["match", "changed", "missing", "extra", "duplicate"]


def comparison(src: DataFrame, tgt: DataFrame, keys: list[str], cols: list[str], rules: Rules | None = None) -> DataFrame:
    """One row: statuses (the number of keys of each of ``STATUSES``) and changed (by column the keys with another value)."""
    doubled = doubled_keys(src, tgt, keys)
    any_changed = F.lit(False)
    for i in range(len(cols)):
        any_changed = any_changed | _changed(i)
    both = F.col("in_source").isNotNull() & F.col("in_target").isNotNull()
    tests = [both & ~any_changed, both & any_changed, F.col("in_target").isNull(), F.col("in_source").isNull()]
    counts = [F.count(F.when(x, 1)) for x in tests]
    changed = [F.count(F.when(both & _changed(i), 1)) for i in range(len(cols))]
    totals = _sides(src, tgt, keys, cols, doubled, rules).agg(F.array(*counts).alias("statuses"), F.array(*changed).cast("array<bigint>").alias("changed"))
    twice = doubled.agg(F.count(F.lit(1)).alias("twice"))
    both_rows = totals.unionByName(twice, allowMissingColumns=True).agg(*(F.max(x).alias(x) for x in ("statuses", "changed", "twice")))
    return both_rows.select(F.concat("statuses", F.array("twice")).alias("statuses"), "changed")


def key_diff(src: DataFrame, tgt: DataFrame, keys: list[str], cols: list[str], rules: Rules | None = None) -> DataFrame:
    """(status, n): how many keys match, changed, are missing from the target, extra in it, or duplicate (not compared)."""
    told = F.array(*(F.struct(F.lit(x).alias("status"), F.get("statuses", F.lit(i)).alias("n")) for i, x in enumerate(STATUSES)))
    return comparison(src, tgt, keys, cols, rules).select(F.explode(told).alias("x")).select("x.*").where("n > 0")


def column_diff(src: DataFrame, tgt: DataFrame, keys: list[str], cols: list[str], rules: Rules | None = None) -> DataFrame:
    """(column, n_compared, n_changed) over the keys that both sides have once."""
    n = F.get("statuses", F.lit(0)) + F.get("statuses", F.lit(1))
    told = F.array(
        *(F.struct(F.lit(c).alias("column"), n.alias("n_compared"), F.get("changed", F.lit(i)).alias("n_changed")) for i, c in enumerate(cols))
    ).cast("array<struct<column:string,n_compared:bigint,n_changed:bigint>>")
    return comparison(src, tgt, keys, cols, rules).select(F.explode(told).alias("x")).select("x.*")


def bag_diff(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Rows that occur more often on one side, and surplus: positive in the source, negative in the target.

    For tables without a usable key. Counts are combined before the one shuffle, so repeated rows cost little. Where a column
    is named surplus, the result's gets an underscore.
    """
    cols, surplus = src.columns, free_name("surplus", src.columns)
    sides = [df.select(*map(named, cols), F.lit(s).alias(surplus)) for df, s in ((src, 1), (tgt, -1))]
    return sides[0].unionByName(sides[1]).groupBy(*map(named, cols)).agg(F.sum(named(surplus)).alias(surplus)).where(named(surplus) != 0)


def group_reconcile(src: DataFrame, tgt: DataFrame, by: list[str], measures: list[str], scale: int = 2) -> DataFrame:
    """Row counts and decimal sums of each group on both sides, and whether all agree.

    <measure>_overflow counts the values, of both sides, that no decimal(38, scale) holds; with any, or with a sum that
    none holds (null), the group does not agree. Results named like a group get an underscore; maps are grouped as text sorted by key.
    """

    def totals(df: DataFrame, side: str) -> DataFrame:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        out = [F.count(F.lit(1)).alias(f"n_{side}")]
        for i, m in enumerate(measures):
            exact = named(m).try_cast(f"decimal(38,{scale})")
            out += [
                F.try_sum(exact).cast(f"decimal(38,{scale})").alias(f"m{i}_{side}"),
                F.count(F.when(named(m).isNotNull() & exact.isNull(), 1)).alias(f"m{i}_lost_{side}"),
                F.count(exact).alias(f"m{i}_held_{side}"),
            ]
        return df.groupBy(*(comparable(named(c), kinds[c]).alias(f"{side}_{i}") for i, c in enumerate(by))).agg(*out)

    on = [F.col(f"source_{i}").eqNullSafe(F.col(f"target_{i}")) for i in range(len(by))]
    rows = totals(src, "source").join(totals(tgt, "target"), on, "full_outer")
    agrees = F.col("n_source").eqNullSafe(F.col("n_target"))
    for i in range(len(measures)):
        lost = F.coalesce(f"m{i}_lost_source", F.lit(0)) + F.coalesce(f"m{i}_lost_target", F.lit(0))
        rows = rows.withColumn(f"m{i}_overflow", lost)
        unsummed = F.coalesce((F.col(f"m{i}_held_source") > 0) & F.col(f"m{i}_source").isNull(), F.lit(False))
        agrees = agrees & F.col(f"m{i}_source").eqNullSafe(F.col(f"m{i}_target")) & (F.col(f"m{i}_overflow") == 0) & ~unsummed
    told = ["n_source", "n_target", *(f"m{i}_{x}" for i in range(len(measures)) for x in ("source", "target", "overflow"))]
    names = list(by)
    for name in ["n_source", "n_target", *(f"{m}_{x}" for m in measures for x in ("source", "target", "overflow")), "agrees"]:
        names.append(free_name(name, names))
    return rows.select(*(F.coalesce(f"source_{i}", f"target_{i}") for i in range(len(by))), *told, agrees).toDF(*names)


def domain_diff(src: DataFrame, tgt: DataFrame, col: str) -> DataFrame:
    """(value, n_source, n_target) of every value of a column on either side."""
    sides = [df.select(comparable(named(col), df.select(named(col)).schema[0].dataType).alias("value"), F.lit(s).alias("s")) for df, s in ((src, 1), (tgt, 0))]
    return sides[0].unionByName(sides[1]).groupBy("value").agg(F.sum("s").alias("n_source"), F.sum(1 - F.col("s")).alias("n_target"))


def fingerprint(df: DataFrame, keys: list[str], cols: list[str], scale: int | None = None) -> DataFrame:
    """The keys and an md5 of the columns' canonical text, to compare sides that cannot be joined."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*map(named, keys), row_digest([(c, kinds[c]) for c in cols], scale).alias(free_name("fingerprint", keys)))


def table_checksum(df: DataFrame, cols: list[str], buckets: int = 64, scale: int | None = None) -> DataFrame:
    """(bucket, n, checksum): sums of row digests in fixed buckets; two sides agree if all buckets do."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    digest = row_digest([(c, kinds[c]) for c in cols], scale)
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(20,0)")
    rows = df.select(digest.alias("digest"), number.alias("number"))
    return rows.groupBy((F.conv(F.substring("digest", 31, 2), 16, 10).cast("long") % buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("number").cast("decimal(38,0)").alias("checksum"))


def diff_sample(diff: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` differing rows by key: a top-k, not a sort of all."""
    return diff.orderBy(*map(named, keys)).limit(n)
