"""Checks of one database: profiles, orphans, duplicate keys, failed casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from verdigris.functions.values import canonical, comparable, free_name, named


def profile(df: DataFrame, cols: list[str], scale: int | None = None) -> DataFrame:
    """(column, n_rows, n_null, n_distinct, least, most, total) of each column.

    Values are counted per (column, value) first, so the exact distinct count of all columns takes one shuffle of combined
    rows; it is of the values themselves. least and most are found in the type's own order (null for maps) and rendered
    with ``scale`` places, all if it is None; total is a decimal sum of ``scale`` (2) places, null for text and where no
    decimal(38) holds it.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    places = 2 if scale is None else scale

    def edge(which, c: str) -> Column:
        return F.lit(None).cast("string") if "map<" in kinds[c].simpleString() else canonical(which(named(c)), kinds[c], scale)

    def total(c: str) -> Column:
        kind = f"decimal(38,{places})"
        return (F.try_sum(named(c).try_cast(kind)) if isinstance(kinds[c], NumericType) else F.lit(None)).cast(kind)

    facts = {"n_null": lambda c: F.count(F.when(named(c).isNull(), 1)), "least": lambda c: edge(F.min, c), "most": lambda c: edge(F.max, c), "total": total}
    exact = df.agg(F.count(F.lit(1)).alias("n_rows"), *(fact(c).alias(f"{what}_{i}") for i, c in enumerate(cols) for what, fact in facts.items()))
    told = "array<struct<column:string,n_rows:bigint,n_null:bigint,least:string,most:string,total:decimal(38," + f"{places})>>"
    rows = [F.struct(F.lit(c).alias("column"), "n_rows", *(F.col(f"{what}_{i}").alias(what) for what in facts)) for i, c in enumerate(cols)]
    wide = exact.select(F.explode(F.array(*rows).cast(told)).alias("x")).select("x.*")
    texts = [F.struct(F.lit(c).alias("column"), canonical(named(c), kinds[c]).alias("value")) for c in cols]
    values = df.select(F.explode(F.array(*texts).cast("array<struct<column:string,value:string>>")).alias("x")).select("x.*")
    distinct = values.groupBy("column", "value").agg(F.lit(1)).groupBy("column").agg(F.count("value").alias("n_distinct"))
    return wide.join(distinct, "column", "left").select("column", "n_rows", "n_null", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "least", "most", "total")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """(key, n): foreign keys without a parent and how many rows have them; null keys refer to nothing."""
    one, two = (comparable(named(c), df.select(named(c)).schema[0].dataType).alias("key") for df, c in ((child, fk), (parent, pk)))
    keys = child.where(named(fk).isNotNull()).groupBy(one).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(parent.select(two), "key", "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, and n (with an underscore where a key has that name)."""
    n = free_name("n", keys)
    return df.groupBy(*map(named, keys)).agg(F.count(F.lit(1)).alias(n)).where(named(n) > 1)


def cast_failures(df: DataFrame, keys: list[str], col: str, kind: str) -> DataFrame:
    """The keys and values of a column that a cast to ``kind`` would lose."""
    return df.where(named(col).isNotNull() & named(col).try_cast(kind).isNull()).select(*map(named, keys), named(col).alias(free_name("value", keys)))
