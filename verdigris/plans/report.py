"""Findings of checks, in one long form: (table, check, column, source, target, status)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.values import named
from verdigris.operators.compare import STATUSES, Rules, comparison, group_reconcile, recased, row_count, schema_diff
from verdigris.operators.inspect import orphans, profile

_FINDINGS = "array<struct<check_name:string,column_name:string,source_value:string,target_value:string,status:string>>"


def finding(check: str, column: Column | None, source: Column | None, target: Column | None, agrees: Column) -> Column:
    """One finding as a struct."""
    text = [F.lit(None).cast("string") if x is None else x.cast("string") for x in (column, source, target)]
    return F.struct(F.lit(check).alias("check_name"), *(x.alias(n) for x, n in zip(text, ("column_name", "source_value", "target_value"))), F.when(agrees, "pass").otherwise("fail").alias("status"))


def findings(df: DataFrame, table: str, found: list[Column], keep: str = "true") -> DataFrame:
    """The findings of every row of a check's result."""
    rows = df.select(F.explode(F.array(*found).cast(_FINDINGS)).alias("x")).select(F.lit(table).alias("table_name"), "x.*")
    return rows.where(keep)


def report(parts: list[DataFrame]) -> DataFrame:
    """All findings as one DataFrame."""
    return reduce(DataFrame.unionByName, parts)


def compare_tables(
    name: str, src: DataFrame, tgt: DataFrame, keys: list[str], cols: list[str], rules: Rules | None = None, scale: int | None = None,
    totals: tuple[list[str], list[str]] | None = None, parents: list[tuple[str, DataFrame, str]] | None = None,
) -> DataFrame:
    """Report of a table: row counts, schema, keys, duplicate keys, columns, and the profiles of both sides.

    Columns that are missing or retyped are findings of the schema and not compared; without any to compare the rest is reported.
    A column whose names differ in case alone is such a finding, and compared. ``totals`` (groups, measures) adds
    the number of groups whose sums differ; ``parents`` (foreign key, table, its key) the rows of the target without a parent.
    """
    c = F.col
    shape, names = schema_diff(src, tgt), {b: a for a, b in recased(src, tgt).items()}
    tgt = tgt.select(*(named(x).alias(names.get(x, x)) for x in tgt.columns))
    same = {f.name for f in tgt.schema.fields if f.name in src.columns and f.dataType == src.schema[f.name].dataType}
    if not same.issuperset(keys):
        raise ValueError("the keys must have the same names and types on both sides")
    cols = [x for x in cols if x in same]
    diff = comparison(src, tgt, keys, cols, rules)
    kinds = ("n_null", "n_distinct", "least", "most", "total")
    a, b = (profile(df, cols, scale).select("column", F.struct(*kinds).alias(x)) for df, x in ((src, "a"), (tgt, "b")))
    count = lambda status: F.get("statuses", F.lit(STATUSES.index(status)))
    keyed = [finding("key_diff", F.lit(x), count(x), None, F.lit(False)) for x in STATUSES[1:-1]]
    columns = [finding("column_diff", F.lit(x), count("match") + count("changed"), F.get("changed", F.lit(i)), F.get("changed", F.lit(i)) == 0) for i, x in enumerate(cols)]
    parts = [
        findings(row_count(src, tgt), name, [finding("row_count", None, c("n_source"), c("n_target"), c("difference") == 0)]),
        findings(shape, name, [finding("schema", c("column"), c("source_type"), c("target_type"), F.lit(False))]),
        findings(diff, name, [*keyed, finding("duplicate_keys", None, count("duplicate"), None, count("duplicate") == 0), *columns], "check_name <> 'key_diff' or source_value <> '0'"),
        findings(a.join(b, "column"), name, [finding(f"profile_{x}", c("column"), c(f"a.{x}"), c(f"b.{x}"), c(f"a.{x}").eqNullSafe(c(f"b.{x}"))) for x in kinds]),
    ]
    if totals:
        groups = group_reconcile(src, tgt, *totals).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~c("agrees"), 1)).alias("bad"))
        parts.append(findings(groups, name, [finding("group_totals", F.lit(",".join(totals[0])), c("n"), c("bad"), c("bad") == 0)]))
    for fk, parent, pk in parents or []:
        lost = orphans(tgt, parent, fk, pk).agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        parts.append(findings(lost, name, [finding("orphans", F.lit(fk), c("keys"), c("n"), c("n") == 0)]))
    return report(parts)
