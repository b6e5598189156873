"""What a schema does not say: candidate keys, functional dependencies and inclusions between columns, found in the data.

Sets of columns are searched level by level, smallest first. A set is only tested if nothing smaller decides it and if a part of its groups
(chosen by their digest, so that rows alike are chosen together) does not refute it. For dependencies the product of its columns' distinct counts has to allow it as
well; for keys a few of the rows are asked first, as what they repeat is repeated in all. What is left is tested over all rows, in shuffles of 128-bit digests.
For keys one shuffle holds about one digest of each row, and its files go before the next is made. Results are exact; nulls are values that equal each other.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, NumericType

from verdigris.functions.session import kept_in_files, short_shuffles, written
from verdigris.functions.values import PLAIN, canonical, family, named

#: One group in so many is in the part that refutes a set, and sets tested in one pass.
PART, SETS = 64, 32
#: About so many rows are asked before a part of all, and so many digests are in a shuffle if one of each row is fewer.
FEW, DIGESTS = 1 << 16, 1 << 23

Names = tuple[str, ...]


def _cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """a0, b0, a1, b1 ...: a 128-bit digest of each cell, of its own kind for each column."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = [named(c) if isinstance(kinds[c], PLAIN) else F.coalesce(F.concat(F.lit("V"), canonical(named(c), kinds[c])), F.lit("N")) for c in cols]
    return df.select(*(F.xxhash64(F.lit(f"{x}{i}"), c).alias(f"{x}{i}") for i, c in enumerate(cells) for x in "ab"))


def _by_set(rows: DataFrame, sets: list[tuple[int, ...]], part: int, whole: bool = False) -> DataFrame:
    """(set, a, b) for each row and set: the set's number and the digest of its cells, of one group in ``part``. With ``whole`` the row's cells too."""
    digest = lambda x, s: reduce(lambda p, q: p.bitwiseXOR(q), (F.col(f"{x}{i}") for i in s))
    told = F.array(*(F.struct(F.lit(k).alias("set"), *(digest(x, s).alias(x) for x in "ab")) for k, s in enumerate(sets)))
    if len(sets) == 1:
        found = rows.select(F.lit(0).alias("set"), *(digest(x, sets[0]).alias(x) for x in "ab"), *(rows.columns if whole else []))
    elif part == 1:
        found = rows.select(F.explode(told).alias("x"), *(rows.columns if whole else [])).select("x.*", *(rows.columns if whole else []))
    else:  # numbers alone, until the part is taken
        found = rows.select(F.posexplode(F.array(*(digest("a", s) for s in sets))).alias("set", "a"), *rows.columns).where(F.pmod("a", F.lit(part)) == 0)
        found = found.select("set", "a", F.get(F.array(*(digest("b", s) for s in sets)), F.col("set")).alias("b"), *(rows.columns if whole else []))
    return found.where(F.pmod("a", F.lit(part)) == 0) if part > 1 else found


def _repeated(rows: DataFrame, sets: list[tuple[int, ...]], part: int, at_once: int, dealt: bool = False) -> set[int]:
    """The numbers of the sets that some two rows share all cells of, of one group in ``part``.

    ``dealt``: hardly any are expected, so digests are dealt out as they are, in place of first counting what each task has of them.
    """
    found: set[int] = set()
    for begin in range(0, len(sets), at_once):
        groups = _by_set(rows, sets[begin : begin + at_once], part)
        groups = (groups.repartition("a", "b") if dealt else groups).groupBy("set", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        found |= {begin + r[0] for r in groups.where("n > 1").select("set").distinct().collect()}
    return found


def _distinct(rows: DataFrame) -> list[int]:
    """How many distinct cells each column has."""
    columns = len(rows.columns) // 2
    counts = {r[0]: r[1] for r in _by_set(rows, [(i,) for i in range(columns)], 1).groupBy("set", "a", "b").agg(F.lit(1)).groupBy("set").count().collect()}
    return [counts.get(k, 0) for k in range(columns)]


def candidate_keys(df: DataFrame, cols: list[str] | None = None, most: int = 3) -> list[Names]:
    """The smallest sets of up to ``most`` columns that no two rows share, in order. Without two rows the empty set is the key.

    The search is over names, of which the driver holds the lattice; the rows stay distributed. A table of files is read where it lies, anything else is written once.
    """
    cols = list(cols or df.columns)
    table = df if kept_in_files(df) else written(df.select(*map(named, cols)))
    rows = _cells(table, cols)
    keys: list[tuple[int, ...]] = []
    with short_shuffles(df.sparkSession):
        n = rows.count()
        if n < 2:
            return [()]
        asked = [(rows, PART, SETS, False), (rows, 1, max(1, min(SETS, DIGESTS // n)), True)]
        if n > FEW:  # by their place, so that what many rows repeat is among them
            asked.insert(0, (written(_cells(table.where(F.pmod(F.monotonically_increasing_id(), F.lit(n // FEW)) == 0), cols)), 1, SETS, False))
        for size in range(1, most + 1):
            sets = [s for s in combinations(range(len(cols)), size) if not any(set(k) <= set(s) for k in keys)]
            for some, *how in asked:
                again = _repeated(some, sets, *how)
                sets = [s for k, s in enumerate(sets) if k not in again]
            keys += sets
    return [tuple(cols[i] for i in k) for k in keys]


def dependencies(df: DataFrame, cols: list[str] | None = None, most: int = 2) -> list[tuple[Names, str]]:
    """(determinants, dependent): the smallest sets of up to ``most`` columns that fix another column, keys and constants included.

    A constant depends on the empty set. A set is refuted by a part of its own groups, chosen by its digest, before all rows are asked.
    """
    cols = list(cols or df.columns)
    rows = written(_cells(df, cols))
    n, distinct = rows.count(), _distinct(rows)
    found: list[tuple[tuple[int, ...], int]] = [((), a) for a in range(len(cols)) if distinct[a] <= 1]
    for size in range(1, most + 1):
        # x -> a is open if no part of x fixes a, nor fixes another column of x (then a smaller set says the same).
        fixed = lambda x, a: any(d == a and set(s) <= set(x) for s, d in found)
        sets = [x for x in combinations(range(len(cols)), size) if not any(fixed(tuple(i for i in x if i != c), c) for c in x)]
        open_pairs = [(x, a) for x in sets for a in range(len(cols)) if a not in x and not fixed(x, a) and prod(distinct[i] for i in x) >= distinct[a]]
        for part in (PART, 1):
            bad: set[tuple[int, int]] = set()
            asked = sorted({x for x, _ in open_pairs})
            for begin in range(0, len(asked), SETS):
                block = asked[begin : begin + SETS]
                groups = _by_set(rows, block, part, True).toDF("set", "a", "b", *rows.columns).groupBy("set", "a", "b")
                wide = groups.agg(*(((F.min(f"a{i}") != F.max(f"a{i}")) | (F.min(f"b{i}") != F.max(f"b{i}"))).alias(f"c{i}") for i in range(len(cols))))
                broken = wide.groupBy("set").agg(*(F.max(f"c{i}").alias(f"c{i}") for i in range(len(cols)))).collect()
                bad |= {(begin + r["set"], i) for r in broken for i in range(len(cols)) if r[f"c{i}"]}
            open_pairs = [(x, a) for x, a in open_pairs if (asked.index(x), a) not in bad]
        found += open_pairs
    return [(tuple(cols[i] for i in x), cols[a]) for x, a in found] if n else []


def _value(column: Column, kind: DataType) -> Column:
    """A value as text that is alike for equal values of one family; whole numbers alike in all number types."""
    if isinstance(kind, IntegralType):
        return column.cast("long").cast("string")
    if isinstance(kind, NumericType):
        whole = column.try_cast("decimal(38,0)")
        return F.when(whole == column, whole.cast("string")).otherwise(canonical(column.cast("double"), kind))
    return canonical(column, kind)


def inclusions(tables: dict[str, DataFrame], most_missing: int = 0) -> DataFrame:
    """(dependent, referenced, n_values, n_missing, referenced_unique): columns (table.column) whose values another column of its family has.

    Nulls refer to nothing, and a column without values to no other. All columns of all tables take one shuffle of values, each combined to
    the set of columns that hold it; equal sets are counted before pairs are made of them. With ``most_missing`` columns of which so many values
    are missing are told too. referenced_unique says that no value occurs twice in the referenced column.
    """
    told, families, number = [], [], 0
    for name in sorted(tables):
        df = tables[name]
        parts = []
        for f in df.schema.fields:
            parts.append(F.struct(F.lit(number).alias("column"), F.lit(family(f.dataType)).alias("family"), _value(named(f.name), f.dataType).alias("value")))
            families.append(f"{name}.{f.name}")
            number += 1
        told.append(df.select(F.explode(F.array(*parts)).alias("x")).select("x.*").where("value is not null").groupBy("column", "family", "value").agg(F.count(F.lit(1)).alias("n")))
    values = told[0]
    for more in told[1:]:
        values = values.unionByName(more)
    # The same grouping as within tables: a second shuffle only of what those have combined.
    sets = values.groupBy("family", "value").agg(F.sort_array(F.collect_list(F.struct("column", (F.col("n") > 1).alias("twice")))).alias("held"))
    kinds = sets.groupBy(F.transform("held", lambda h: h["column"]).alias("held"), F.transform("held", lambda h: h["twice"]).alias("twice")).agg(F.count(F.lit(1)).alias("n"))
    kinds = written(kinds)
    single = kinds.select(F.explode(F.arrays_zip("held", "twice")).alias("h"), "n").groupBy(F.col("h.held").alias("column")).agg(F.sum("n").alias("values"), F.max("h.twice").alias("repeats"))
    pairs = kinds.select(F.explode("held").alias("a"), "held", "n").select("a", F.explode("held").alias("b"), "n").where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("both"))
    one, two = single.select(F.col("column").alias("a"), F.col("values").alias("n_values")), single.select(F.col("column").alias("b"), (~F.col("repeats")).alias("referenced_unique"))
    names = F.array(*map(F.lit, families))
    found = pairs.join(one, "a").join(two, "b").withColumn("n_missing", F.col("n_values") - F.col("both")).where(F.col("n_missing") <= most_missing)
    return found.select(F.get(names, F.col("a")).alias("dependent"), F.get(names, F.col("b")).alias("referenced"), "n_values", "n_missing", "referenced_unique")


def foreign_keys(tables: dict[str, DataFrame], most_missing: int = 0, alike: float = 0.8) -> DataFrame:
    """(dependent, referenced, n_values, n_missing): inclusions in a unique column of another table that also say so by their names.

    Small numbers are included in any larger key by chance, so the names, without what stands before the first underscore and in lower case, have to
    agree to ``alike`` by edit distance. The unique column of a table whose own values the other includes as well is the referenced one of both.
    """
    last = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"^[^.]*\.", "")), r"^[^_]{1,2}_", "")
    table = lambda c: F.regexp_extract(c, r"^[^.]*", 0)
    near = 1 - F.levenshtein(last("dependent"), last("referenced")) / F.greatest(F.length(last("dependent")), F.length(last("referenced")))
    rows = inclusions(tables, most_missing)
    return rows.where(F.col("referenced_unique") & (table("dependent") != table("referenced")) & (near >= alike)).drop("referenced_unique")
