"""Comparison of two tables by trees of range digests: neither is shuffled, and only ranges that differ are read again.

The range of a key is cut into leaves of equal width, ``fanout`` leaves are a node, and so on up to the root. A node has
the number of its rows and sums of two hashes of each, so that nodes add up and each side's tree takes one scan and one small shuffle of leaf
sums. Trees can be kept as tables, by each database for itself, and compared later. The comparison descends from the
root: of every level it reads the children of the nodes that differ, and of the tables the leaves that do, by
ranges of the key that reach the scan. A leaf with more rows than ``most_rows`` is cut into leaves of its own first.

The key is the first key column: integral, a date or a timestamp. Null keys are a leaf of their own. Where more than
``most`` ranges differ, the nearest are joined into one: what lies between is read too, and the driver never holds more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegralType, TimestampNTZType, TimestampType

from verdigris.functions.session import written
from verdigris.functions.values import flagged, named
from verdigris.operators.compare import Rules, key_diff_rows

LEAVES, FANOUT, MOST_RANGES, MOST_ROWS = 65_536, 16, 64, 100_000
#: The number of the leaf of null keys; it is in every level.
NULL_LEAF = -1

Ranges = list[tuple[int, int]]


@dataclass(frozen=True)
class Grid:
    """Leaves over parts (low, high, width) of the keys, in order; the keys of a leaf have one quotient by the width. ``fanout`` nodes make one of the next level.

    Keys below the first part, between parts or above the last belong to the next leaf below, or to the first.
    """

    parts: tuple[tuple[int, int, int], ...]
    fanout: int = FANOUT

    def sizes(self) -> list[int]:
        return [high // width - low // width + 1 for low, high, width in self.parts]

    @property
    def levels(self) -> int:
        """Levels above the leaves, the last of which has one node."""
        level, nodes = 0, sum(self.sizes())
        while nodes > 1:
            level, nodes = level + 1, -(-nodes // self.fanout)
        return level

    def leaf(self, number: Column) -> Column:
        """The leaf of a key number, by whole-number arithmetic."""
        found, offset = F.lit(0), 0
        for (low, high, width), size in zip(self.parts, self.sizes()):
            held = F.greatest(F.lit(low), F.least(F.lit(high), number))
            quotient = F.call_function("div", held - F.pmod(held, F.lit(width)), F.lit(width)).cast("long")
            found = F.when(number >= low, quotient - F.lit(low // width - offset)).otherwise(found)
            offset += size
        return found.cast("long")

    def keys(self, first: int, last: int) -> Ranges:
        """The key ranges of leaves ``first`` to ``last``."""
        found, offset = [], 0
        for (low, high, width), size in zip(self.parts, self.sizes()):
            a, b = max(first - offset, 0), min(last - offset, size - 1)
            if a <= b:
                found.append((max(low, (low // width + a) * width), min(high, (low // width + b + 1) * width - 1)))
            offset += size
        return found

    @property
    def low(self) -> int:
        return self.parts[0][0]

    @property
    def high(self) -> int:
        return self.parts[-1][1]


def grid_over(ranges: Ranges, leaves: int = LEAVES, fanout: int = FANOUT) -> Grid:
    """A grid of about so many leaves over ranges of key numbers, alike in width."""
    total = sum(high - low + 1 for low, high in ranges)
    width = max(1, -(-total // leaves))
    return Grid(tuple((low, high, width) for low, high in ranges), fanout)


def as_number(key: Column, kind: DataType) -> Column:
    """A key as a long: days of dates, microseconds of timestamps; those without a zone as if in UTC, whatever zone the session has."""
    if isinstance(kind, IntegralType):
        return key.cast("long")
    if isinstance(kind, DateType):
        return F.unix_date(key).cast("long")
    if isinstance(kind, TimestampType):
        return F.unix_micros(key)
    if isinstance(kind, TimestampNTZType):
        second = (F.date_part(F.lit("SECOND"), key) * 1_000_000).cast("long")
        return F.unix_date(key.cast("date")).cast("long") * 86_400_000_000 + (F.hour(key) * 60 + F.minute(key)).cast("long") * 60_000_000 + second
    raise ValueError(f"ranges need an integral, date or timestamp key, not {kind.simpleString()}")


def as_key(number: int, kind: DataType) -> Column:
    """A literal of the key's own type, so that the comparison reaches the scan."""
    if isinstance(kind, IntegralType):
        bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[kind.simpleString()]
        return F.lit(max(-(2 ** (bits - 1)), min(2 ** (bits - 1) - 1, number))).cast(kind)
    if isinstance(kind, DateType):
        return F.date_from_unix_date(F.lit(number).cast("int"))
    if isinstance(kind, TimestampType):
        return F.timestamp_micros(F.lit(number))
    return F.timestamp_add("MICROSECOND", F.lit(number), F.lit("1970-01-01").cast("timestamp_ntz"))


def _kind(df: DataFrame, key: str) -> DataType:
    return next(f.dataType for f in df.schema.fields if f.name == key)


def grid_of(src: DataFrame, tgt: DataFrame, key: str, leaves: int = LEAVES, fanout: int = FANOUT) -> Grid:
    """A grid over the keys of both sides; files and databases answer the minimum and maximum from what they know of the column."""
    edges = [df.agg(*(as_number(edge(named(key)), _kind(df, key)) for edge in (F.min, F.max))).first() for df in (src, tgt)]
    known = [x for row in edges for x in row if x is not None]
    return grid_over([(min(known, default=0), max(known, default=0))], leaves, fanout)


def tree(df: DataFrame, key: str, cols: list[str], grid: Grid, rules: Rules | None = None) -> DataFrame:
    """(level, node, n, digest_a, digest_b) of every node that has rows: one scan, and a shuffle of sums by leaf.

    ``cols`` are digested after the ``rules`` given for them; the key always is.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    values = [flagged((rules or {}).get(c, lambda x: x)(named(c)), kinds[c]) for c in dict.fromkeys([key, *cols])]
    leaf = F.when(named(key).isNull(), F.lit(NULL_LEAF)).otherwise(grid.leaf(as_number(named(key), kinds[key]))).cast("long")
    text = F.concat(*values)
    rows = df.select(leaf.alias("node"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b"))
    sums = [F.sum(F.col(x).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"digest_{x}") for x in "ab"]
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *sums)
    # Every leaf is told to all its ancestors at once; sums are combined before the second small shuffle.
    over = lambda level: F.when(F.col("node") < 0, NULL_LEAF).otherwise(F.call_function("div", F.col("node"), F.lit(grid.fanout**level))).cast("long")
    above = F.array(*(F.struct(F.lit(level).alias("level"), over(level).alias("node")) for level in range(grid.levels + 1)))
    lifted = nodes.select(F.explode(above).alias("x"), "n", "digest_a", "digest_b").select("x.level", "x.node", "n", "digest_a", "digest_b")
    return lifted.groupBy("level", "node").agg(F.sum("n").alias("n"), *(F.sum(f"digest_{x}").cast("decimal(38,0)").alias(f"digest_{x}") for x in "ab"))


def write_tree(nodes: DataFrame, path: str) -> None:
    """A tree as Parquet files by level, sorted by node, so that a comparison reads what it descends into."""
    nodes.repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.partitionBy("level").mode("overwrite").parquet(path)


def _merged(ranges: Ranges, most: int) -> Ranges:
    """Sorted ranges, neighbours joined, and the nearest too until ``most`` are left."""
    joined: Ranges = []
    for low, high in sorted(ranges):
        if joined and low <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(high, joined[-1][1]))
        else:
            joined.append((low, high))
    gaps = sorted(range(1, len(joined)), key=lambda i: joined[i][0] - joined[i - 1][1])
    drop = set(gaps[: max(0, len(joined) - most)])
    made: Ranges = []
    for i, (low, high) in enumerate(joined):
        if i in drop:
            made[-1] = (made[-1][0], high)
        else:
            made.append((low, high))
    return made


def _within(column: Column, ranges: Ranges, literal=F.lit) -> Column:
    """Whether a column lies in one of the ranges."""
    found = F.lit(False)
    for low, high in ranges:
        found = found | ((column >= literal(low)) & (column <= literal(high)))
    return found


def differing(a: DataFrame, b: DataFrame, grid: Grid, most: int = MOST_RANGES) -> tuple[Ranges, int, bool]:
    """Ranges of leaves whose digests differ, the most rows that such a leaf has on a side, and whether null keys differ.

    Descends level by level: of each it reads the children of nodes that differ. No more than ``most`` ranges are followed.
    """
    ranges, nulls = None, False
    for level in range(grid.levels, -1, -1):
        wanted = F.col("level") == level if ranges is None else (F.col("level") == level) & _within(F.col("node"), ranges)
        sides = [x.where(wanted).select("node", F.struct("n", "digest_a", "digest_b").alias(side)) for x, side in ((a, "s"), (b, "t"))]
        apart = sides[0].join(sides[1], "node", "full_outer").where(~F.col("s").eqNullSafe(F.col("t")))
        found, rows, null_leaf = _runs(apart, most)
        nulls = nulls or null_leaf
        if not found or level == 0:
            break
        ranges = [(low * grid.fanout, (high + 1) * grid.fanout - 1) for low, high in found]
    return found, rows, nulls


def _runs(apart: DataFrame, most: int, collected: int = 4096) -> tuple[Ranges, int, bool]:
    """Nodes that differ as at most ``most`` ranges, the most rows of one, and whether the null leaf is among them.

    More than ``collected`` nodes are joined within equal parts of their range before any comes to the driver.
    """
    rows = F.greatest(F.coalesce("s.n", F.lit(0)), F.coalesce("t.n", F.lit(0)))
    inner = F.when(F.col("node") != NULL_LEAF, F.col("node"))
    low, high, n, most_rows, nulls = apart.agg(F.min(inner), F.max(inner), F.count(inner), F.max(F.when(inner.isNotNull(), rows)), F.count(F.when(inner.isNull(), 1))).first()
    if not n:
        return [], 0, nulls > 0
    wide = 1 if n <= collected else -(-(high - low + 1) // collected)
    parts = apart.where(inner.isNotNull()).groupBy(F.floor((inner - low) / F.lit(wide)).alias("part")).agg(F.min(inner).alias("a"), F.max(inner).alias("b"))
    return _merged([(r["a"], r["b"]) for r in parts.collect()], most), most_rows, nulls > 0


def in_ranges(df: DataFrame, key: str, ranges: Ranges, nulls: bool = False, grid: Grid | None = None) -> DataFrame:
    """The rows whose key lies in one of the ranges (of key numbers), by comparisons that reach the scan.

    Ranges that touch an end of ``grid`` are open there, as its outermost leaves are.
    """
    kind, wanted, c = _kind(df, key), F.lit(False), named(key)
    for low, high in ranges:
        below = c <= as_key(high, kind) if grid is None or high < grid.high else F.lit(True)
        above = c >= as_key(low, kind) if grid is None or low > grid.low else F.lit(True)
        wanted = wanted | (c.isNotNull() & above & below)
    return df.where(wanted | c.isNull() if nulls else wanted)


def differing_ranges(
    src: DataFrame, tgt: DataFrame, key: str, cols: list[str], trees: tuple[DataFrame, DataFrame] | None = None, grid: Grid | None = None,
    rules: Rules | None = None, most: int = MOST_RANGES, most_rows: int = MOST_ROWS,
) -> tuple[Ranges, bool, Grid]:
    """Ranges of the key in which the sides differ, whether null keys differ, and the grid.

    ``trees`` are kept trees of both sides over ``grid``; without them both are made. Leaves with more than ``most_rows`` rows
    are cut into narrower ones, over the differing ranges alone, of which only those are read.
    """
    if trees and grid is None:
        raise ValueError("kept trees need their grid")
    grid = grid or grid_of(src, tgt, key)
    whole = grid
    while True:
        a, b = trees or (written(tree(x, key, cols, grid, rules)) for x in (src, tgt))
        leaves, rows, null_leaf = differing(a, b, grid, most)
        nulls = null_leaf if grid is whole else nulls
        ranges = _merged([x for first, last in leaves for x in grid.keys(first, last)], most)
        widest = max((width for _, _, width in grid.parts), default=1)
        inner = grid_over(ranges, LEAVES, grid.fanout) if ranges else grid
        if rows <= most_rows or not ranges or inner.parts[0][2] >= widest:
            return ranges, nulls, whole
        src, tgt, trees, grid = in_ranges(src, key, ranges, False, whole), in_ranges(tgt, key, ranges, False, whole), None, inner


def tree_diff_rows(
    src: DataFrame, tgt: DataFrame, keys: list[str], cols: list[str], trees: tuple[DataFrame, DataFrame] | None = None, grid: Grid | None = None,
    rules: Rules | None = None, most: int = MOST_RANGES, most_rows: int = MOST_ROWS,
) -> DataFrame:
    """What ``key_diff_rows`` finds, reading only the ranges of the first key in which the sides' digests differ.

    Keys that occur twice on both sides alike have equal digests and are not told as duplicates here.
    """
    ranges, nulls, grid = differing_ranges(src, tgt, keys[0], [*keys[1:], *cols], trees, grid, rules, most, most_rows)
    return key_diff_rows(*(in_ranges(x, keys[0], ranges, nulls, grid) for x in (src, tgt)), keys, cols, rules)
