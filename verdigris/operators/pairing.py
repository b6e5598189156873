"""Pairing of changed rows where a table has no key.

The surplus of a bag difference holds deleted, added and changed rows alike. A changed row agrees with its source in all
columns but a few, so rows of both sides are blocked by what is left when those few are taken out: one column at first, then two, up
to ``most_changed``. Within a block candidates are compared by how far apart the left-out values are (numbers by their
relative difference, text by edit distance), and rows are assigned one to one: a pair stands if each is the other's best. Rounds
repeat with what is left until no block has rows of both sides, so that no row stays alone that could be paired.

Rows that differ are found in parts of all rows, chosen by their hash. Of the rows' blocks only digests are shuffled, about ``DIGESTS`` or one of each
row at a time; rows whose block has both sides get their cells then. Shuffles and tables go as soon as they have been used.

A block of more than ``SMALL`` possible pairs gives no pairs of all with all: its rows are ranked by the left-out values on each side
and compared rank by rank. A block with more rows than ``PIECE`` is dealt into pieces first, by hash; what one piece
leaves over meets the others' in a later round, when fewer rows are left and there are fewer pieces.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from verdigris.functions.session import delete_shared, deterministic, shared_folder, short_shuffles, written, written_at
from verdigris.functions.values import PLAIN, canonical, family, free_name, named
from verdigris.operators.compare import bag_diff

SMALL, PIECE, MOST_HOT = 256, 10_000, 100_000
#: Rows of both tables from which on they are compared in parts, how many parts at most, and digests of blocks in a shuffle.
PART_ROWS, PARTS, DIGESTS = 1 << 22, 4, 1 << 22


def blocks_of(columns: int, left_out: int) -> list[tuple[int, ...]]:
    """The numbers of the columns that stay when any ``left_out`` of them are taken out."""
    return list(combinations(range(columns), columns - left_out))


def gap(a: Column, b: Column, kind: DataType) -> Column:
    """0 for equal cells, up to 1 for cells that have nothing in common."""
    if family(kind) == "number":
        x, y = a.try_cast("double"), b.try_cast("double")
        apart = F.least(F.abs(x - y) / F.greatest(F.abs(x), F.abs(y)), F.lit(1.0))
    elif family(kind) == "text":
        apart = F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    else:
        apart = F.lit(1.0)
    return F.when(a.eqNullSafe(b), 0.0).otherwise(F.coalesce(F.when(~F.isnan(apart), apart), F.lit(1.0)))


def distance(a: str, b: str, kinds: list[DataType]) -> Column:
    """The gaps of all columns, each above 1 for being there at all, so that fewer changed columns come first."""
    total = F.lit(0.0)
    for i, kind in enumerate(kinds):
        one, two = F.col(a)[i], F.col(b)[i]
        total = total + F.when(one.eqNullSafe(two), 0.0).otherwise(1.0 + gap(one, two, kind) / (len(kinds) + 1))
    return total


def differing(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """side, n, cells, row and id of the rows that one side has more often.

    Many rows are compared in parts, each of which reads both tables; a table that is not the same each time is written first.
    """
    names, kinds = src.columns, [f.dataType for f in src.schema.fields]
    tgt = tgt.select(*map(named, names))
    surplus = free_name("surplus", names)
    # Equal values have equal hashes only in columns of one type; text in other collations has others.
    alike = [named(c) for c, one, two in zip(names, kinds, (f.dataType for f in tgt.schema.fields)) if one == two and (isinstance(one, PLAIN) or one == StringType())]
    src, tgt = (df if deterministic(df) else written(df) for df in (src, tgt))
    parts = min(PARTS, -(-(src.count() + tgt.count()) // PART_ROWS)) if alike else 1
    cells = F.array(*(canonical(named(c), k) for c, k in zip(names, kinds)))
    flagged = F.array_join(F.transform("cells", lambda c: F.coalesce(F.concat(F.lit("V"), F.length(c).cast("string"), F.lit(":"), c), F.lit("N"))), ";")
    folder = shared_folder(src.sparkSession, "table")
    for k in range(max(1, parts)):
        bag = bag_diff(*(df.where(F.pmod(F.xxhash64(*alike), F.lit(parts)) == k) if parts > 1 else df for df in (src, tgt)))
        rows = bag.select(F.when(named(surplus) > 0, 1).otherwise(-1).alias("side"), F.abs(named(surplus)).alias("n"), cells.alias("cells"), F.struct(*map(named, names)).alias("row"))
        rows = rows.withColumn("id", F.unhex(F.md5(flagged)))
        rows.write.mode("append").parquet(folder)
    return src.sparkSession.read.schema(rows.schema).parquet(folder)


def members(pool: DataFrame, blocks: list[tuple[int, ...]]) -> tuple[DataFrame, str]:
    """(side, id, n, block, digest, a_rows, b_rows) of rows and each of their blocks that has rows of both sides, and the table's folder."""
    cell = lambda i: F.coalesce(F.concat(F.lit("V"), F.col("cells")[i]), F.lit("N"))
    hashes = pool.select("side", "id", "n", *(F.xxhash64(F.lit(i), cell(i)).alias(f"h{i}") for i in sorted({i for block in blocks for i in block})))
    digest = lambda block: reduce(lambda p, q: p.bitwiseXOR(q), (F.col(f"h{i}") for i in block), F.lit(0).cast("long"))
    folder, key = shared_folder(pool.sparkSession, "table"), ["block", "digest"]
    at_once = max(1, DIGESTS // max(1, pool.count()))
    for begin in range(0, len(blocks), at_once):
        keys = F.array(*(F.struct(F.lit(k).alias("block"), digest(block).alias("digest")) for k, block in enumerate(blocks[begin : begin + at_once], begin)))
        rows = hashes.select("side", "id", "n", F.explode(keys).alias("x")).select("side", "id", "n", "x.*")
        counts = (F.count_if(F.col("side") == side).alias(f"{x}_rows") for side, x in ((1, "a"), (-1, "b")))
        both, place = written_at(rows.groupBy(*key).agg(*counts).where("a_rows > 0 and b_rows > 0"))
        hot = both.where(F.col("a_rows") + F.col("b_rows") > PIECE)
        n_hot = hot.count()
        if n_hot:
            hot = F.broadcast(hot) if n_hot <= MOST_HOT else hot
            cold = both.where(F.col("a_rows") + F.col("b_rows") <= PIECE)
            found = rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))
        else:
            found = rows.join(both, key)
        found.write.mode("append").parquet(folder)
        delete_shared(pool.sparkSession, place)
    return pool.sparkSession.read.schema(found.schema).parquet(folder), folder


def candidates(pool: DataFrame, names: list[str], kinds: list[DataType], blocks: list[tuple[int, ...]]) -> tuple[DataFrame, str]:
    """(a, b, n, apart, changed): pairs of ids of the source and the target that share a block, how many copies both have, and the names of the columns that differ; and the table's folder."""
    found, folder = members(pool, blocks)
    small = (F.col("a_rows") * F.col("b_rows") <= SMALL) & (F.col("a_rows") + F.col("b_rows") <= PIECE)
    cells = pool.select("side", "id", "cells")
    rows, spent = found.where(small).join(cells, ["side", "id"]).withColumns({"piece": F.lit(0).cast("long"), "rank": F.lit(0)}), [folder]
    if found.where(~small).take(1):
        pieces = F.ceil((F.col("a_rows") + F.col("b_rows")) / F.lit(PIECE)).cast("long")
        large = found.where(~small).join(cells, ["side", "id"]).withColumn("piece", F.pmod(F.xxhash64("cells"), pieces))
        block = Window.partitionBy("block", "digest", "piece")
        large = large.withColumn("a_rows", F.count(F.when(F.col("side") == 1, 1)).over(block)).withColumn("b_rows", F.count(F.when(F.col("side") == -1, 1)).over(block))
        # Numbers are ranked as numbers, everything else as text.
        order = [x for i, kind in enumerate(kinds) for x in ([F.col("cells")[i].try_cast("double")] if family(kind) == "number" else []) + [F.col("cells")[i]]]
        ranked = Window.partitionBy("block", "digest", "piece", "side").orderBy(*order)
        rank = F.when(F.col("a_rows") * F.col("b_rows") <= SMALL, 0).otherwise(F.row_number().over(ranked))
        large, place = written_at(large.where("a_rows > 0 and b_rows > 0").withColumn("rank", rank))
        rows = rows.unionByName(large)
        spent.append(place)
    where = ["block", "digest", "piece", "rank"]
    one, two = (rows.where(F.col("side") == side).select(*where, F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"cells_{x}")) for side, x in ((1, "a"), (-1, "b")))
    # Hashes find blocks; that the cells agree is told by the distance.
    most = max(len(kinds) - len(block) for block in blocks)
    changed = F.concat_ws(",", *(F.when(~F.col("cells_a")[i].eqNullSafe(F.col("cells_b")[i]), F.lit(c)) for i, c in enumerate(names)))
    pairs = one.join(two, where).select("a", "b", F.least("n_a", "n_b").alias("n"), distance("cells_a", "cells_b", kinds).alias("apart"), changed.alias("changed"))
    pairs = pairs.where(F.floor("apart") <= most).groupBy("a", "b").agg(F.max("n").alias("n"), F.min("apart").alias("apart"), F.max("changed").alias("changed"))
    pairs, folder = written_at(pairs)
    for place in spent:
        delete_shared(pool.sparkSession, place)
    return pairs, folder


def assigned(pairs: DataFrame) -> DataFrame:
    """The candidates that are each other's best: least distance, then ids."""
    best = F.min(F.struct("apart", "a", "b")).alias("best")
    by_a, by_b = (pairs.groupBy(x).agg(best).select("best.*") for x in "ab")
    return pairs.join(by_a.intersect(by_b), ["apart", "a", "b"], "left_semi")


def pair_changed(src: DataFrame, tgt: DataFrame, most_changed: int = 1, blocks: list[list[str]] | None = None) -> DataFrame:
    """status (changed, missing, extra), n, changed (names), source and target (rows as structs) of the rows that differ.

    Rows with the same values on both sides cancel out first, copies included. n copies of a row can go to several partners, of which
    each result has its share. ``blocks`` names the columns that a changed row keeps, in place of all subsets that leave
    out up to ``most_changed`` columns. Null equals null. A changed column is never every column.
    """
    names = src.columns
    kinds = [f.dataType for f in src.schema.fields]
    if blocks is not None:
        rounds = [[tuple(names.index(c) for c in block)] for block in blocks]
    else:
        rounds = [blocks_of(len(names), d) for d in range(1, min(most_changed, len(names) - 1) + 1)]
    spark, found = src.sparkSession, []
    with short_shuffles(spark):
        rows = differing(src, tgt)
        pool, pool_folder = rows.select("side", "id", "n", "cells"), None
        for level in rounds:
            while True:
                pairs, folder = candidates(pool, names, kinds, level)
                new = written(assigned(pairs))
                delete_shared(spark, folder)
                if not new.take(1):
                    break
                found.append(new)
                used = new.select(F.lit(1).alias("side"), F.col("a").alias("id"), "n").unionByName(new.select(F.lit(-1).alias("side"), F.col("b").alias("id"), "n"))
                used = used.groupBy("side", "id").agg(F.sum("n").alias("used"))
                left = pool.join(used, ["side", "id"], "left").withColumn("n", F.col("n") - F.coalesce("used", F.lit(0))).drop("used").where("n > 0")
                before = pool_folder
                pool, pool_folder = written_at(left)
                if before:
                    delete_shared(spark, before)
    source, target = (rows.where(F.col("side") == side).select(F.col("id").alias(x), F.col("row").alias(name)) for side, x, name in ((1, "a", "source"), (-1, "b", "target")))
    one, two = (pool.where(F.col("side") == side).select(F.col("id").alias(x), "n") for side, x in ((1, "a"), (-1, "b")))
    alone = one.join(source, "a").select(F.lit("missing").alias("status"), "n", F.lit("").alias("changed"), "source", F.lit(None).cast(target.schema["target"].dataType).alias("target"))
    alone = alone.unionByName(two.join(target, "b").select(F.lit("extra").alias("status"), "n", F.lit("").alias("changed"), F.lit(None).cast(source.schema["source"].dataType).alias("source"), "target"))
    if not found:
        return alone
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("changed").alias("changed"))
    return pairs.join(source, "a").join(target, "b").select(F.lit("changed").alias("status"), "n", "changed", "source", "target").unionByName(alone)
