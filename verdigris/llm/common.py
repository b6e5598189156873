"""What the text operators share: per-document Arrow tasks, document keys, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.session import cut, ship_code, short_batches

#: Texts are handed to the Python helpers in slices of about so many UTF-8 bytes.
SLICE_BYTES = 1_000_000


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text being empty; other columns cannot clash afterwards."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def document_key() -> Column:
    """A digest of id and text (null: empty). Rows alike in both are one document, and share every result."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside ``body`` use it for each element."""
    return F.transform(F.array(value), body)[0]


def running(numbers: Column, start: int, step: Callable[[Column, Column], Column], chunk: int = 128) -> Column:
    """``start``, then what ``step`` makes of it and the first 1, 2 ... elements of an array<bigint>; ``step`` is associative.

    The array is cut in chunks so that long arrays stay cheap.
    """
    begin = F.lit(start).cast("bigint")

    def within(part: Column, first: Column) -> Column:
        return F.aggregate(part, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def chunked(numbers: Column) -> Column:
        count = F.ceil(F.size(numbers) / F.lit(chunk)).cast("int")
        parts = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.slice(numbers, k * chunk + 1, F.lit(chunk)))

        def joined(parts: Column) -> Column:
            starts = within(F.transform(parts, lambda p: F.aggregate(p, begin, step)), begin)
            inner = let(starts, lambda starts: F.flatten(F.transform(parts, lambda p, k: F.slice(within(p, F.element_at(starts, k + 1)), 2, chunk))))
            return F.concat(F.array(begin), inner)

        return let(parts, joined)

    return let(numbers, chunked)


def running_sums(numbers: Column) -> Column:
    """Sums of the first 0, 1, 2 ... elements of an array<bigint>."""
    return running(numbers, 0, lambda a, x: a + x)


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of at most ``most`` bytes of text each, one row at least."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + (n or 0) > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


#: What a Python worker keeps between tasks, by the stage it is kept for (None outside of tasks) and its name.
_KEPT: dict[tuple, object] = {}


def let_go() -> None:
    """At the start of a task: what the Python worker keeps for another stage goes, since workers outlive stages."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if gone := [k for k in _KEPT if k[0] != stage]:
        for k in gone:
            del _KEPT[k]
        pa.default_memory_pool().release_unused()


def kept(name: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, such as a model with its caches; made once in a Python worker for all its tasks of a stage."""
    let_go()
    task = TaskContext.get()
    key = (task.stageId() if task else None, *name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def per_text(docs: DataFrame, helper: Callable[[list[str]], list], fields: str) -> DataFrame:
    """One row for each document: doc_id and the columns that ``helper`` makes of a list of texts.

    ``fields`` is the DDL of those columns; ``helper`` returns a list or array for each, in order.
    """
    ship_code(docs.sparkSession)
    short_batches(docs.sparkSession)
    texts = texts_of(docs)
    schema = texts.select("doc_id").schema
    for field in _ddl(fields):
        schema.add(field)
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in sliced(batch):
                made = helper(part.column(1).to_pylist())
                arrays = [part.column(0), *(pa.array(x, f.type) for x, f in zip(made, list(arrow)[1:]))]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return texts.mapInArrow(run, schema)


def where_text(docs: DataFrame, decide: Callable[[list[str]], list]) -> DataFrame:
    """The rows of ``docs``, all columns, for which ``decide`` says true of the text (null: empty); no shuffle."""
    ship_code(docs.sparkSession)
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in sliced(batch):
                yield part.filter(pa.array(decide([t or "" for t in part.column("text").to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _ddl(fields: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(fields)


def _arrow_schema(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


#: A key that holds more than one in so many rows, and more than ``LEAST_HUB`` of them, is a hub.
HUB, LEAST_HUB = 1000, 200


def hub_join(rows: DataFrame, values: DataFrame, key: str | list[str], total: int, by_place: bool = False) -> DataFrame:
    """``rows`` joined with ``values`` on ``key``, where a few keys may hold much of ``rows``.

    ``values`` has each key once, with n, the number of its rows (left out of the result); ``total`` is their sum.
    A key with more than one row in ``HUB`` is dealt out in pieces of that size, its value being repeated for each. Fewer
    than ``HUB`` keys can have so many, which bounds what is broadcast.

    Rows are dealt by what they hold, so that rows alike in all columns stay together. ``by_place`` deals them by
    their place instead, repeated rows too; it is for rows that come from a written table without a shuffle, which a task
    that runs again reads in the same order.
    """
    keys = [key] if isinstance(key, str) else key
    pieces = F.ceil(F.col("n") / F.lit(max(total / HUB, LEAST_HUB))).cast("int")
    hubs = values.where(pieces > 1).select(*keys, pieces.alias("__pieces"))
    told = [F.monotonically_increasing_id()] if by_place else [F.col(c) for c in rows.columns]
    dealt = rows.withColumn("__salt", F.xxhash64(*told)).join(F.broadcast(hubs), keys, "left")
    dealt = dealt.withColumn("__salt", F.pmod("__salt", F.coalesce("__pieces", F.lit(1)))).drop("__pieces")
    salts = F.sequence(F.lit(0).cast("long"), F.greatest(pieces, F.lit(1)).cast("long") - 1)
    copies = values.withColumn("__salt", F.explode(salts)).drop("n")
    return dealt.join(copies, [*keys, "__salt"]).drop("__salt")


#: Links in a partition of a round of ``connected_components``, and partitions that links may have however few they are.
LINKS, LEAST_PARTS = 50_000, 8


def _gathered(links: DataFrame, most: int) -> DataFrame:
    """``links``, at most so many, without a shuffle in no more partitions than they need: each is a task and files in every round."""
    return links.coalesce(max(LEAST_PARTS, -(-most // LINKS)))


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Components of an undirected graph given as links (a, b): rows (node, root), root the smallest.

    Alternates the large-star and small-star steps until no link changes; links stay distributed,
    and each round ends in the shared checkpoint folder. Only nodes other than roots are listed.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = cut(edges.where("a <> b").select(hi.alias("a"), lo.alias("b")).distinct())
    mark = _mark(now)
    now = _gathered(now, mark[0])
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = hub_join(both, least, "a", 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            hub_join(large, least, "a", 2 * mark[0])
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        now = cut(_gathered(small, 2 * mark[0]))  # a link makes two at most
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"the components did not settle in {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free sum of hashes: two numbers that tell whether a set of links changed."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
