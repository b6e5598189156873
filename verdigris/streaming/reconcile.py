"""Reconciliation of dual writes: what one of two systems has and the other lacks, told as event time passes.

Both streams are folded into one row of state for each key and event time: how often each side has it and what it holds. The state is given up, and told if
the sides do not agree, when the watermark has passed its time; so it holds no more than the rows of the last ``delay``, and rows of either side may be
late by as much. The same function over two tables is the batch answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from verdigris.functions.values import free_name, named, row_digest
from verdigris.operators.digest_tree import as_number


def reconcile(source: DataFrame, target: DataFrame, keys: list[str], cols: list[str], time: str, delay: str) -> DataFrame:
    """keys, the event time, n_source, n_target and status of the rows on which the sides do not agree; two streams or two tables.

    status is source_only, target_only, repeated (more than once on a side) or changed. A row whose event time differs on the sides is one of each. Null
    keys are keys; rows without an event time can't be ordered and are left out. Results named like a key get an underscore.
    """
    kind = next(f.dataType for f in source.schema.fields if f.name == time)
    if not isinstance(kind, (TimestampType, TimestampNTZType)):
        raise ValueError(f"event times are timestamps, not {kind.simpleString()}")

    def side(df: DataFrame, source: int, target: int) -> DataFrame:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        digest = row_digest([(c, kinds[c]) for c in cols])
        # Times without a zone count as UTC, in which no hour is missing or doubled.
        at = F.timestamp_micros(as_number(named(time), kinds[time])).alias("__at")
        return df.select(*(named(k).alias(f"__k{i}") for i, k in enumerate(keys)), at, F.lit(source).alias("__s"), F.lit(target).alias("__t"), digest.alias("__digest"))

    both = side(source, 1, 0).unionByName(side(target, 0, 1)).where("__at is not null").withWatermark("__at", delay)
    rows = both.groupBy(*(f"__k{i}" for i in range(len(keys))), "__at").agg(
        F.sum("__s").alias("__s"), F.sum("__t").alias("__t"), F.min("__digest").alias("__least"), F.max("__digest").alias("__most")
    )
    status = F.when(F.col("__t") == 0, "source_only").when(F.col("__s") == 0, "target_only").when((F.col("__s") > 1) | (F.col("__t") > 1), "repeated")
    rows = rows.withColumn("__status", status.when(F.col("__least") != F.col("__most"), "changed")).where("__status is not null")
    told = F.timestamp_add("MICROSECOND", F.unix_micros("__at"), F.lit("1970-01-01").cast("timestamp_ntz")) if isinstance(kind, TimestampNTZType) else F.col("__at")
    names = [*keys, time]
    for name in ("n_source", "n_target", "status"):
        names.append(free_name(name, names))
    return rows.select(*(f"__k{i}" for i in range(len(keys))), told, "__s", "__t", "__status").toDF(*names)


def catch_up(found: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now, append what it tells to ``path``, and return all told so far.

    Started again with the same checkpoint it goes on where it was, with the state it had.
    """
    query = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return found.sparkSession.read.schema(found.schema).parquet(path)


def stream_table(spark, path: str, schema) -> DataFrame:
    """Parquet files of a folder, or of what a pattern names, as a stream, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)
