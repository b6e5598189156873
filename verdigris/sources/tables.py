"""Tables from Parquet folders and databases, and the report's way out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, table: str, *, column: str | None = None, low: int = 0, high: int = 0, partitions: int = 1, pushdown: bool = True, **options: str) -> DataFrame:
    """A database table. Timestamps without a zone stay without one, so no session zone can shift them.

    With ``column`` the read is split in ``partitions`` ranges of it. ``pushdown`` off keeps filters out of
    databases whose types do not compare (long texts).
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("preferTimestampNTZ", "true").option("pushDownPredicate", str(pushdown).lower())
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions)
    return reader.options(**options).load()


def write_report(report: DataFrame, path: str, kind: str = "parquet") -> None:
    """A report as files of the given kind, replacing what the path held."""
    report.write.format(kind).mode("overwrite").save(path)
