"""Session helpers: the shared folder for checkpoints, and the library's code on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

import verdigris


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch of texts, in each of which a text may be long.
TEXT_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """At most ``TEXT_ROWS`` rows in an Arrow batch from now on, unless the session has fewer; memory follows from it."""
    if not 0 < int(spark.conf.get(_BATCH)) <= TEXT_ROWS:
        spark.conf.set(_BATCH, TEXT_ROWS)


@contextmanager
def long_batches(spark: SparkSession, rows: int = 10_000) -> Iterator[None]:
    """Arrow batches of so many rows, for numbers alone, in what is computed inside."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


_SHORT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that is run inside go when it ends, not only when the driver collects its garbage."""
    before = spark.conf.get(_SHORT, None)
    spark.conf.set(_SHORT, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHORT) if before is None else spark.conf.set(_SHORT, before)


def kept_in_files(df: DataFrame) -> bool:
    """Whether ``df`` is a table of files as it is read, which can be read again at little cost and with the same rows."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and bool(df.inputFiles())


def deterministic(df: DataFrame) -> bool:
    """Whether ``df`` has the same rows whenever it is computed from the same tables."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.deterministic()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if getattr(sc, "_verdigris_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(verdigris.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="verdigris-"), "verdigris.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("verdigris", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._verdigris_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only where none is set in local mode (tests), a folder of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="verdigris-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once into the shared checkpoint folder; its lineage ends there. For few rows (see ``written``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, which is far cheaper than ``cut`` for many rows.

    It is deleted when the application ends.
    """
    return written_at(df)[0]


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``written``, and the folder, for those who can tell when it is no longer needed (``delete_shared``)."""
    spark = df.sparkSession
    folder = shared_folder(spark, "table")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; what is written there is deleted when the application ends.

    All such paths are in one folder, which is made here, as only one that exists can be marked for deletion.
    """
    ensure_checkpoint_dir(spark)
    parent = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/verdigris"
    files, path = _files(spark, parent)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{parent}/{name}_{uuid.uuid4().hex}"


def delete_shared(spark: SparkSession, folder: str) -> None:
    """Delete a folder that Spark wrote, in whatever store it is."""
    files, path = _files(spark, folder)
    files.delete(path, True)


def _files(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
