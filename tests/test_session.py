"""The session helpers."""

import os
import subprocess
import sys
import time

import pytest

from verdigris.functions import session


def test_written_tables_and_their_deletion(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, "x", None)], "k int, v string, l array<string>")
    made = session.written(df)
    assert made.schema == df.schema and sorted(map(tuple, made.collect())) == sorted(map(tuple, df.collect()))
    assert session.written(df.limit(0)).collect() == []
    folder = made.inputFiles()[0].removeprefix("file:").lstrip("/").rsplit("/", 1)[0]
    assert os.path.isdir(f"/{folder}")
    session.delete_shared(spark, f"file:///{folder}")
    assert not os.path.isdir(f"/{folder}")


@pytest.mark.parametrize("last", ["", "spark.stop()", "raise RuntimeError"])
def test_nothing_written_is_left_when_the_application_ends(tmp_path, last):
    told = f"""
from pyspark.sql import SparkSession
from verdigris.functions import session
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
for n in (0, 5):
    assert session.written(spark.range(n)).count() == n
spark.range(3).write.parquet(session.shared_folder(spark, "own") + "/below")
{last}
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with subprocess.Popen([sys.executable, "-c", told], cwd=root, stderr=subprocess.DEVNULL) as run:
        assert (run.wait(120) != 0) == last.startswith("raise")
    for _ in range(200):  # the JVM ends after Python
        left = [p for p in tmp_path.rglob("*") if p.is_file()]
        if not left:
            break
        time.sleep(0.1)
    assert left == []


def test_batches_are_short_for_texts_and_long_for_numbers(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for now, after in (("10000", "1000"), ("0", "1000"), ("50", "50")):
            spark.conf.set(key, now)
            session.short_batches(spark)
            assert spark.conf.get(key) == after
            with session.long_batches(spark, 7000):
                assert spark.conf.get(key) == "7000"
            assert spark.conf.get(key) == after
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("master,conf,fails", [("local[2]", None, False), ("local", None, False), ("yarn", None, True), ("local-cluster[2,1,1024]", None, True), ("yarn", "hdfs:///shared", False)])
def test_a_cluster_needs_a_shared_folder(master, conf, fails):
    class Nowhere:
        """A session of some master that has no checkpoint folder yet."""

        def __init__(self):
            self.master, self.folder, self.sparkContext, self.conf, self._jsc = master, None, self, self, self

        def sc(self):
            return self

        getConf = getCheckpointDir = sc

        def isDefined(self):
            return False

        def get(self, key, default=None):
            return conf

        def setCheckpointDir(self, folder):
            self.folder = folder

    spark = Nowhere()
    if fails:
        with pytest.raises(RuntimeError):
            session.ensure_checkpoint_dir(spark)
    else:
        session.ensure_checkpoint_dir(spark)
        assert spark.folder == conf or not conf
