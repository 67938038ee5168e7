"""Intermediate tables in a folder that all executors share.

The folder is the one that the cluster names in ``spark.checkpoint.dir``. A temporary
one stands in only where none is named and the session is local; a cluster without a
shared folder is an error, as its executors would each write to a disk of their own.
Reading a written table back ends its lineage, so that a lost executor costs a re-read,
and gives the planner true sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session or, failing that, of its context."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str = "table") -> str:
    """A path in the shared folder that Hadoop deletes when the application ends."""
    path = f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    return path


def materialize(df: DataFrame, label: str = "table", compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where, files = _file_system(df.sparkSession, folder)
        files.delete(where, True)
