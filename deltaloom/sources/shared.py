"""Tables in the folder that all executors share, to cut lineage and compute costly columns once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the directory given to setCheckpointDir, else (in local mode only) a folder of our own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if (given := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return str(given.get()).rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="deltaloom-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def table(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """rows as a table, and its path: consumers read only their columns and nothing is computed again."""
    spark = rows.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def written(rows: DataFrame, name: str) -> DataFrame:
    return table(rows, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
