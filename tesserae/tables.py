"""Tables in the shared folder: what several consumers read is written once, and lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one of this machine in local mode
    (tests), and an error on a cluster, whose executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_written: list[str] = []
_cleaned = 0


def generation() -> int:
    """How often clean_up has run: tables kept from before are gone."""
    return _cleaned


#: Spark's own setting by which an execution's shuffle files go when it has ended.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as a Parquet table in the shared folder and returns its scan. The table survives the loss of any
    executor, and stays until clean_up or discard. What was shuffled to make it is removed as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    kept = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, kept)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*dfs: DataFrame) -> None:
    """Deletes tables that materialize made, once nothing that is still to run reads them; others are left alone."""
    for df in dfs:
        spark, files = df.sparkSession, df.inputFiles()
        path = files[0].rpartition("/")[0] if files else None
        mine = next((w for w in _written if path and path.partition(":")[2].lstrip("/") == w.partition(":")[2].lstrip("/")), None)
        if mine:
            _written.remove(mine)
            at = spark._jvm.org.apache.hadoop.fs.Path(mine)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean_up(spark: SparkSession) -> int:
    """Deletes the tables that this process has materialized, once results that read them have been written; how many."""
    global _cleaned
    _cleaned += 1
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
