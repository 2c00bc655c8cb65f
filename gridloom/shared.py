"""Tables in the folder that driver and executors share: written once, read as often as needed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset (a local session, as in tests) a folder of our own is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return sc.getCheckpointDir().rstrip("/")


def hadoop_delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def session_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one, that goes when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(p)
    store.deleteOnExit(p)
    return path


def stored(df: DataFrame, kind: str = "table", spread: bool = False) -> DataFrame:
    """The rows of df from a Parquet copy: its lineage is cut, and readers take the columns they need.

    With `spread`, for tables that much work follows on, a copy of fewer files than the cluster has cores
    (as a small or unsplittable source gives) is written again in as many.
    """
    spark = df.sparkSession
    folder = session_folder(spark, kind)
    df.write.parquet(f"{folder}/data")
    back = spark.read.schema(df.schema).parquet(f"{folder}/data")
    cores = spark.sparkContext.defaultParallelism
    if spread and back._jdf.rdd().getNumPartitions() < cores:
        back.repartition(cores).write.parquet(f"{folder}/spread")
        back = spark.read.schema(df.schema).parquet(f"{folder}/spread")
    return back
