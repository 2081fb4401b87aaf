"""Work tables in the folder that driver and executors share.

They cut lineage, survive lost executors and live until drop_work or the end of the
application, when its folders go.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_WORK = "/tmp/checkpoints"
_FOLDERS: dict[str, list[str]] = {}


def _hadoop_path(spark: SparkSession, uri: str):
    """(Hadoop's file system, its path) of a URI; one without a scheme is on the cluster's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def work_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder in spark.checkpoint.dir; a folder of our own is used only in local mode, where tasks share the driver's disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{LOCAL_WORK}"
    system, path = _hadoop_path(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    folder = system.makeQualified(path).toString()
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = []
        atexit.register(_at_exit, spark, app)
    _FOLDERS[app].append(folder)
    return folder


def kept(df: DataFrame, path: str) -> DataFrame:
    """df, written as Parquet and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_work(spark: SparkSession) -> int:
    """Delete the work folders of this application, whose lazy results must not be read any more; returns their number."""
    folders = _FOLDERS.get(spark.sparkContext.applicationId, [])
    count = len(folders)
    while folders:
        system, path = _hadoop_path(spark, folders.pop())
        system.delete(path, True)
    return count


def _at_exit(spark: SparkSession, app: str) -> None:
    # A session that has been stopped can't reach the file system; its folders are left to the cluster's own clean-up.
    if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
        drop_work(spark)
