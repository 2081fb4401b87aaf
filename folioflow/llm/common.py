"""Helpers that several operators of this subpackage share.

Working tables go to the folder that the cluster names in
``spark.checkpoint.dir``; a folder of our own is used only in local mode, where
the driver and its tasks share one file system.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these.
SPACES = " \t\n\x0b\x0c\r"
#: A join side is broadcast only when its rows have been counted and are no more than this.
BROADCAST_ROWS = 200_000
LOCAL_WORK = "/tmp/checkpoints"


def _hadoop_path(spark: SparkSession, uri: str):
    """(Hadoop's file system, its path) of a URI; one without a scheme is on the cluster's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def work_dir(spark: SparkSession, name: str) -> str:
    """URI, with its scheme, of a new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{LOCAL_WORK}"
    system, path = _hadoop_path(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return system.makeQualified(path).toString()


def keep(df: DataFrame, path: str, tidy: bool = False) -> DataFrame:
    """Write df as Parquet and read it again: cuts the lineage and survives lost executors.

    tidy: also let go of the shuffle files of the steps that led here, which
    otherwise stay until the driver happens to collect its garbage.
    """
    df.write.mode("overwrite").parquet(path)
    if tidy:
        gc.collect()
        df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a working table that nothing reads any more."""
    system, target = _hadoop_path(spark, path)
    system.delete(target, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, else df as it is, for a shuffled join.

    df should be a written table, since it is counted here.
    """
    return F.broadcast(df) if df.count() <= limit else df


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none.

    Replacing and splitting at one literal character is several times as fast
    as splitting by a pattern.
    """
    spaced = F.coalesce(text, F.lit(""))
    for x in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(x), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def group_key(col: Column) -> Column:
    """A group's name that is never null, so that null is a group of its own."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), col))


#: Bits of seeded_hash.
HASH_BITS = 60


def seeded_hash(seed: int, *cols: Column) -> Column:
    """A number of HASH_BITS bits that shuffles rows alike in every run: the head of an MD5 sum, which SQL engines have too."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def bucket_bits(rows: int, per_bucket: int = 4096) -> int:
    """Bits of a bucket number so that about per_bucket of rows fall into each bucket."""
    return max(4, (max(rows, 1) // per_bucket).bit_length())
