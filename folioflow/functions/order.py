"""Running numbers and sums in large groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..work import kept, work_folder

#: Rows of a bucket, about, and buckets at most; beyond that they hold more rows.
BUCKET_ROWS, MOST_BUCKETS = 65_536, 10_000


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str | Column], value: Column, out: str) -> DataFrame:
    """Add out: the sum of value over the rows of the same group that come before.

    bucket must not decrease along order. Each window then holds one bucket of
    one group, and only the buckets' sums are added up in sequence, so that a
    group with a third of all rows is spread over as many tasks as it has
    buckets. df is read twice; a written table suits best.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, keys)
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_before")
    )


def bucketed(df: DataFrame, keys: list[Column], bucket_rows: int | None = None) -> DataFrame:
    """df as a written table with _bucket: numbers that don't decrease along keys, for about bucket_rows rows each.

    Borders are quantiles that Spark takes from a sample, and refines where many rows
    fall between two, so they follow any distribution. Rows with equal keys are told
    apart by a hash of the row and by their place in the input, so a value that many
    rows share is cut into several buckets too. _tie and _row order them. df should
    be narrow.
    """
    folder = work_folder(df.sparkSession, "buckets")
    # Sampling reads the rows once more, so they are made once and written.
    df = kept(df, f"{folder}/rows")
    rows = df.count()
    buckets = min(MOST_BUCKETS, max(1, -(-rows // (bucket_rows or BUCKET_ROWS))))
    hashed = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    tied = df.withColumn("_tie", F.xxhash64(*hashed) if hashed else F.lit(0)).withColumn("_row", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(buckets, *keys, "_tie", "_row").withColumn("_bucket", F.spark_partition_id())
    return kept(dealt, f"{folder}/dealt")


def running_sums(df: DataFrame, group: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Add out: the sum of value over the rows of the same group that come before, for any distribution of group and order.

    Null groups are groups of their own. Rows that are equal in order come in the
    order of a hash of the row, alike in every run; of rows that are equal
    throughout it doesn't matter which comes first.
    """
    names = [f"_group{k}" for k in range(len(group))]
    placed = bucketed(df, [*map(F.col, group), *order])
    # Never null, so that joins keep every row.
    placed = placed.withColumns({n: F.when(F.col(g).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(g).cast("string"))) for n, g in zip(names, group, strict=True)})
    return prefix_sums(placed, names, "_bucket", [*order, F.col("_tie"), F.col("_row")], value, out).drop(*names, "_bucket", "_tie", "_row")


def numbered(df: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """Add out: 1, 2 and so on within each group by column order, with nulls last."""
    return running_sums(df, [group], [F.col(order).asc_nulls_last()], F.lit(1).cast("long"), out).withColumn(out, F.col(out) + 1)
