"""Mixing sources to target weights with a time-varying curriculum.

Each source has a schedule of weights over training time; the integral of its
schedule is the source's cumulative token demand, and inverting that gives the
time at which each of its documents is due. Documents are then range-sorted by
that time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import prefix_sums
from .common import HASH_BITS, bucket_bits, group_key, keep, seeded_hash, small_side, word_count, work_dir

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: The mix takes this share of all words, and no source more than this multiple of its words.
SHARE, MOST = 1.5, 2
#: Schedules, dealt like the weights: (time, relative weight) knots that are joined by straight lines.
SCHEDULES = (
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)),
)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add number, weight and target to sizes, which has one row per source: source, source_size.

    A target is weight * level, but most * source_size at most; the level is
    where the targets make up share of all sizes. Sharing the excess out again
    by weight until no source is above its limit ends at the same level. Null
    counts as the last source; an empty table gives no rows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    table = sizes.withColumn("number", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    # With the sources in order of limit / weight, a first few are at their limits.
    order = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(full), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))
    levels = table.withColumn("_level", left / open_weight).withColumn("_at", F.row_number().over(order))
    level = F.min_by(
        F.when(F.col("_level") <= F.col("limit") / F.col("weight"), F.col("_level")),
        F.when(F.col("_level") <= F.col("limit") / F.col("weight"), F.col("_at")),
    ).over(whole)
    target = F.least("limit", F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    return levels.withColumn("target", target).drop("_level", "_at", "limit")


def due(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time, 0 to 1, at which a source with this schedule has given out a share of its words."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:], strict=True):
        pieces.append((t0, w0, t1, w1, total))
        total += (w0 + w1) / 2 * (t1 - t0)
    out = F.lit(1.0)
    for t0, w0, t1, w1, before in reversed(pieces):
        need, slope = share * total - before, (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = need, in a form that also holds where slope is 0
        x = 2 * need / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0))))
        out = F.when(share * total <= before + (w0 + w1) / 2 * (t1 - t0), F.least(F.lit(t0) + x, F.lit(t1))).otherwise(out)
    return F.greatest(out, F.lit(0.0))


def _bucketed(docs: DataFrame, size: Column, seed: int, bits: int) -> DataFrame:
    shuffled = seeded_hash(seed, F.col("doc_id"), F.col("source"), F.col("_size"))
    return (
        docs.withColumn("_size", size)
        .withColumn("_source", group_key(F.col("source")))
        .withColumn("_hash", shuffled)
        .withColumn("_bucket", F.shiftrightunsigned("_hash", HASH_BITS - bits))
    )


def _placed(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add _start (words of the source before the row), source_size, number and target."""
    sizes = rows.groupBy("_source").agg(F.min("source").alias("source"), F.sum("_size").alias("source_size"))
    table = keep(targets(sizes, weights, share, most).drop("source"), work_dir(rows.sparkSession, "mix") + "/targets")
    return prefix_sums(rows, ["_source"], "_bucket", ["_hash", "doc_id"], F.col("_size"), "_start").join(small_side(table), "_source")


def _taken(epoch: int, whole: bool) -> Column:
    """Words that the mix takes of a document in an epoch: what of it lies before the target."""
    start = F.col("_start") + epoch * F.col("source_size")
    end = F.round("target").cast("long")
    if whole:
        return F.when((F.col("_size") > 0) & (2 * start + F.col("_size") <= 2 * end), F.col("_size")).otherwise(F.lit(0))
    return F.greatest(F.least(end - start, F.col("_size")), F.lit(0))


def _position(epoch: int, schedules) -> Column:
    start = F.col("_start") + epoch * F.col("source_size")
    share = (start + F.col("_size") / 2) / F.greatest(F.col("target"), F.lit(1.0))
    out = F.lit(1.0)
    for k, knots in enumerate(schedules):
        out = F.when(F.col("number") % len(schedules) == k, due(F.least(share, F.lit(1.0)), knots)).otherwise(out)
    return out


def mix_sources(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share=SHARE, most=MOST, seed: int = 23) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, positions, whole_words; by first position.

    size: words. taken: words that the mix takes of the document, repeats
    counted; a source's taken words add up to its target, rounded. A source's
    documents come in the order of a seeded hash, all of them before any again,
    and one document at most is taken in part. positions: the times at which the
    document is due, one for each time that the mix takes of it. whole_words:
    what mixed_documents takes, which rounds that part to all or nothing. Rows
    are range-sorted by first position, those that are not taken at the end.
    Null and empty texts have size 0 and are never taken; a null source is a
    source of its own; equal rows may change places among each other only; an
    empty table gives no rows. Other columns of docs, whatever their names, are
    left out. Reruns agree.

    Targets are computed over one row per source in one task, which suits up to
    some millions of sources. Rows with the same doc_id, source and size are
    ordered in one task, as nothing tells them apart.
    """
    spark, epochs = docs.sparkSession, range(int(-(-most // 1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = keep(rows, work_dir(spark, "mix") + "/rows")
    placed = _placed(_bucketed(rows, F.col("size"), seed, bucket_bits(rows.count())), weights, share, most)
    plan = F.array(*[F.struct(_taken(e, False).alias("words"), _position(e, schedules).alias("position")) for e in epochs])
    due_at = F.transform(F.filter(plan, lambda x: x["words"] > 0), lambda x: x["position"])
    out = placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        sum((_taken(e, False) for e in epochs), F.lit(0)).cast("long").alias("taken"),
        due_at.alias("positions"),
        sum((_taken(e, True) for e in epochs), F.lit(0)).cast("long").alias("whole_words"),
        "_hash",
    )
    order = [F.get("positions", F.lit(0)).asc_nulls_last(), F.col("_hash"), F.col("doc_id")]
    return out.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_hash")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share=SHARE, most=MOST, seed: int = 23) -> DataFrame:
    """The documents of the mix in training order: columns of docs, whole rows, repeats included.

    As mix_sources, but a document is taken whole in an epoch if its middle lies
    before the target, else not at all; so a source misses its target by half a
    document at most. Rows are sorted by position across and within partitions.
    docs needs doc_id, text and source; its other columns are carried along,
    whatever their names. See mix_sources for odd inputs.
    """
    epochs, parts = range(int(-(-most // 1))), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, "doc_id", "source", word_count(F.col("text")).alias("size"))
    placed = _placed(_bucketed(rows, F.col("size"), seed, bucket_bits(docs.count())), weights, share, most)
    plan = F.array(*[F.struct(_taken(e, True).alias("words"), _position(e, schedules).alias("position")) for e in epochs])
    due_rows = placed.select("_row", "_hash", F.explode(F.filter(plan, lambda x: x["words"] > 0)).alias("_due"))
    order = [F.col("_due.position"), F.col("_hash")]
    return due_rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_row.*")
