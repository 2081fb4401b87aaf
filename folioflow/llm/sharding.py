"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded hash and ranked within their source; the
fractional rank (rank + 1/2) / rows of the source then interleaves the sources
in proportion, and cutting that one order into equal runs gives shards that all
have the corpus's mixture. Both ranks come from bucketed prefix sums, so no
window ever holds a whole source or the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import prefix_sums
from .common import HASH_BITS, bucket_bits, group_key, keep, seeded_hash, work_dir


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, source, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shards' row counts are at most one apart, and slots run
    without gaps from 0. Null and empty texts have size 1 and the checksum of
    nothing; a null source is a source of its own; repeated rows each get a slot,
    and equal rows may change places among each other only; equal texts are not
    kept together, and may be in different shards. An empty table gives no rows. Other columns of docs, whatever their names, are left out.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keep(
        docs.select(
            "doc_id",
            "source",
            group_key(F.col("source")).alias("_source"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            seeded_hash(seed, F.col("doc_id"), F.col("source"), F.crc32(text)).alias("_hash"),
        ),
        work_dir(spark, "shards") + "/rows",
    )
    total = rows.count()
    bits = bucket_bits(total)
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_hash", HASH_BITS - bits))
    order = ["_hash", "doc_id", "text_crc32"]
    ranked = prefix_sums(rows, ["_source"], "_bucket", order, F.lit(1), "_rank")
    counts = rows.groupBy("_source").agg(F.count("*").alias("_rows"))
    ranked = ranked.join(counts, "_source").withColumn("_fraction", (F.col("_rank") + 0.5) / F.col("_rows"))
    ranked = keep(
        ranked.select("doc_id", "source", "size", "text_crc32", "_hash", "_fraction"),
        work_dir(spark, "shards") + "/ranked",
    )
    ranked = ranked.withColumn("_bucket", F.floor(F.col("_fraction") * (1 << bits)))
    place = prefix_sums(ranked, [], "_bucket", ["_fraction", *order], F.lit(1), "_place")
    # Shard k holds the places from ceil(k * total / shards) on.
    shard = F.expr(f"(_place * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(({max(total, 1)}L * ((_place * {shards}L) div {max(total, 1)}L)) + {shards - 1}L) div {shards}L")
    return place.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("_place") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
