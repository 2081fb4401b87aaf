"""Numbers, sums and buckets of rows in any distribution, and work tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow import work
from folioflow.functions import order
from folioflow.plans.queries import QUERIES


def test_numbers_in_groups(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None, ""]), rng.choice([k, k, 7, None])) for k in rng.sample(range(-500, 100_000), 700)]
    df = spark.createDataFrame(rows, "g string, k long").withColumn("m", F.create_map(F.lit("x"), F.lit(1)))
    wanted = Counter()
    for g in {g for g, _ in rows}:
        ks = sorted((k for h, k in rows if h == g), key=lambda k: (k is None, k))
        wanted.update((g, k, n) for n, k in enumerate(ks, 1))
    for size in (65_536, 5):
        monkeypatch.setattr(order, "BUCKET_ROWS", size)
        got = order.numbered(df, "g", "k", "n")
        assert got.columns == ["g", "k", "m", "n"] and Counter((r.g, r.k, r.n) for r in got.collect()) == wanted
    assert order.numbered(df.limit(0), "g", "k", "n").count() == 0


def test_sums_in_groups(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), k, rng.randint(0, 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, k int, v int")
    got = order.running_sums(df, ["g"], [F.col("k")], F.col("v"), "before")
    wanted = {k: sum(x for h, j, x in rows if h == g and j < k) for g, k, _ in rows}
    assert {r.k: r.before for r in got.collect()} == wanted
    whole = order.running_sums(df, [], [F.col("k").desc()], F.col("v"), "before")
    assert {r.k: r.before for r in whole.collect()} == {k: sum(x for _, j, x in rows if j > k) for _, k, _ in rows}


def test_buckets_of_any_distribution(spark):
    """One far value, one group with a third of all rows, one value with a third of all rows, and rows that are equal throughout."""
    far = F.when(F.col("id") == 0, F.lit(10**15)).when(F.col("id") % 3 == 0, F.lit(77)).otherwise(F.col("id"))
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 1, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"), far.alias("k"))
    for keys in (["g", "k"], ["k"]):
        sizes = {r._bucket: r["count"] for r in order.bucketed(df, [F.col(k) for k in keys], 500).groupBy("_bucket").count().collect()}
        assert sum(sizes.values()) == 20_000 and len(sizes) >= 35 and max(sizes.values()) <= 1500
    same = spark.range(6000).select(F.lit("g").alias("g"), F.lit(1).alias("k"))
    assert max(r["count"] for r in order.bucketed(same, [F.col("k")], 500).groupBy("_bucket").count().collect()) <= 1500
    got = order.numbered(same, "g", "k", "n")
    assert sorted(r.n for r in got.collect()) == list(range(1, 6001))


def test_chapters_with_repeated_and_null_ids(spark, tmp_path):
    """Every document keeps one row, whatever its id."""
    docs = [(1, "One text. And more.", "a"), (1, "One text. And more.", "a"), (1, "Another.", "b"), (None, "No id.", "a"), (10**15, "Far.", "a"), (2, None, None)]
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.book: r for r in QUERIES["book_rollup"](spark, str(tmp_path)).collect()}
    assert {b: r.document_count for b, r in got.items()} == {"a": 4, "b": 1, None: 1}


def test_work_folders(spark):
    folder = work.work_folder(spark, "trial")
    assert work.kept(spark.range(3), f"{folder}/t").count() == 3
    assert work.drop_work(spark) >= 1 and work.drop_work(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{folder}/t").count()
