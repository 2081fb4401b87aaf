"""The stream that tells what is done."""

import time

from folioflow.streaming import progress


def test_chapters_done_rise(spark, tmp_path):
    for k in range(3):
        rows = [("a", k + 1, "Some text."), ("a", 10 + k, "More."), ("b", k + 1, "Other text.")] + ([(None, 1, "No book.")] if k == 2 else [])
        spark.createDataFrame(rows, "book string, chapter int, segment string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told = []
    query, listener = progress.narrate(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", lambda *x: told.append(x))
    assert query.awaitTermination(120)
    for _ in range(100):
        if listener.all == 10:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert [d for b, d, n in told if b == "a"] == [2, 4, 6] and [d for b, d, n in told if b == "b"] == [1, 2, 3]
    assert {n for b, _, n in told if b == "a"} == {6} and told[-1] == (None, 10, 10)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 10 and out.filter("size(samples) > 0").count() == 10

    # Nothing is left to do for a second run, and a new chapter goes on from what is done.
    spark.createDataFrame([("b", 9, "Late.")], "book string, chapter int, segment string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told.clear()
    query, listener = progress.narrate(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", lambda *x: told.append(x))
    assert query.awaitTermination(120)
    for _ in range(100):
        if listener.all == 11:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert told == [("b", 4, 4), (None, 11, 11)]


def test_too_many_books(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(progress, "MOST_BOOKS", 3)
    spark.createDataFrame([(f"b{k}", 1, "x") for k in range(5)], "book string, chapter int, segment string").write.parquet(f"{tmp_path}/in")
    told = []
    query, listener = progress.narrate(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", lambda *x: told.append(x), files=10)
    assert query.awaitTermination(120)
    for _ in range(100):
        if listener.all == 5:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert told == [(None, 5, 5)]
