"""Chunked audio against whole arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import audio, long_audio


def signals(got, by):
    out = {}
    for r in sorted(got.collect(), key=lambda r: r.chunk):
        key = tuple(r[c] for c in by)
        assert r.start == len(out.get(key, []))
        out[key] = out.get(key, []) + list(r.samples)
    return out


def test_chunks_equal_a_concatenation(spark):
    rng = random.Random(3)
    rows, wanted = [], {}
    for book, pos in [(b, p) for p in range(12) for b in ("a", "b", None)]:
        n = rng.choice([0, 1, 3, 20, 50])
        samples = None if rng.random() < 0.1 else [rng.random() for _ in range(n)]
        rows.append((book, pos, samples))
        wanted[book,] = wanted.get((book,), []) + (samples or [])
    rows += [("short", 1, [0.5]), ("none", 1, []), ("none", 2, None)]
    wanted["short",] = [0.5]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "book string, pos int, samples array<double>")
    got = long_audio.chunked(df, ["book"], ["pos"], 16)
    assert signals(got, ["book"]) == wanted
    for r in got.collect():
        assert r.total == len(wanted[r.book,]) and r.chunks == max(1, r.total // 16)
        assert len(r.samples) == 16 or r.chunk == r.chunks - 1 and len(r.samples) < 32
    assert long_audio.chunked(df.limit(0), ["book"], ["pos"], 16).count() == 0


@pytest.mark.parametrize("rate, wanted", [(16000, 24000), (24000, 16000), (44100, 8000), (8000, 44100), (16000, 16000)])
def test_blocks_resample_like_the_whole(spark, rate, wanted):
    """Within a thousandth of the peak for sound below nine tenths of the lower rate's half."""
    size = long_audio.step(rate, wanted, 4096)
    unit = size // (size // (rate // np.gcd(rate, wanted)))
    n = (30_000 // unit) * unit
    rng, t = np.random.default_rng(4), np.arange(n)
    top = 0.45 * min(rate, wanted) / rate
    waves = [np.sin(2 * np.pi * f * t + p) for f, p in zip(rng.uniform(0.001, top, 20), rng.uniform(0, 6, 20), strict=True)]
    x = np.sum(waves, axis=0) * np.hanning(n) ** 0.5 / 20
    df = spark.createDataFrame([("k", i, x[i * 5000 : (i + 1) * 5000].tolist()) for i in range(-(-n // 5000))], "k string, pos int, samples array<double>")
    chunks = long_audio.chunked(df, ["k"], ["pos"], size)
    assert chunks.first().chunks > 3
    got = np.array(signals(long_audio.resampled(chunks, ["k"], rate, wanted), ["k"])["k",])
    whole = audio.resample(x, n * wanted // rate)
    assert len(got) == len(whole)
    assert np.abs(got - whole).max() < 1e-3 * np.abs(x).max()


def test_assembly_in_chunks_equals_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, p, rng.normal(size=int(rng.integers(1, 40))).tolist(), int(rng.choice([8000, 16000, 24000]))) for k in range(4) for p in range(6)] + [(0, 9, None, None), (1, -1, None, 8000)]
    df = spark.createDataFrame(rows, "doc int, pos int, samples array<float>, sample_rate int")
    wanted = {r.doc: r for r in audio.assemble(df, "doc").collect()}
    got = long_audio.assembled(df, "doc", size=1024)
    for key, samples in signals(got, ["doc"]).items():
        assert np.allclose(samples, wanted[key[0]].samples)
    assert {r.doc: r.sample_rate for r in got.collect()} == {k: r.sample_rate for k, r in wanted.items()}
    summed = {r.doc: r for r in long_audio.chunk_sums(got, ["doc"]).collect()}
    assert all(summed[k].samples == len(r.samples) and abs(summed[k].total - sum(r.samples)) < 1e-6 for k, r in wanted.items())


def test_a_segment_in_parts(spark):
    x = np.sin(np.arange(9000) / 30)
    rows = [("c", 0, 0, [0.0] * 10, 16000)] + [("c", 1, k, x[k * 1000 : (k + 1) * 1000].tolist(), 8000) for k in range(9)]
    df = spark.createDataFrame(rows, "chapter string, pos int, part int, samples array<double>, sample_rate int")
    got = signals(long_audio.assembled(df, "chapter", part="part", size=2048), ["chapter"])["chapter" and ("c",)]
    assert len(got) == 10 + 18_000
    assert np.abs(np.array(got[12:-2:2]) - x[1:-1]).max() < 2e-2  # the parts of one segment meet without a gap


def test_long_chapter_has_no_long_row(spark):
    """Half an hour, of which no row holds more than two chunks."""
    second = spark.range(1800).select(F.lit("c").alias("chapter"), F.col("id").alias("pos"), F.array_repeat(F.col("id") % 7 / 10.0, 8000).alias("samples"))
    chunks = long_audio.chunked(second, ["chapter"], ["pos"])
    r = chunks.agg(F.max(F.size("samples")), F.sum(F.size("samples")), F.count("*")).first()
    assert r[0] < 2 * long_audio.CHUNK and r[1] == 1800 * 8000 and r[2] == 1800 * 8000 // long_audio.CHUNK
    sums = long_audio.chunk_sums(chunks, ["chapter"]).first()
    assert abs(sums.total - sum(k % 7 / 10 * 8000 for k in range(1800))) < 1e-3


def test_wav_parts(spark):
    import io
    import wave

    x = np.sin(np.arange(5000) / 9) / 2
    df = spark.createDataFrame([("c", 0, x.tolist(), 8000)], "chapter string, pos int, samples array<double>, sample_rate int")
    parts = long_audio.wav_parts(long_audio.assembled(df, "chapter", size=1000), F.concat("chapter", F.lit(".wav"))).orderBy("part").collect()
    assert [r.name for r in parts] == ["c.wav"] * 5
    with wave.open(io.BytesIO(b"".join(r.content for r in parts)), "rb") as w:
        assert (w.getnframes(), w.getframerate(), w.getnchannels()) == (5000, 8000, 1)
    head = long_audio.wav_header(3 << 30, 24000)
    assert head[:4] == b"RF64" and len(head) == 80 and int.from_bytes(head[28:36], "little") == 6 << 30
