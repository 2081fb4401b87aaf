"""Data sources over files, and the sink that commits."""

import io
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow import sinks
from folioflow.operators import audio, long_audio
from folioflow.sources import audio as audio_source
from folioflow.sources import files


def write_wav(path, samples, rate=8000, channels=1, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples)


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "deep").mkdir()
    write_wav(tmp_path / "a.wav", rng.integers(-9000, 9000, 200_000).astype("<i2").tobytes())
    write_wav(tmp_path / "deep" / "B.WAV", rng.integers(0, 255, 3 * 2 * 500).astype(np.uint8).tobytes(), 24000, 2, 3)
    write_wav(tmp_path / "empty.wav", b"")
    (tmp_path / "bad.wav").write_text("no audio")
    (tmp_path / "short.wav").write_bytes((tmp_path / "a.wav").read_bytes()[:30])
    (tmp_path / "other.txt").write_text("x")
    return tmp_path


def test_headers_alone(spark, folder):
    rows = {r.file.rpartition("/")[2]: r for r in files.audio_headers(spark, str(folder)).collect()}
    assert set(rows) == {"a.wav", "B.WAV", "empty.wav", "bad.wav", "short.wav"}
    assert (rows["a.wav"].frames, rows["a.wav"].duration_seconds, rows["a.wav"].size) == (200_000, 25.0, 400_044)
    assert (rows["B.WAV"].frames, rows["B.WAV"].channels, rows["B.WAV"].bits) == (500, 2, 24)
    assert rows["empty.wav"].frames == 0 and rows["empty.wav"].error is None
    assert rows["bad.wav"].error and rows["short.wav"].error
    assert max(r.bytes_read for r in rows.values()) < 100
    flat = files.audio_headers(spark, str(folder), recursive=False, suffixes=[".wav"])
    assert flat.count() == 4


def test_filters_are_pushed(spark, folder):
    df = files.audio_headers(spark, str(folder))
    assert [r.frames for r in df.filter(F.col("file").endswith("/a.wav")).collect()] == [200_000]
    name = df.filter(F.col("file").endswith("B.WAV")).first().file
    assert df.filter(F.col("file") == name).count() == df.filter(F.col("file").isin(name, "x")).count() == 1
    assert df.filter(F.col("file").startswith("nowhere")).count() == 0
    reader = files.HeaderReader({"path": str(folder)})
    kept = list(reader.pushFilters([files.StringEndsWith(("file",), "a.wav"), files.EqualTo(("size",), 1)]))
    assert len(kept) == 1 and [len(p.value) for p in reader.partitions()] == [1]


def test_samples_in_ranges(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "SPLIT_BYTES", 100_000)
    monkeypatch.setattr(files, "FRAMES", 7000)
    parts = files.SampleReader({"path": str(folder)}).partitions()
    assert len(parts) >= 4 and sum(len(p.value) for p in parts) == 5 + 4
    rows = files.audio_samples(spark, str(folder)).collect()
    assert max(len(r.samples or ()) for r in rows) <= 1 << 17
    whole = {r.file.rpartition("/")[2]: r for r in audio_source.decode_audio(audio_source.list_audio(spark, str(folder))).collect()}
    for name in ("a.wav", "B.WAV"):
        mine = sorted((r for r in rows if r.file.endswith(name)), key=lambda r: r.start)
        assert [x for r in mine for x in r.samples] == whole[name].samples and mine[0].frames == len(whole[name].samples) // mine[0].channels
    assert {r.file.rpartition("/")[2] for r in rows if r.error} == {"bad.wav", "short.wav"}


def test_metrics_of_ranges_equal_those_of_files(spark, folder):
    whole = audio.signal_metrics(audio_source.decode_audio(audio_source.list_audio(spark, str(folder)))).filter("error IS NULL")
    wanted = {r.file.rpartition("/")[2]: [r[c] for c in audio.METRICS] for r in whole.collect()}
    got = long_audio.chunk_metrics(files.audio_samples(spark, str(folder)).filter("error IS NULL"), ["file"])
    for r in got.collect():
        assert [r[c] for c in audio.METRICS] == pytest.approx(wanted.pop(r.file.rpartition("/")[2]), abs=2e-3)
    assert not wanted


def test_members_of_containers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.epub", "w") as z:
        z.writestr("META-INF/container.xml", "<x/>")
        z.writestr("text/a.xhtml", "<p>a</p>")
        z.writestr("cover.jpg", b"\xff" * 1000)
    (tmp_path / "broken.epub").write_text("no zip")
    df = files.container_members(spark, str(tmp_path))
    assert {(r.name, r.size) for r in df.collect()} == {("META-INF/container.xml", 4), ("text/a.xhtml", 8), ("cover.jpg", 1000)}
    assert [bytes(r.content) for r in df.filter(F.col("name").endswith(".xhtml")).collect()] == [b"<p>a</p>"]


def test_files_appear_together(spark, tmp_path):
    out = tmp_path / "out"
    parts = [("a/x.bin", k, bytes([k]) * 3) for k in range(50)] + [("y.bin", 0, b"y"), ("z.bin", 0, b""), (None, 0, b"n"), ("n.bin", 0, None)]
    df = spark.createDataFrame(parts, "name string, part long, content binary").repartition(4)
    sinks.write_parts(df, str(out))
    assert (out / "a" / "x.bin").read_bytes() == b"".join(bytes([k]) * 3 for k in range(50))
    assert sorted(p.name for p in out.iterdir()) == ["a", "y.bin", "z.bin"]
    with pytest.raises(Exception, match="files exist"):
        sinks.write_parts(df.filter("name = 'y.bin'"), str(out), overwrite=False)
    sinks.write_parts(spark.createDataFrame([("y.bin", 0, b"new")], df.schema), str(out))
    assert (out / "y.bin").read_bytes() == b"new" and sorted(p.name for p in out.iterdir()) == ["a", "y.bin", "z.bin"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"

    @F.udf("binary")
    def broken(k):
        if k == 150:
            raise RuntimeError("lost")
        return b"x" * 10

    df = spark.range(200).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit(0).alias("part"), broken("id").alias("content"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_parts(df, str(out))
    assert not out.exists() or not list(out.iterdir())


def test_long_chapter_to_a_file(spark, tmp_path):
    second = spark.range(120).select(F.lit("c").alias("chapter"), F.col("id").alias("pos"), F.lit(8000).alias("sample_rate"), F.array_repeat(F.lit(0.25), 8000).alias("samples"))
    chunks = long_audio.assembled(second, "chapter")
    sinks.write_parts(long_audio.wav_parts(chunks, F.lit("c.wav")), str(tmp_path))
    with wave.open(io.BytesIO((tmp_path / "c.wav").read_bytes()), "rb") as w:
        assert w.getnframes() == 120 * 8000
    assert files.audio_headers(spark, str(tmp_path)).first().duration_seconds == 120.0
