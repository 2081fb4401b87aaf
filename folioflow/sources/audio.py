"""Audio files as rows of samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .files import pcm_samples

SCHEMA = "file string, sample_rate int, channels int, samples array<float>, error string"


def list_audio(spark: SparkSession, path: str, recursive: bool = True, suffixes: Sequence[str] = C.AUDIO_SUFFIXES) -> DataFrame:
    """file and content of the audio files in a folder, by suffix in any case.

    Lists are sorted where they are made, so that no content is sorted along.
    files.audio_headers and files.audio_samples read headers and stretches of files
    instead of all of them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1))
    return files.filter(suffix.isin(*[s.lower() for s in suffixes])).select(F.col("path").alias("file"), "content")


def header_durations(files: DataFrame) -> DataFrame:
    """file, sample_rate, channels, frames, duration_seconds of WAV files whose content is at hand, by their headers; nulls where there is none."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, content in zip(f["file"], f["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content), "rb") as w:
                        out.append((name, w.getframerate(), w.getnchannels(), w.getnframes()))
                except (wave.Error, EOFError):
                    out.append((name, None, None, None))
            yield pd.DataFrame(out, columns=["file", "sample_rate", "channels", "frames"])

    found = files.select("file", "content").mapInPandas(rows, "file string, sample_rate int, channels int, frames long")
    return found.withColumn("duration_seconds", F.when(F.col("sample_rate") > 0, F.col("frames") / F.col("sample_rate")))


def decode_pcm(content: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, interleaved samples from -1 to below 1) of an uncompressed WAV file."""
    with wave.open(io.BytesIO(content), "rb") as w:
        width, raw = w.getsampwidth(), w.readframes(w.getnframes())
        rate, channels = w.getframerate(), w.getnchannels()
    return rate, channels, pcm_samples(raw, width)


def decode_audio(files: DataFrame) -> DataFrame:
    """file, sample_rate, channels, samples; where a file can't be read, error says why and the rest is null."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["file"], f["content"], strict=True):
                try:
                    row = (name, *decode_pcm(content), None)
                except (wave.Error, EOFError, ValueError) as e:
                    row = (name, None, None, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["file", "sample_rate", "channels", "samples", "error"])

    return files.mapInPandas(rows, SCHEMA)


def encode_pcm16(samples: np.ndarray, rate: int) -> bytes:
    """A mono WAV file of 16-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(np.asarray(samples) * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def with_wav(audio: DataFrame) -> DataFrame:
    """Add wav (BINARY) to rows with samples and sample_rate."""

    @F.pandas_udf("binary")
    def encode(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else encode_pcm16(s, int(r)) for s, r in zip(samples, rate, strict=True)])

    return audio.withColumn("wav", encode("samples", "sample_rate"))
