"""Signal metrics, assembly and timelines of sampled audio: one row per file with its samples as an array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import dbfs, ratio, rounded
from .speech import tone


METRICS = (
    "sample_rate", "channels", "sample_count", "duration_seconds", "peak_dbfs", "rms_dbfs", "silence_ratio", "leading_silence_seconds",
    "trailing_silence_seconds", "clipped_samples", "clipped_ratio",
)

#: Samples of spoken segments that a task holds before it passes them on.
HELD = 1 << 19


def duration(samples: Column, rate: Column) -> Column:
    """Seconds, 3 digits; 0 where the rate is not positive."""
    return F.when(rate > 0, rounded(samples / rate, 3)).otherwise(0.0)


def mono(samples: Column, channels: Column) -> Column:
    """Interleaved channels as their mean; one channel stays as it is."""
    frames = F.sequence(F.lit(0), F.greatest(F.floor(F.size(samples) / channels).cast("int") - 1, F.lit(0)))
    mean = F.transform(
        frames,
        lambda i: F.aggregate(F.slice(samples, (i * channels + 1).cast("int"), channels), F.lit(0.0), lambda a, x: a + x.cast("double")) / channels,
    )
    return F.when((channels <= 1) | (F.size(samples) == 0), samples.cast("array<double>")).otherwise(mean)


def frames(samples: Column, channels: Column) -> Column:
    """Number of values that mono gives, without making them."""
    n = F.size(samples)
    return F.when((channels <= 1) | (n == 0), n).otherwise(F.greatest(F.floor(n / channels).cast("int"), F.lit(1)))


def signal_metrics(audio: DataFrame, clip: float = C.CLIP_LEVEL, silence: float = C.SILENCE_LEVEL) -> DataFrame:
    """Add peak, level, clipping and silence of column samples (array), with column sample_rate.

    Where there is a column channels, samples of more than one are interleaved
    and are measured as their mean, frame by frame. An empty array has peak and
    level null, silence ratio 1 and no boundaries.
    """
    one = mono(F.col("samples"), F.col("channels")) if "channels" in audio.columns else F.col("samples")
    out = audio.withColumn("_one", one)
    out = out.withColumn("_abs", F.transform("_one", lambda x: F.abs(x.cast("double")))).drop("_one")
    # From the samples as they are, so that lengths alone read no sample.
    n = (frames(F.col("samples"), F.col("channels")) if "channels" in audio.columns else F.size("samples")).cast("long")
    square = F.aggregate("_abs", F.lit(0.0), lambda a, x: a + x * x)
    clipped = F.size(F.filter("_abs", lambda x: x >= clip)).cast("long")
    quiet = F.size(F.filter("_abs", lambda x: x <= silence))
    loud = F.filter(F.transform("_abs", lambda x, i: F.when(x > silence, i)), lambda i: i.isNotNull())
    out = out.withColumn("_loud", F.struct(F.array_min(loud).alias("first"), F.array_max(loud).alias("last")))
    lead = F.coalesce(F.col("_loud.first"), n)
    trail = F.coalesce(n - F.col("_loud.last") - 1, n)
    return out.withColumns(
        {
            "sample_count": n,
            "duration_seconds": duration(n, F.col("sample_rate")),
            "peak_dbfs": dbfs(F.coalesce(F.array_max("_abs"), F.lit(0.0))),
            "rms_dbfs": dbfs(F.sqrt(square / F.greatest(n, F.lit(1)))),
            "silence_ratio": F.when(n > 0, ratio(quiet, n)).otherwise(1.0),
            "leading_silence_seconds": duration(lead, F.col("sample_rate")),
            "trailing_silence_seconds": duration(trail, F.col("sample_rate")),
            "clipped_samples": clipped,
            "clipped_ratio": ratio(clipped, n),
        }
    ).drop("_abs", "_loud")


def is_silent() -> Column:
    """True for audio without any sound: empty, or with a range of less than 0.001."""
    spread = F.array_max("samples") - F.array_min("samples")
    return F.coalesce(spread < 0.001, F.lit(True))


def qc_rollup(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of metrics, of which a row with a non-null column error is a file that could not be read."""
    ok = F.col("error").isNull() if "error" in metrics.columns else F.lit(True)
    when = lambda c: F.when(ok, c)
    return metrics.groupBy(*(by or [])).agg(
        F.count("*").alias("file_count"),
        F.count_if(ok).alias("analyzed_file_count"),
        F.count_if(~ok).alias("failed_file_count"),
        rounded(F.coalesce(F.sum(when(F.col("duration_seconds"))), F.lit(0.0)), 3).alias("total_duration_seconds"),
        rounded(F.avg(when(F.col("rms_dbfs"))), 3).alias("mean_rms_dbfs"),
        rounded(F.avg(when(F.col("peak_dbfs"))), 3).alias("mean_peak_dbfs"),
        F.count_if(ok & (F.col("silence_ratio") > C.HIGH_SILENCE)).alias("high_silence_file_count"),
        F.count_if(ok & (F.col("clipped_ratio") > 0)).alias("clipped_file_count"),
    )


def qc_summary(metrics: DataFrame) -> DataFrame:
    """One nested row: qc_rollup with files (by name) and failed_files, for folders of bounded size."""
    failed = F.col("error").isNotNull() if "error" in metrics.columns else F.lit(False)
    named = F.struct("file", *[c for c in METRICS if c in metrics.columns])
    lists = metrics.agg(
        F.sort_array(F.collect_list(F.when(~failed, named))).alias("files"),
        F.sort_array(F.collect_list(F.when(failed, F.struct("file", F.col("error") if "error" in metrics.columns else F.lit(None))))).alias("failed_files"),
    )
    return qc_rollup(metrics).crossJoin(lists).withColumn("generated_at", F.current_timestamp())  # one row each


def timeline(chapters: DataFrame, book: str = "book", order: str = "idx") -> DataFrame:
    """Add start_ms and end_ms to chapters with duration_seconds: each starts where the one before ends."""
    ms = F.floor(F.col("duration_seconds") * 1000).cast("long")
    running = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = chapters.withColumn("_ms", ms).withColumn("end_ms", F.sum("_ms").over(running))
    return out.withColumn("start_ms", F.col("end_ms") - F.col("_ms")).drop("_ms")


def concat_samples(segments: DataFrame, by: str, order: str = "pos") -> DataFrame:
    """by, sample_rate (of the first segment) and samples of all segments in order; segments without audio are skipped."""
    rows = segments.filter(F.col("samples").isNotNull())
    ordered = F.sort_array(F.collect_list(F.struct(order, "samples")))
    return rows.groupBy(by).agg(
        F.min_by("sample_rate", order).alias("sample_rate"), F.flatten(F.transform(ordered, lambda x: x["samples"])).alias("samples")
    )


def resample(samples: np.ndarray, length: int) -> np.ndarray:
    """Samples at another rate by their Fourier coefficients."""
    if not len(samples) or length <= 0 or length == len(samples):
        return samples[: max(length, 0)]
    spectrum = np.fft.rfft(samples)
    low = min(length, len(samples))
    kept = np.zeros(length // 2 + 1, complex)
    kept[: low // 2 + 1] = spectrum[: low // 2 + 1]
    if low % 2 == 0:
        kept[low // 2] *= 0.5 if length > len(samples) else 2.0 if length < len(samples) else 1.0
    return np.fft.irfft(kept, length) * (length / len(samples))


def assemble(segments: DataFrame, by: str, order: str = "pos") -> DataFrame:
    """concat_samples with every segment brought to its group's first rate."""
    first = segments.filter(F.col("samples").isNotNull()).groupBy(by).agg(F.min_by("sample_rate", order).alias("_rate"))

    @F.pandas_udf("array<double>")
    def to_rate(samples: pd.Series, rate: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([resample(np.asarray(s, float), int(len(s) * w / r)) for s, r, w in zip(samples, rate, wanted, strict=True)])

    rows = segments.filter(F.col("samples").isNotNull()).join(first, by)
    same = F.when(F.col("sample_rate") == F.col("_rate"), F.col("samples").cast("array<double>"))
    rows = rows.withColumn("samples", F.coalesce(same, to_rate(F.col("samples").cast("array<double>"), "sample_rate", "_rate")))
    return concat_samples(rows.withColumn("sample_rate", F.col("_rate")).drop("_rate"), by, order)


def synthesize(segments: DataFrame, speak: Callable[[str], np.ndarray] = tone, rate: int = 8000, calls: int | None = None) -> DataFrame:
    """Add samples and sample_rate to segments by a speech function, which runs in calls partitions at a time at most.

    speak gives the samples of a text, or None where there is no audio; see
    speech.retrying for calls that fail. A client should be made inside it, once
    per process. A task passes its audio on every HELD samples, however many
    segments it has.
    """
    rows = segments.repartition(calls) if calls else segments
    schema = f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, samples array<float>, sample_rate int"

    def spoken(rows: pa.RecordBatch, audio: list[np.ndarray | None]) -> pa.RecordBatch:
        ends = np.cumsum([0, *(0 if s is None else len(s) for s in audio)], dtype=np.int32)
        # A null offset makes a null list.
        offsets = pa.array(ends, mask=np.array([*(s is None for s in audio), False]))
        values = np.concatenate([np.empty(0, np.float32), *(s for s in audio if s is not None)])
        samples = pa.ListArray.from_arrays(offsets, pa.array(values))
        names, columns = [*rows.schema.names, "samples", "sample_rate"], [*rows.columns, samples, pa.array(np.full(rows.num_rows, rate, np.int32))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, held = [], 0
            for i, text in enumerate(b.column("segment"), 1):
                done.append(None if (s := speak(text.as_py())) is None else np.asarray(s, np.float32))
                held += 0 if s is None else len(s)
                if held >= HELD or i == b.num_rows:
                    yield spoken(b.slice(i - len(done), len(done)), done)
                    done, held = [], 0

    return rows.mapInArrow(run, schema)
