"""Audio of any length as rows of bounded size.

A signal is rows of a key, a running number and samples. Offsets come from prefix sums
over the rows' lengths, so pieces of any sizes are cut anew into chunks of one size
without a row that holds the whole; another rate is reached chunk by chunk, with
windows that reach over the borders.

Rows without samples are skipped and empty ones take no place. A key's rate is that
of its first row. Keys may be null; several keys of a row are columns of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.order import running_sums
from ..functions.text import dbfs, ratio
from ..work import kept, work_folder
from .audio import duration, mono, resample

#: Samples of a chunk, and of the margin on either side that a window reaches into.
CHUNK, MARGIN = 1 << 16, 1 << 10


def _same(df: DataFrame, other: DataFrame, by: list[str]) -> Column:
    """Equal keys, null ones among them; other's columns have names with a leading underscore."""
    out = F.lit(True)
    for c in by:
        out = out & df[c].eqNullSafe(other[f"_{c}"])
    return out


def _joined(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of other, which has a row per key."""
    named = other.withColumnsRenamed({c: f"_{c}" for c in by})
    return df.join(named, _same(df, named, by)).drop(*[f"_{c}" for c in by])


def chunked(rows: DataFrame, by: list[str], order: list[str], size: int = CHUNK) -> DataFrame:
    """by, chunk (from 0), chunks, total, start and samples of each key's samples in order, size to a chunk.

    The last chunk takes the rest as well, so none but a whole signal is shorter than
    size; total is the key's number of samples and start a chunk's first one.
    """
    spark = rows.sparkSession
    folder = work_folder(spark, "chunks")
    pieces = rows.filter(F.size("samples") > 0).withColumn("samples", F.col("samples").cast("array<double>"))
    pieces = kept(pieces.select(*by, *order, "samples", F.monotonically_increasing_id().alias("_id")), f"{folder}/pieces")
    # Only narrow rows are ordered; samples are joined to them by number.
    narrow = pieces.select(*by, *order, "_id", F.size("samples").cast("long").alias("_n"))
    placed = running_sums(narrow, by, [F.col(c) for c in order], F.col("_n"), "_start")
    totals = narrow.groupBy(*by).agg(F.sum("_n").alias("total"))
    placed = _joined(placed, totals, by).select("_id", "_start", "total")
    out = pieces.drop(*order).join(placed, "_id")
    last = F.greatest(F.floor(F.col("total") / size).cast("long") - 1, F.lit(0).cast("long"))
    first = F.least(F.floor(F.col("_start") / size).cast("long"), last)
    final = F.least(F.floor((F.col("_start") + F.size("samples") - 1) / size).cast("long"), last)
    out = out.withColumns({"_last": last, "_chunks": F.sequence(first, final)}).withColumn("chunk", F.explode("_chunks"))
    begin = F.greatest(F.col("chunk") * size, F.col("_start"))
    end = F.when(F.col("chunk") == F.col("_last"), F.col("total")).otherwise((F.col("chunk") + 1) * size)
    count = F.least(end, F.col("_start") + F.size("samples")) - begin
    part = F.slice("samples", (begin - F.col("_start") + 1).cast("int"), count.cast("int"))
    out = out.select(*by, "chunk", (F.col("_last") + 1).alias("chunks"), "total", F.struct(begin.alias("at"), part.alias("samples")).alias("part"))
    parts = F.sort_array(F.collect_list("part"))
    out = out.groupBy(*by, "chunk", "chunks", "total").agg(parts.alias("_parts"))
    samples = F.flatten(F.transform("_parts", lambda x: x["samples"]))
    return out.select(*by, "chunk", "chunks", "total", (F.col("chunk") * size).alias("start"), samples.alias("samples"))


def step(rate: int, wanted: int, size: int = CHUNK) -> int:
    """The chunk size nearest above size at which chunks of both rates begin at the same times."""
    unit = rate // gcd(rate, wanted)
    return -(-size // unit) * unit


def _window(core: np.ndarray, left: np.ndarray, right: np.ndarray, rate: int, wanted: int, count: int) -> np.ndarray:
    """count samples at rate wanted of core, whose neighbours left and right fade out."""
    unit = rate // gcd(rate, wanted)
    margin = len(left)
    fade = 0.5 - 0.5 * np.cos(np.pi * (np.arange(margin) + 0.5) / margin)
    pad = -(len(core) + len(right)) % unit
    whole = np.concatenate([left * fade, core, right * fade[::-1], np.zeros(pad)])
    first = margin * wanted // rate
    return resample(whole, len(whole) * wanted // rate)[first : first + count]


def resampled(chunks: DataFrame, by: list[str], rate: int, wanted: int) -> DataFrame:
    """chunks, cut by chunked with step(rate, wanted) at least MARGIN long, at the rate wanted, with total and start to match.

    A chunk's window holds MARGIN samples of each neighbour, which fade out; the last
    chunk and the first are neighbours, as the Fourier transform of a whole signal
    repeats it. A signal of one chunk is transformed as a whole. Memory follows the
    chunk, not the signal. For sound below nine tenths of the lower rate's half, samples
    differ from those of the whole signal's transform by less than a thousandth of
    the peak, where the transform's length is a whole multiple; else the whole
    transform's time runs off by up to one sample, which this one's does not.
    """
    if rate == wanted:
        return chunks
    unit = rate // gcd(rate, wanted)
    margin = -(-MARGIN // unit) * unit
    ring = lambda n: F.pmod(F.col("chunk") + n, F.col("chunks"))
    many = F.col("chunks") > 1
    common = [*by, "chunks", "total"]
    core = chunks.select(*common, "chunk", F.lit("core").alias("_kind"), "start", "samples")
    # A margin goes to the neighbour that reaches into it.
    tail, head = F.slice("samples", -margin, margin), F.slice("samples", 1, margin)
    edge = chunks.filter(many).select(
        *common, F.explode(F.array(*[F.struct(ring(n).alias("chunk"), F.lit(k).alias("_kind"), F.lit(None).cast("long").alias("start"), x.alias("samples")) for n, k, x in ((1, "left", tail), (-1, "right", head))])).alias("_edge")
    ).select(*common, "_edge.*")
    kind = lambda k, c: F.any_value(F.when(F.col("_kind") == k, F.col(c)), ignoreNulls=True).alias(f"_{k}" if c == "samples" else c)
    rows = core.unionByName(edge).groupBy(*common, "chunk").agg(kind("core", "start"), kind("core", "samples"), kind("left", "samples"), kind("right", "samples"))

    def bring(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f[["chunk", "chunks", "total", "start", "_core", "_left", "_right"]].itertuples(index=False):
                length, begin = int(r.total * wanted / rate), int(r.start * wanted // rate)
                count = length - begin if r.chunk == r.chunks - 1 else len(r[4]) * wanted // rate
                x = resample(np.asarray(r[4], float), length) if r.chunks == 1 else _window(*(np.asarray(x, float) for x in r[4:]), rate, wanted, count)
                out.append((length, begin, x))
            yield f.drop(columns=["_core", "_left", "_right"]).assign(total=[x[0] for x in out], start=[x[1] for x in out], samples=[x[2] for x in out])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n not in ("_core", "_left", "_right"))
    return rows.mapInPandas(bring, f"{schema}, samples array<double>").select(*by, "chunk", "chunks", "total", "start", "samples")


def assembled(segments: DataFrame, by: str, order: str = "pos", part: str | None = None, size: int = CHUNK) -> DataFrame:
    """by, sample_rate, chunk, chunks, total, start and samples of all segments in order, in chunks.

    segments has by, order, sample_rate and samples; a segment too long for a row is
    several rows numbered by part. Segments at other rates are brought to the rate of
    the key's first segment. What audio.assemble does in one row per key.
    """
    spark = segments.sparkSession
    folder = work_folder(spark, "assembled")
    named = segments.filter("samples IS NOT NULL").withColumn("_part", F.col(part) if part else F.lit(0).cast("long"))
    named = kept(named.select(by, order, "_part", "sample_rate", F.col("samples").cast("array<double>").alias("samples")), f"{folder}/segments")
    first = named.groupBy(by).agg(F.min_by("sample_rate", F.struct(order, "_part")).alias("_rate"))
    rows = _joined(named, first, [by])
    rates = rows.filter("sample_rate <> _rate").select("sample_rate", "_rate").distinct().collect()  # pairs of rates, a handful
    columns = [by, order, "_part", "samples"]
    out = rows.filter("sample_rate = _rate").select(*columns)
    for rate, wanted in rates:
        other = rows.filter((F.col("sample_rate") == rate) & (F.col("_rate") == wanted))
        own = chunked(other, [by, order], ["_part"], step(rate, wanted, size))
        out = out.unionByName(resampled(own, [by, order], rate, wanted).select(by, order, F.col("chunk").alias("_part"), "samples"))
    return _joined(chunked(out, [by], [order, "_part"], size), first, [by]).withColumnRenamed("_rate", "sample_rate")


def chunk_sums(chunks: DataFrame, by: list[str]) -> DataFrame:
    """by, samples (their number), total, first and last of each signal, from its chunks."""
    add = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return chunks.groupBy(*by).agg(
        F.sum(F.size("samples")).cast("long").alias("samples"),
        F.sum(add).alias("total"),
        F.min_by(F.element_at("samples", 1), "chunk").alias("first"),
        F.max_by(F.element_at("samples", -1), "chunk").alias("last"),
    )


def pcm16(samples: np.ndarray) -> bytes:
    return np.clip(np.rint(np.asarray(samples) * 32767), -32768, 32767).astype("<i2").tobytes()


def wav_header(total: int, rate: int) -> bytes:
    """The head of a mono file of total 16-bit samples; one past 4 GB names its sizes in 64 bits."""
    import struct

    size = 2 * total
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16)
    if 36 + size < 1 << 32:
        return struct.pack("<4sI4s", b"RIFF", 36 + size, b"WAVE") + form + struct.pack("<4sI", b"data", size)
    # ds64: size of the file less 8, of the data, samples, and an empty table.
    large = struct.pack("<4sIQQQI", b"ds64", 28, 72 + size, size, total, 0)
    return struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + large + form + struct.pack("<4sI", b"data", 0xFFFFFFFF)


def wav_parts(chunks: DataFrame, name: Column) -> DataFrame:
    """name, part and content (BINARY): the pieces of WAV files, for sinks.write_parts; the first begins with the header of the whole."""

    @F.pandas_udf("binary")
    def encode(chunk: pd.Series, total: pd.Series, rate: pd.Series, samples: pd.Series) -> pd.Series:
        return pd.Series([(wav_header(int(t), int(r)) if k == 0 else b"") + pcm16(s) for k, t, r, s in zip(chunk, total, rate, samples, strict=True)])

    return chunks.select(name.alias("name"), F.col("chunk").alias("part"), encode("chunk", "total", "sample_rate", "samples").alias("content"))


def chunk_metrics(rows: DataFrame, by: list[str], clip: float = C.CLIP_LEVEL, silence: float = C.SILENCE_LEVEL) -> DataFrame:
    """by and audio.METRICS of signals in rows with start (frame), sample_rate, channels and samples: audio.signal_metrics without a row per signal."""
    one = rows.withColumn("_abs", F.transform(mono(F.col("samples"), F.col("channels")), lambda x: F.abs(x)))
    loud = F.filter(F.transform("_abs", lambda x, i: F.when(x > silence, F.col("start") + i)), lambda i: i.isNotNull())
    parts = one.select(
        *by, "sample_rate", "channels", F.size("_abs").cast("long").alias("_n"), F.array_max("_abs").alias("_peak"),
        F.aggregate("_abs", F.lit(0.0), lambda a, x: a + x * x).alias("_square"), F.size(F.filter("_abs", lambda x: x >= clip)).alias("_clipped"),
        F.size(F.filter("_abs", lambda x: x <= silence)).alias("_quiet"), F.array_min(loud).alias("_first"), F.array_max(loud).alias("_last"),
    )
    sums = parts.groupBy(*by).agg(
        F.any_value("sample_rate").alias("sample_rate"), F.any_value("channels").alias("channels"), F.sum("_n").alias("sample_count"), F.max("_peak").alias("_peak"),
        F.sum("_square").alias("_square"), F.sum("_clipped").alias("clipped_samples"), F.sum("_quiet").alias("_quiet"), F.min("_first").alias("_first"), F.max("_last").alias("_last"),
    )
    n, rate = F.col("sample_count"), F.col("sample_rate")
    return sums.select(
        *by,
        "sample_rate",
        "channels",
        "sample_count",
        duration(n, rate).alias("duration_seconds"),
        dbfs(F.coalesce("_peak", F.lit(0.0))).alias("peak_dbfs"),
        dbfs(F.sqrt(F.col("_square") / F.greatest(n, F.lit(1)))).alias("rms_dbfs"),
        F.when(n > 0, ratio(F.col("_quiet"), n)).otherwise(1.0).alias("silence_ratio"),
        duration(F.coalesce("_first", n), rate).alias("leading_silence_seconds"),
        duration(F.coalesce(n - F.col("_last") - 1, n), rate).alias("trailing_silence_seconds"),
        "clipped_samples",
        ratio(F.col("clipped_samples"), n).alias("clipped_ratio"),
    )
