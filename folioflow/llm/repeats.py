"""Removal of every passage of WINDOW bytes that also starts elsewhere, in the same text or another.

Sorting all suffixes of a corpus in one structure can't be spread, so it is cut into
pieces that can't lose a repeat. Each window has an anchor, the least of its grams by
hash (the first of equal ones); equal windows have equal anchors at the same place,
so all windows that begin around an anchor are compared with those of equal anchors
alone. A piece is the text of a run of windows with one anchor: each window starts in
exactly one piece, and pieces of an anchor are aligned at it. Pieces that are equal are
repeated as a whole and stand for each other; anchors whose pieces differ are sorted
column by column (suffixes.Segments), whole groups of pieces in batches of bounded
size. A group of more than CROWD different pieces is counted by window hashes instead,
which needs no task to hold it.

Defined results: a null text is empty; windows never cross texts; texts shorter than
WINDOW keep everything; a text that occurs more than once goes as a whole; ids may be
null or repeat, each row has its result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, small_side, work_dir
from .shingles import mix
from .suffixes import repeated_starts
from .tasks import released, reuse

WINDOW, GRAM = 200, 50
#: Grams of a window.
_SPAN = WINDOW - GRAM + 1
#: Windows whose anchors are found at once; their places fit into the low bits of a key.
_CHUNK, _PLACE_BITS = 1 << 17, 20
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Different pieces of an anchor up to which they are sorted together, and bytes of pieces that are sorted at a time.
CROWD, BATCH_BYTES = 2048, 1 << 20
#: Rows of a batch that a task emits.
_ROWS = 20_000


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2^64 and of its inverse."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        made = []
        for factor in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, factor, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        _POWERS[base] = (made[0], made[1])
    up, down = _POWERS[base]
    return up[:n], down[:n]


def rolling(data: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """A scattered 64-bit hash of every width bytes of data."""
    up, down = _powers(base, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: len(data) - width + 1])


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every width keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, its place, first window, last window) of the runs of windows with the same anchor, in order."""
    hashes, places, firsts = [], [], []
    total = len(data) - WINDOW + 1
    for a in range(0, total, _CHUNK):
        b = min(a + _CHUNK, total)
        grams = rolling(data[a : b + WINDOW - 1], GRAM)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        least = _window_least(grams & ~low | np.arange(len(grams), dtype=np.uint64), _SPAN)
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        hashes.append(grams[place[first]])
        places.append(place[first] + a)
        firsts.append(first + a)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    h, place, first = map(np.concatenate, (hashes, places, firsts))
    new = np.diff(place, prepend=-1) != 0  # a run goes on over the border of chunks
    h, place, first = h[new], place[new], first[new]
    return h, place, first, np.append(first[1:], total) - 1


#: shape is a piece's size and, in the low byte, where its anchor is.
_FOUND = "t binary, h long, p long, start int, stop int, shape int, again boolean"


def _find_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece: text, anchor, hash of the piece's bytes, where it starts and ends, its shape.

    Equal pieces that follow each other, as in a run of one character, are one row
    from the first's start to the last's end, repeated (again) by itself.
    """
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
    names = [x.split()[0] for x in _FOUND.split(", ")]
    reuse()
    for batch in batches:
        for t, text in zip(batch["t"], batch["text"], strict=True):
            text = text.as_buffer()
            t = t.as_py()
            h, place, first, last = anchors(np.frombuffer(text, np.uint8))
            view = memoryview(text)
            for a in range(0, len(h), _ROWS):
                b = min(a + _ROWS, len(h))
                size = last[a:b] - first[a:b] + WINDOW
                cuts = zip(first[a:b].tolist(), (first[a:b] + size).tolist(), strict=True)
                p = np.frombuffer(b"".join(hashlib.blake2b(view[i:j], digest_size=8).digest() for i, j in cuts), np.int64)
                same = np.zeros(b - a, bool)
                same[1:] = (p[1:] == p[:-1]) & (h[a + 1 : b] == h[a : b - 1])
                heads = np.flatnonzero(~same)
                ends = np.append(heads[1:], b - a) - 1
                columns = (
                    [t] * len(heads), h[a:b][heads].view(np.int64), p[heads], first[a:b][heads], last[a:b][ends] + WINDOW,
                    (size << 8 | place[a:b] - first[a:b])[heads], ends > heads,
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _occurrence() -> Column:
    """A number that tells the start of one piece from any other."""
    return F.xxhash64("t", "start")


def _spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of bytes that windows from starts, which are sorted, cover."""
    new = np.diff(starts, prepend=-WINDOW - 1) > WINDOW
    return starts[new], np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1:])[: int(new.sum())] + WINDOW


_MARK = "t binary, start int, stop int"


def _marks(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    t, start, stop = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"t": pa.array(t, pa.binary()), "start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32())})


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What repeats of the pieces that are not repeated as a whole; rows come sorted by anchor."""

    def sorted_batch(held: dict[tuple[bytes, int], dict]) -> Iterator[pa.RecordBatch]:
        out = []
        rows = list(held.values())
        number = {h: k for k, h in enumerate(dict.fromkeys(r["h"] for r in rows))}
        found = repeated_starts([r["piece"] for r in rows], [r["lead"] for r in rows], [number[r["h"]] for r in rows], WINDOW)
        for r, at in zip(rows, found, strict=True):
            if len(at) and not r["again"]:
                out += [(r["t"], int(a) + r["start"], int(b) + r["start"]) for a, b in zip(*_spans(at), strict=True)]
        if out:
            yield _marks(out)

    reuse()
    held: dict[tuple[bytes, int], dict] = {}
    size, before = 0, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["h"] != before and size >= BATCH_BYTES:
                yield from sorted_batch(held)
                held, size = {}, 0
            before = r["h"]
            if (r["t"], r["start"]) not in held:
                held[r["t"], r["start"]] = r
                size += len(r["piece"])
    if held:
        yield from sorted_batch(held)


_PIECE = "t binary, h long, start int, lead int, piece binary, again boolean, pieces long"


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in zip(batch["t"], batch["text"], batch["members"], strict=True):
            t, text = r[0].as_py(), r[1].as_buffer()
            for m in r[2].as_py():
                rows.append(m | {"t": t, "lead": m["shape"] & 255, "piece": text[m["start"] : m["start"] + (m["shape"] >> 8)].to_pybytes()})
                if len(rows) == _ROWS:
                    yield _piece_rows(rows)
                    rows = []
        if rows:
            yield _piece_rows(rows)


def _piece_rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"t": pa.binary(), "h": pa.int64(), "start": pa.int32(), "lead": pa.int32(), "piece": pa.binary(), "again": pa.bool_(), "pieces": pa.int64()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], k) for c, k in kinds.items()})


_WINDOWS = "w long, v long, t binary, start int, again boolean"


def _hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every window of a piece."""
    for batch in batches:
        for r in batch.to_pylist():
            data = np.frombuffer(r["piece"], np.uint8)
            w, v = rolling(data, WINDOW), rolling(data, WINDOW, _BASE ^ 0xFFFF0)
            n = len(w)
            columns = (w.view(np.int64), v.view(np.int64), pa.array([r["t"]] * n, pa.binary()), np.arange(n, dtype=np.int32) + np.int32(r["start"]), [r["again"]] * n)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["w", "v", "t", "start", "again"])


def _crowd_marks(pieces: DataFrame, folder: str) -> DataFrame:
    """Repeated windows of the pieces of crowded anchors, by counting hashes."""
    windows = keep(pieces.mapInArrow(released(_hash_windows), _WINDOWS), f"{folder}/windows")
    counted = windows.groupBy("w", "v").agg(F.min(_occurrence()).alias("least"), F.max(_occurrence()).alias("most"))
    repeated = counted.filter("least <> most").select("w", "v")
    return windows.filter("NOT again").join(repeated, ["w", "v"], "left_semi").select("t", "start", (F.col("start") + WINDOW).alias("stop"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text, marks in zip(batch["doc_id"], batch["text"], batch["marks"], strict=True):
            text = memoryview(text.as_buffer())
            start, stop = (marks.values.field(k).to_numpy() for k in ("start", "stop"))
            turn = np.argsort(start, kind="stable")
            start, reach = start[turn], np.maximum.accumulate(stop[turn])
            new = np.append(True, start[1:] > reach[:-1])
            first, last = start[new], reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
            kept, at = hashlib.sha256(), 0
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            rows.append((i.as_py(), len(text), int((last - first).sum()), len(first), kept.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (batch["doc_id"].type, pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def repeated_spans(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(start, stop) of repeated passages as rows t, start, stop, which may overlap, and the t of whole texts that repeat.

    docs has doc_id and text; t is the head of the text's SHA-256. Texts that occur more than once have no spans of their own.
    """
    texts = _texts(docs)
    copies = texts.groupBy("t").agg(F.count("*").alias("rows"), F.min("doc_id").alias("doc_id"))
    copies = keep(copies, f"{folder}/texts")
    repeated_texts = keep(copies.filter("rows > 1").select("t"), f"{folder}/copies")

    found = keep(texts.select("t", F.col("text").cast("binary").alias("text")).mapInArrow(released(_find_pieces), _FOUND), f"{folder}/found")
    least = found.groupBy("h", "p").agg(F.min(_occurrence()).alias("least"), F.max(_occurrence()).alias("most"), F.max("again").alias("again"))
    least = least.select("h", "p", "least", (F.col("again") | (F.col("least") != F.col("most"))).alias("again"))
    least = keep(least, f"{folder}/pieces", tidy=True)
    mixed = least.groupBy("h").agg(F.count("*").alias("pieces"), F.min("again").alias("settled")).filter("pieces > 1 AND NOT settled")
    mixed = keep(mixed.drop("settled"), f"{folder}/mixed", tidy=True)
    wanted = keep(least.join(small_side(mixed), "h", "left").filter("again OR pieces IS NOT NULL"), f"{folder}/wanted", tidy=True)
    hits = found.drop("again").join(small_side(wanted), ["h", "p"])
    hits = hits.withColumn("member", F.col("pieces").isNotNull() & (F.col("least") == _occurrence())).filter("again OR member")
    hits = keep(hits.drop("p", "least"), f"{folder}/hits", tidy=True)

    # Texts of one member of each piece, each from one row of its text.
    members = hits.filter("member").groupBy("t").agg(F.collect_set(F.struct("h", "start", "shape", "again", "pieces")).alias("members"))
    members = members.join(copies.select(F.col("t"), F.col("doc_id").alias("_from")), "t")
    here = F.col("doc_id").eqNullSafe(F.col("_from")) & (F.col("texts.t") == F.col("members.t"))
    cut = texts.alias("texts").join(members.alias("members"), here).select("texts.t", F.col("text").cast("binary").alias("text"), "members")
    pieces = keep(cut.mapInArrow(released(_cut_pieces), _PIECE), f"{folder}/cut", tidy=True)
    by_anchor = pieces.filter(F.col("pieces") <= CROWD).repartition("h").sortWithinPartitions("h")
    marks = hits.filter("again").select("t", "start", "stop")
    marks = marks.union(by_anchor.select("t", "h", "start", "lead", "piece", "again").mapInArrow(released(_sort_groups), _MARK))
    crowded = pieces.filter(F.col("pieces") > CROWD)
    if not crowded.isEmpty():
        marks = marks.union(_crowd_marks(crowded, folder))
    return keep(marks.join(small_side(repeated_texts), "t", "left_anti"), f"{folder}/marks", tidy=True), repeated_texts


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter(F.octet_length("text") >= WINDOW).select("doc_id", _digest("text").alias("t"), "text")


def _digest(text: str) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 1, 16)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, text)."""
    folder = work_dir(docs.sparkSession, "repeats")
    docs = docs.select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", _digest("text").alias("t"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    narrow = keep(narrow, f"{folder}/narrow")
    marks, copies = repeated_spans(docs, folder)
    marked = keep(marks.groupBy("t").agg(F.collect_list(F.struct("start", "stop")).alias("marks")), f"{folder}/marked")
    gone = small_side(copies.withColumn("gone", F.lit(True)))
    whole = narrow.join(small_side(marked.select("t")), "t", "left_anti").join(gone, "t", "left")
    whole = whole.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("gone"), F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(F.col("gone"), 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(F.col("gone"), hashlib.sha256().hexdigest()).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    parts = _texts(docs).join(marked, "t").select("doc_id", F.col("text").cast("binary").alias("text"), "marks")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return whole.union(parts.mapInArrow(released(_remove), schema))
