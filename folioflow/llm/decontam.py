"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Every benchmark item gives a 64-bit SimHash of its five-word shingles. A window
of a document that is as long as an item gives one too, and a document that is a
little shorter than an item is one window as a whole. The fingerprints are cut
into blocks; two fingerprints within RADIUS differ by RADIUS // BLOCKS bits at
most in one of the blocks, so looking up the blocks with that many bits changed
finds every item within RADIUS. Candidates are then verified by the exact
weighted Jaccard similarity of the shingles, with their counts as weights.

The documents are read once, however many items there are: a bitmap of the items'
shingles, of bounded size, tells which stretches of a text have so many of them
that a window of similarity THRESHOLD can lie there. Only these stretches go on,
to the blocks of items with which they share a shingle. Each block, with a share
of its stretches, is one task with a Hamming index of its own.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, keep, small_side, work_dir
from .shingles import SHINGLE, shingle_hashes, text_slices, word_hashes
from .tasks import arrays, released

SIMILARITY = 0.75
#: Bits by which the fingerprints of a window and an item may differ. Sets of similarity 3/4 differ by 11 of 64 bits
#: on average with a standard deviation of 3.
RADIUS = 22
#: The least threshold that RADIUS covers: sets of similarity 0.7 differ by 12 bits on average, and one pair in a thousand by more than 22.
LEAST_SIMILARITY = 0.7
#: Blocks of the index; each is searched with RADIUS // BLOCKS bits changed.
BLOCKS = 8
#: Items whose index a task holds, and bytes and number of documents' stretches that it is given at once, about; as many
#: shares of a block as there are shuffle partitions may be smaller than the bytes allow.
BLOCK_ITEMS, BLOCK_BYTES, BLOCK_ROWS = 4096, 1 << 24, 1000
#: Bits of the bitmap of shingles for each of them, and the most in all (16 MB); a fuller bitmap only lets more text through.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Windows that are fingerprinted at once.
WINDOWS = 1 << 9
_CHUNK = 1 << 17
_BITS = np.arange(64, dtype=np.uint64)
_ITEM = "item long, item_id long, width int, size int, shingles binary"
_STRETCH = "row long, doc_id long, text_hash long, width int, start long, whole boolean, shingles binary, hits array<long>"
_FOUND = "row long, doc_id long, text_hash long, item long, item_id long, similarity double, start_word long"


def fingerprints(shingles: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of size shingles."""
    signs = ((shingles[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)])
    return ((sums[size:] - sums[:-size] > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class HammingIndex:
    """Finds all fingerprints within RADIUS of a given one by blocks."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self._prints, self._radius, flips = prints, radius, radius // blocks
        edges = [64 * k // blocks for k in range(blocks + 1)]
        self._blocks = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            values, width = self._cut(prints, low, high).astype(np.int64), high - low
            order = np.argsort(values, kind="stable")
            first = np.searchsorted(values[order], np.arange((1 << width) + 1))
            masks = [sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(width), k)]
            self._blocks.append((low, high, order, first, np.array(masks)))

    @staticmethod
    def _cut(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)

    def near(self, prints: np.ndarray) -> list[np.ndarray]:
        """Numbers of the indexed fingerprints within the radius of each of prints."""
        total, found = len(self._prints), []
        for low, high, order, first, masks in self._blocks:
            cells = (self._cut(prints, low, high).astype(np.int64)[:, None] ^ masks).ravel()
            start, n = first[cells], first[cells + 1] - first[cells]
            ends = np.cumsum(n)
            item = order[np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
            found.append(np.repeat(np.repeat(np.arange(len(prints)), len(masks)), n) * total + item)
        pairs = np.unique(np.concatenate(found))
        at, item = pairs // total, pairs % total
        close = np.bitwise_count(prints[at] ^ self._prints[item]) <= self._radius
        at, item = at[close], item[close]
        return np.split(item, np.searchsorted(at, np.arange(1, len(prints))))


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for row, offsets, data in text_slices(b.column("text")):
            words, rows = word_hashes(offsets, data)
            shingles, bounds = shingle_hashes(words, rows)
            keys, ids = (b.column(c).slice(row, len(offsets) - 1).to_pylist() for c in ("item", "item_id"))
            for k, (i, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if e > i:
                    out.append((keys[k], ids[k], min(int(rows[k + 1] - rows[k]), SHINGLE), e - i, shingles[i:e].tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _ITEM.split(", ")])


def _bitmap(items: DataFrame, shingles: int) -> np.ndarray:
    """Which low bits of hashes some item's shingle has, eight to a byte; bounded by MOST_BITS."""
    bits = min(1 << max(_CHUNK.bit_length() - 1, (BITS_EACH * shingles).bit_length()), MOST_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for b in batches:
            for s in arrays(b.column("shingles"), np.uint64):
                seen[s & np.uint64(bits - 1)] = True
        parts = [(k, seen[k * _CHUNK : (k + 1) * _CHUNK]) for k in range(bits // _CHUNK)]
        parts = [(k, np.packbits(x, bitorder="little").tobytes()) for k, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["chunk", "bits"])

    def add(table: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce(np.stack(arrays(table["bits"], np.uint8)))
        return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([whole.tobytes()], pa.binary())})

    marked = items.select("shingles").mapInArrow(released(mark), "chunk int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in marked.groupBy("chunk").applyInArrow(add, "chunk int, bits binary").collect():
        out[r["chunk"] * _CHUNK // 8 : (r["chunk"] + 1) * _CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _hits(bitmap: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Whether the bitmap has each shingle."""
    low = shingles & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


def stretches(hit: np.ndarray, least: int, most: int, threshold: float) -> list[tuple[int, int]]:
    """Runs of shingles that hold every window, of least to most shingles, that has enough hits to be similar to an item.

    Equal sizes need hits among 2 t / (1 + t) of a window's shingles at least.
    A text of fewer than least shingles is one window.
    """
    total, share = len(hit), 2 * threshold / (1 + threshold)
    least = min(least, total)
    level = np.concatenate([[0.0], np.cumsum(np.where(hit, 1 - share, -share))])
    # The greatest level from each place on falls; the last place at which it is high enough is as far as a window reaches.
    ahead = np.maximum.accumulate(level[::-1])[::-1]
    start = np.flatnonzero(ahead[least:] >= level[: total - least + 1] - 1e-9)
    if not len(start):
        return []
    reach = total - np.searchsorted(ahead[::-1], level[start] - 1e-9)
    reach = np.maximum.accumulate(np.minimum(reach, start + max(most, least)))
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return list(zip(start[first].tolist(), reach[np.append(first[1:] - 1, len(start) - 1)].tolist(), strict=True))


def _short_runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, as a text of just these words would have."""
    rows = np.arange(0, max(len(words) - size + 1, 0))
    flat = words[(rows[:, None] + np.arange(size)).ravel()] if len(rows) else words[:0]
    return shingle_hashes(flat, np.arange(len(rows) + 1) * size)[0]


def _scan(shared, sizes: dict[int, tuple[int, int]], threshold: float):
    """Stretches of documents. sizes: least and most shingles of the items whose shingles have so many words."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap: np.ndarray = shared.value
        for b in batches:
            out: list[tuple] = []
            for row, offsets, data in text_slices(b.column("text")):
                keys = None
                words, rows = word_hashes(offsets, data)
                shingles, bounds = shingle_hashes(words, rows)
                hit = _hits(bitmap, shingles)
                some = np.unique(np.searchsorted(bounds, np.flatnonzero(hit), "right") - 1).tolist() if SHINGLE in sizes else []
                tasks = [(d, SHINGLE, shingles[bounds[d] : bounds[d + 1]], hit[bounds[d] : bounds[d + 1]]) for d in some if rows[d + 1] - rows[d] >= SHINGLE]
                for width in sizes.keys() - {SHINGLE}:
                    for d in range(len(offsets) - 1):
                        short = _short_runs(words[rows[d] : rows[d + 1]], width)
                        tasks.append((d, width, short, _hits(bitmap, short)))
                for d, width, own, own_hit in tasks:
                    if width == SHINGLE:
                        parts = stretches(own_hit, *sizes[width], threshold)
                    else:
                        at = np.flatnonzero(own_hit)
                        parts = [(i, i + 1) for i in at[np.unique(own[at], return_index=True)[1]].tolist()]
                    for i, e in parts:
                        keys = keys or list(zip(*(b.column(c).slice(row, len(offsets) - 1).to_pylist() for c in ("row", "doc_id", "text_hash")), strict=True))
                        tokens = np.unique(own[i:e][own_hit[i:e]]).view(np.int64)
                        out.append((*keys[d], width, i, e - i == len(own), own[i:e].tobytes(), tokens.tolist()))
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _STRETCH.split(", ")])

    return released(run)


class _Items:
    """The index of one block of the benchmark."""

    def __init__(self, table: pa.Table):
        self.keys, self.ids = table["item"].to_pylist(), table["item_id"].to_pylist()
        self.width, sizes = table["width"].to_numpy(), table["size"].to_numpy()
        runs = arrays(table["shingles"], np.uint64)
        self.bags = [Counter(s.tolist()) for s in runs]
        flat, of = np.concatenate(runs), np.repeat(np.arange(len(runs)), sizes)
        order = np.argsort(flat, kind="stable")
        self.shingles, self.of = flat[order], of[order]
        groups = defaultdict(list)
        for i, (n, w) in enumerate(zip(sizes.tolist(), self.width.tolist(), strict=True)):
            groups[n, w].append(i)
        self.groups = {k: (HammingIndex(np.array([fingerprints(runs[i], k[0])[0] for i in v], np.uint64)), np.array(v)) for k, v in groups.items()}
        self.group_of = np.array([list(groups).index((n, w)) for n, w in zip(sizes.tolist(), self.width.tolist(), strict=True)])

    def search(self, shingles: np.ndarray, width: int, whole: bool, threshold: float) -> dict[int, tuple[float, int]]:
        """item -> (similarity, start) of its best window among the runs of shingles, which have width words each."""
        best: dict[int, tuple[float, int]] = {}
        low, high = np.searchsorted(self.shingles, shingles), np.searchsorted(self.shingles, shingles, "right")
        n = high - low
        place = np.repeat(np.arange(len(shingles)), n)
        item = self.of[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pairs = np.unique(self.group_of[item] * np.int64(len(shingles)) + place)
        share = 2 * threshold / (1 + threshold)
        groups = list(self.groups)
        for g in np.unique(pairs // max(len(shingles), 1)).tolist():
            size, words = groups[g]
            if words != width:
                continue
            at = pairs[np.searchsorted(pairs, g * len(shingles)) : np.searchsorted(pairs, (g + 1) * len(shingles))] - g * len(shingles)
            length = min(size, len(shingles))
            # A text that is shorter than an item can be similar enough only as a whole.
            if length < size and (not whole or length < threshold * size):
                continue
            hits = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(shingles)))])
            starts = np.flatnonzero(hits[length:] - hits[:-length] >= share * length - 1e-9)
            index, numbers = self.groups[size, words]
            for start, found in _candidates(index, shingles, starts, length):
                bag = Counter(shingles[start : start + length].tolist())
                for i in numbers[found].tolist():
                    similarity = weighted_jaccard(bag, self.bags[i])
                    if similarity >= threshold and similarity > best.get(i, (0.0, 0))[0]:
                        best[i] = (similarity, start)
        return best


def _candidates(index: HammingIndex, shingles: np.ndarray, starts: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, items within the radius) of the windows; runs of windows that are close together share their sums."""
    cuts = np.flatnonzero(np.diff(starts) > 8) + 1 if len(starts) else []
    for run in np.split(starts, cuts) if len(starts) else ():
        for k in range(0, len(run), WINDOWS):
            some = run[k : k + WINDOWS]
            prints = fingerprints(shingles[some[0] : some[-1] + length], length)[some - some[0]]
            for start, found in zip(some.tolist(), index.near(prints), strict=True):
                if len(found):
                    yield start, found


def _verifier(threshold: float):
    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            items = _Items(right)
            rows = zip(*(left[c].to_pylist() for c in ("row", "doc_id", "text_hash", "width", "start", "whole")), arrays(left["shingles"], np.uint64), strict=True)
            for row, doc, text_hash, width, start, whole, shingles in rows:
                for i, (similarity, at) in items.search(shingles, width, whole, threshold).items():
                    out.append((row, doc, text_hash, items.keys[i], items.ids[i], similarity, start + at))
        names = [x.split()[0] for x in _FOUND.split(", ")]
        kinds = [pa.float64() if n == "similarity" else pa.int64() for n in names]
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return verify


def _leaks(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """row (a number of each row of docs), doc_id, text_hash, item, item_id, similarity, start_word: the best window of each row and item."""
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession, "leaks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not LEAST_SIMILARITY <= threshold <= 1:
        raise ValueError(f"the threshold must be from {LEAST_SIMILARITY} to 1")
    texts = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    texts = texts.select(F.xxhash64(F.coalesce("item_id", F.lit(0)), F.col("item_id").isNull(), "text").alias("item"), "item_id", "text")
    items = keep(texts.mapInArrow(released(_item_rows), _ITEM), f"{folder}/items")
    # One row for each number of words that an item's shingles have: five at most.
    widths = items.groupBy("width").agg(F.min("size"), F.max("size"), F.sum("size"), F.count("*")).collect()
    bitmap = spark.sparkContext.broadcast(_bitmap(items, sum(r[3] for r in widths)))
    wanted = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"),
    )
    scan = wanted.mapInArrow(_scan(bitmap, {r[0]: (r[1], r[2]) for r in widths}, threshold), _STRETCH)
    found = keep(scan.withColumn("stretch", F.monotonically_increasing_id()), f"{folder}/stretches")
    bitmap.destroy()

    blocks = max(1, -(-sum(r[4] for r in widths) // BLOCK_ITEMS))
    placed = items.withColumn("block", F.pmod(F.col("item"), F.lit(blocks)).cast("int"))
    if blocks == 1:
        routed = found.drop("hits").withColumn("block", F.lit(0))
    else:
        # 64-bit tokens as the documents' side has them; each block has a token once.
        tokens = placed.mapInArrow(released(_block_tokens), "token long, block int").distinct()
        pairs = found.select("stretch", F.explode("hits").alias("token")).join(tokens, "token").select("stretch", "block").distinct()
        routed = keep(found.drop("hits").join(pairs, "stretch"), f"{folder}/routed")
    shares = F.greatest(F.ceil(F.sum(F.length("shingles") + 64) / BLOCK_BYTES), F.least(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(parts)))
    sizes = routed.groupBy("block").agg(shares.cast("int").alias("shares"))
    sizes = small_side(keep(sizes, f"{folder}/sizes"))
    left = routed.join(sizes, "block").withColumn("share", F.pmod(F.xxhash64("stretch"), F.col("shares")).cast("int")).drop("shares")
    right = placed.join(sizes, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    both = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(_verifier(threshold), _FOUND)
    best = both.groupBy("row", "doc_id", "text_hash", "item", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("start"))).alias("best"))
    out = best.select("row", "doc_id", "text_hash", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.start")).alias("start_word"))
    out = keep(out, f"{folder}-found")
    drop_folder(spark, folder)
    return out


def _block_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        runs = arrays(b.column("shingles"), np.uint64)
        tokens = np.concatenate([np.zeros(0, np.uint64), *runs]).view(np.int64)
        block = np.repeat(b.column("block").to_numpy(), [len(x) for x in runs])
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(block, pa.int32())], ["token", "block"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document and benchmark item of which it has a window: doc_id, item_id, similarity, start_word.

    similarity: the best of the document's windows with as many words as the
    item, or of the whole document if it has fewer, by weighted Jaccard of
    five-word shingles, threshold or more;
    start_word: the word, from 0, at which the first such window starts. Items
    of fewer than five words are one shingle. Null or empty texts, on either
    side, match nothing; a repeated row gives its rows again; a repeated item_id
    gives a row for each of its different texts, and null is an item_id like
    others; empty tables give no rows. Other columns, whatever their names, are
    left out. A threshold below LEAST_SIMILARITY is an error, as the fingerprints'
    radius would lose windows.
    """
    return _leaks(docs, benchmark, threshold).select("doc_id", "item_id", "similarity", "start_word")


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """docs without the rows that have a benchmark item, also where their doc_id is null or repeats; see find_leaks.

    Columns stay as they are, whatever their names.
    """
    leaks = _leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    leaks = keep(leaks, work_dir(docs.sparkSession, "leaks"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    return rows.join(small_side(leaks), same, "left_anti").select("_row.*")
