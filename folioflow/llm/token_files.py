"""Token-ID output: Arrow stream-file format with fixed-size-list batches.

Documents are range-sorted, by doc_id unless told otherwise, and each partition packs its token stream
into sequences of one length, batch after batch, in an Arrow IPC file. A batch's
ids and masks are fixed-size lists without nulls, so sequence k of a file is one
slice of a memory map, found by arithmetic and read without copying. A second
file beside it says where each document starts.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, work_dir
from .files import NewFile, make_folder, open_file
from .shingles import IS_SPACE, mix, text_slices
from .tasks import released

#: Tokens in a sequence, and sequences in a batch.
SEQUENCE, BATCH = 2048, 256
END_ID = 2
#: Columns that documents are sorted by unless the caller names others.
ORDER = ("doc_id", "text")
#: Different pieces of text, and ids of them, that a worker remembers, at most (some 50 MB); then it keeps those that came
#: again since the last time.
MOST_PIECES, MOST_IDS = 1 << 20, 1 << 22
#: Bytes of text that are encoded at once; a longer text is cut into such parts.
SLICE_BYTES = 1 << 20
DOC_SCHEMA = pa.schema([pa.field("doc_id", pa.int64()), pa.field("start", pa.int64()), pa.field("n_tokens", pa.int64())])
MANIFEST = "part int, tokens_file string, docs_file string, documents long, tokens long"

#: First bytes of the characters that Unicode counts as white space beyond ASCII.
_WIDE_SPACE = [0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380]
#: Bytes that may be white space to the tokenizer or to Python, beyond IS_SPACE.
_SEPARATORS = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F])
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], dtype=np.uint64)


def _wide_spaces(data: np.ndarray) -> np.ndarray:
    """Whether a character that may be white space beyond ASCII starts at each byte."""
    wide = np.zeros(len(data), bool)
    for code in _WIDE_SPACE:
        wide[:-1] |= (data[:-1] == code >> 8) & (data[1:] == code & 255)
    return wide


def piece_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Places at which texts can be cut without changing their byte-level BPE ids.

    The tokenizer's pattern takes a single space with the run of other
    characters that follows it, and a line feed between two such runs by
    itself; so a text may be cut before a space that anything but white space
    follows, and on either side of a line feed without white space beside it.
    """
    space, wide = IS_SPACE[data], _wide_spaces(data)
    cut = np.zeros(len(data) + 1, bool)
    blank = space | wide
    cut[:-2] |= (data[:-1] == 32) & ~blank[1:]
    if len(data) > 2:
        # the character before must not be white space either, and be ASCII to be sure of that
        lone = (data[1:-1] == 10) & ~space[:-2] & (data[:-2] < 128) & ~blank[2:]
        cut[1:-2] |= lone
        cut[2:-1] |= lone
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


def text_parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts of about SLICE_BYTES, which end where it may be cut; without such places, in one."""
    start = 0
    while len(data) - start > 2 * SLICE_BYTES:
        size, cuts = SLICE_BYTES, np.zeros(0, np.int64)
        while not len(cuts) and size < len(data) - start:
            size *= 2
            # The first and last places of a window are cut without a look at what is beside them.
            cuts = piece_starts(np.zeros(1, np.int64), data[start : start + size])
            cuts = cuts[(cuts >= size // 2) & (cuts < size - 4)]
        if not len(cuts):
            break
        yield data[start : start + int(cuts[0])]
        start += int(cuts[0])
    yield data[start:]


def can_be_cut(vocabulary: dict) -> bool:
    """Whether piece_starts holds for a tokenizer: byte-level BPE with the usual pattern, nothing before it, no token over white space."""
    before = vocabulary.get("pre_tokenizer") or {}
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    apart = all(not x["lstrip"] and not x["rstrip"] and not any(c.isspace() for c in x["content"]) for x in vocabulary.get("added_tokens", ()))
    return bool(level and apart and not vocabulary.get("normalizer") and vocabulary["model"]["type"] == "BPE")


def _piece_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, factor: np.uint64) -> np.ndarray:
    """A 64-bit hash of each piece: a polynomial in its bytes."""
    powers = np.ones(int(sizes.max()), np.uint64)
    np.cumprod(np.full(len(powers) - 1, factor), out=powers[1:])
    terms = powers[np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)]
    terms *= data + np.uint64(1)
    return mix(np.add.reduceat(terms, starts))


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library.

    Texts are cut into pieces at places where that changes nothing; the library
    encodes each different piece once, and the ids of a text are those of its
    pieces. Two 64-bit hashes stand for a piece. With a tokenizer of which such
    places are not known, the library encodes each text as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.largest_id = self._tokenizer.get_vocab_size(with_added_tokens=True) - 1
        with open(path, encoding="utf-8") as file:
            self.cuts = can_be_cut(json.load(file))
        self._line_feed = self._ids(["\n"])[0][0] if self.cuts else None
        self.forget()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        """Drop all remembered pieces."""
        self._keys = np.zeros((0, 2), np.uint64)
        self._starts, self._lengths, self._again = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
        self._pool, self._used = np.zeros(1 << 16, np.uint32), 0

    def _make_room(self) -> None:
        """Keep the pieces that came again since the last time; none if they are more than half of what there is room for."""
        keep = self._again
        lengths, starts = self._lengths[keep], self._starts[keep]
        ends = np.cumsum(lengths, dtype=np.int64)
        if not len(ends) or len(ends) > MOST_PIECES // 2 or ends[-1] > MOST_IDS // 2:
            self.forget()
            return
        self._pool = self._pool[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])]
        self._keys, self._lengths, self._starts = self._keys[keep], lengths, (ends - lengths).astype(np.int32)
        self._again, self._used = np.zeros(len(ends), bool), int(ends[-1])

    def _learn(self, keys: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> None:
        """Encode the pieces of data that bounds part and whose keys are in order.

        Plain ones, without white space but for a leading space, are joined by
        line feeds, whose id then parts their ids.
        """
        first, size = bounds[:-1], np.diff(bounds)
        blank = IS_SPACE[data] | _SEPARATORS[data] | _wide_spaces(data)
        spaced = data[first] == 32
        plain = (np.add.reduceat(blank, first, dtype=np.int32) == spaced) & (size > spaced)
        lengths, found = np.zeros(len(first), np.int64), []
        for some in np.array_split(np.flatnonzero(plain), max(1, int(plain.sum()) // 4096)):
            if not len(some):
                continue
            ends = np.cumsum(size[some] + 1)
            joined = np.full(ends[-1] - 1, 10, np.uint8)
            inside = np.ones(ends[-1], bool)
            inside[ends - 1] = False
            joined[inside[:-1]] = data[np.repeat(first[some] - (ends - size[some] - 1), size[some]) + np.flatnonzero(inside)]
            ids = np.array(self._ids([joined.tobytes().decode()])[0], np.uint32)
            feeds = np.flatnonzero(ids == self._line_feed)
            if len(feeds) != len(some) - 1:
                raise ValueError("a piece holds the id of a line feed")
            lengths[some] = np.diff(np.concatenate([[-1], feeds, [len(ids)]])) - 1
            found.append((some, ids[ids != self._line_feed]))
        rest = np.flatnonzero(~plain)
        if len(rest):
            texts = self._ids([data[bounds[i] : bounds[i + 1]].tobytes().decode() for i in rest.tolist()])
            lengths[rest] = [len(x) for x in texts]
            found.append((rest, np.array([x for some in texts for x in some], np.uint32)))
        total = int(lengths.sum())
        if self._used + total > len(self._pool):
            self._pool = np.concatenate([self._pool[: self._used], np.zeros(self._used // 2 + total, np.uint32)])
        starts = np.zeros(len(first), np.int64)
        for some, ids in found:
            starts[some] = self._used + np.cumsum(lengths[some]) - lengths[some]
            self._pool[self._used : self._used + len(ids)] = ids
            self._used += len(ids)
        at = np.searchsorted(self._keys[:, 0], keys[:, 0])
        self._keys = np.insert(self._keys, at, keys, axis=0)
        self._starts = np.insert(self._starts, at, starts.astype(np.int32))
        self._lengths = np.insert(self._lengths, at, lengths.astype(np.int32))
        self._again = np.insert(self._again, at, False)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the memory, whether it is there) of each key."""
        if not len(self._keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self._keys[:, 0], keys[:, 0]), len(self._keys) - 1)
        same = self._keys[at, 0] == keys[:, 0]
        if (same & (self._keys[at, 1] != keys[:, 1])).any():
            raise ValueError("two pieces have the same first hash")
        return at, same

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text starts in them and the number at the end)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if not self.cuts:
            ids = self._ids([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            return np.array([x for some in ids for x in some], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        starts = piece_starts(offsets, data).astype(np.int32)
        sizes = np.diff(np.append(starts, np.int32(len(data))))
        _, first, of = np.unique(_piece_hashes(data, starts, sizes, _FACTORS[0]), return_index=True, return_inverse=True)
        # The different pieces, one after the other.
        size, bounds = sizes[first], np.concatenate([[0], np.cumsum(sizes[first])])
        pieces = data[np.repeat(starts[first] - bounds[:-1], size) + np.arange(bounds[-1])]
        distinct = np.stack([_piece_hashes(pieces, bounds[:-1], size, f) for f in _FACTORS], axis=1)
        if len(self._keys) + len(first) > MOST_PIECES or self._used > MOST_IDS:
            self._make_room()
        at, known = self._find(distinct)
        self._again[at[known]] = True
        if not known.all():
            new = ~known
            ends = np.concatenate([[0], np.cumsum(size[new])])
            self._learn(distinct[new], pieces[np.repeat(new, size)], ends)
        at, _ = self._find(distinct)
        lengths, begin = self._lengths[at][of], self._starts[at][of]
        ends = np.cumsum(lengths)
        ids = self._pool[np.repeat(begin - ends + lengths, lengths) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return ids, bounds

    def encode_slice(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """encode, of a long text part by part; where each text starts comes with the last part, for all of them."""
        if len(offsets) != 2 or not self.cuts:
            yield self.encode(offsets, data)
            return
        total, held = 0, None
        for part in text_parts(data):
            if held is not None:
                yield held, None
            held = self.encode(np.array([0, len(part)]), part)[0]
            total += len(held)
        yield held, np.array([0, total])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; Spark's workers live on from task to task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def file_schema(largest_id: int) -> pa.Schema:
    """Ids take 16 bits where all fit, else 32; masks take one bit."""
    kind = pa.uint16() if largest_id < 1 << 16 else pa.uint32()
    return pa.schema([pa.field("ids", pa.list_(kind, SEQUENCE)), pa.field("mask", pa.list_(pa.bool_(), SEQUENCE))])


class _SequenceFile:
    """An Arrow IPC file that takes a stream of ids and cuts it into full batches."""

    def __init__(self, folder: str, largest_id: int):
        self.file = NewFile(folder, "tokens", ".arrow")
        self._schema = file_schema(largest_id)
        self._kind = self._schema.field("ids").type.value_type.to_pandas_dtype()
        self._out = ipc.new_file(self.file.stream, self._schema)
        self._held: list[np.ndarray] = []
        self._size = 0

    def add(self, ids: np.ndarray) -> None:
        self._held.append(ids)
        self._size += len(ids)
        if self._size >= SEQUENCE * BATCH:
            flat, whole = np.concatenate(self._held), self._size - self._size % (SEQUENCE * BATCH)
            for k in range(0, whole, SEQUENCE * BATCH):
                self._write(flat[k : k + SEQUENCE * BATCH], SEQUENCE * BATCH)
            self._held, self._size = [flat[whole:]], self._size - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), SEQUENCE) for x in (ids.astype(self._kind), mask)]
        self._out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self._schema))

    def close(self) -> None:
        if self._size:
            flat = np.concatenate(self._held)
            self._write(np.append(flat, np.zeros(-len(flat) % SEQUENCE, np.uint32)), len(flat))
        self._out.close()
        self.file.close()


def _writer(folder: str, path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, docs_file, docs, total, count = None, None, None, 0, 0
        for b in batches:
            tokens = tokens or _SequenceFile(folder, max(encoder(path).largest_id, end_id))
            if docs_file is None:
                docs_file = NewFile(folder, "documents", ".arrow")
                docs = ipc.new_file(docs_file.stream, DOC_SCHEMA)
            for row, offsets, data in text_slices(b.column("text"), SLICE_BYTES):
                rows = len(offsets) - 1
                for ids, bounds in encoder(path).encode_slice(offsets, data):
                    if bounds is None:
                        tokens.add(ids)
                        continue
                    lengths = np.diff(bounds) + 1
                    # Of a long text the parts before the last are written already.
                    ends = np.cumsum(lengths) - (bounds[-1] - len(ids))
                    out = np.full(len(ids) + rows, end_id, np.uint32)
                    out[np.delete(np.arange(len(out)), ends - 1)] = ids
                    tokens.add(out)
                starts = total + np.cumsum(lengths) - lengths
                ids_of = b.column("doc_id").slice(row, rows)
                docs.write_batch(pa.RecordBatch.from_arrays([ids_of, pa.array(starts), pa.array(lengths)], schema=DOC_SCHEMA))
                total, count = total + int(lengths.sum()), count + rows
        if tokens:
            tokens.close()
            docs.close()
            docs_file.close()
            part = TaskContext.get().partitionId()
            rows = [[part], [tokens.file.name], [docs_file.name], [count], [total]]
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names)

    return released(write)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, order: Sequence[str] = ORDER) -> DataFrame:
    """Encode whole texts in ascending order into files in folder; returns the manifest, a written table.

    The manifest has a row per partition that has documents: part, tokens_file,
    docs_file, documents, tokens; parts follow each other in that order.
    order: the columns to sort by; by default rows with the same doc_id follow
    each other, ordered by text, and a null doc_id comes first.
    tokenizer: path of a vocabulary file of the tokenizers library, the same on
    all machines; one that is not byte-level BPE is slower, see Encoder. Null and empty texts are just the end id; an empty table
    writes no file. Other columns of docs are left out.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    typed = {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}
    wanted = docs.select(*[x.alias(c) for c, x in typed.items()], *[F.col(f"`{c}`") for c in order if c not in typed])
    keys = [F.col(f"`{c}`") for c in order]
    # A text may be long, so ranges are cut by its head, which also deals out rows whose other keys are the same.
    ranges = [F.substring(F.col(f"`{c}`"), 1, 32) if c == "text" else F.col(f"`{c}`") for c in order]
    ordered = wanted.repartitionByRange(parts, *ranges).sortWithinPartitions(*keys)
    make_folder(folder)
    return keep(ordered.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST), f"{folder}/tables/manifest")


def open_sequences(folder: str, name: str) -> ipc.RecordBatchFileReader:
    """Batches of sequences and masks; from a local folder nothing is copied."""
    return ipc.open_file(open_file(folder, name))


def token_range(reader: ipc.RecordBatchFileReader, start: int, end: int) -> np.ndarray:
    """Ids start to end of a file's stream; a view of the file where they lie in one batch."""
    out = []
    for k in range(start // (SEQUENCE * BATCH), -(-end // (SEQUENCE * BATCH))):
        flat = reader.get_batch(k).column("ids").flatten().to_numpy()
        first = k * SEQUENCE * BATCH
        out.append(flat[max(start - first, 0) : end - first])
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file, sequence.

    sequence is the number of the document's first sequence in its file.
    """
    # One row per written file, so this window is small.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, tokens_file, docs_file in zip(*(b.column(c).to_pylist() for c in ("base", "tokens_file", "docs_file")), strict=True):
                reader, docs = open_sequences(folder, tokens_file), ipc.open_file(open_file(folder, docs_file))
                for k in range(docs.num_record_batches):
                    d = docs.get_batch(k)
                    starts, lengths = d.column("start").to_numpy(), d.column("n_tokens").to_numpy()
                    flat = token_range(reader, int(starts[0]), int(starts[-1] + lengths[-1]))
                    at = starts - starts[0]
                    crcs = [zlib.crc32(flat[a : a + n].astype("<u4")) for a, n in zip(at, lengths, strict=True)]
                    names = pa.array([tokens_file] * len(at))
                    columns = [d.column("doc_id"), pa.array(starts + base), pa.array(lengths), pa.array(crcs, pa.int64()), names, pa.array(starts // SEQUENCE)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "file", "sequence"])

    rows = max(1, min(manifest.count(), 10_000))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, sequence long"
    return parts.repartition(rows, "part").mapInArrow(released(read), schema)


def token_output(docs: DataFrame, tokenizer: str, order: Sequence[str] = ORDER) -> DataFrame:
    """Write docs to files in the shared work folder and read them back; see write_tokens and read_tokens."""
    folder = work_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, order=order), folder)
