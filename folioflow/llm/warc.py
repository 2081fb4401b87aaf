"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole WARC records,
and ends with the seek table of the public seekable format: a skippable frame
that lists every frame's compressed and plain size. A record is found by its
bundle, frame and offset inside the frame, so reading one costs one frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, small_side, work_dir
from .files import NewFile, make_folder, open_file
from .tasks import released

#: Fixed values of the public formats.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Plain bytes after which a frame is closed; a longer record has a frame of its own.
FRAME_BYTES = 1 << 19
#: Smaller payloads are stored again rather than referred to.
LEAST_REVISIT = 100
WARC_DATE = "2020-01-01T00:00:00Z"
MANIFEST = (
    "page_id long, record_id string, record_type string, refers_to long, bundle string, frame int, frame_start long, "
    "frame_bytes long, offset long, length long"
)


def record_name(page_id: int | None, digest: str) -> str:
    """The same page and payload always get the same record identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps no payload but names its digest and length."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_name(page_id, digest)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if revisit:
        head += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: {record_name(refers_to, digest)}",
            f"X-Refers-To-Page: {refers_to}",
            f"X-Payload-Length: {len(payload)}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes, offset: int) -> tuple[dict[str, str], bytes]:
    """(headers, body) of the record that starts at offset."""
    end = data.index(b"\r\n\r\n", offset)
    first, *lines = data[offset:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {offset}")
    head = dict(line.split(": ", 1) for line in lines)
    body = data[end + 4 : end + 4 + int(head["Content-Length"])]
    return head, body


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer frame of a bundle whose frames have these (compressed, plain) sizes."""
    entries = b"".join(struct.pack("<II", a, b) for a, b in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the end of the file."""
    total = file.size()
    file.seek(total - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the file does not end with a seek table")
    file.seek(total - 9 - 8 * count)
    data, out, start = file.read(8 * count), [], 0
    for a, b in struct.iter_unpack("<II", data):
        out.append((start, a, b))
        start += a
    return out


def read_record(folder: str, bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: reads the seek table and one frame."""
    with open_file(folder, bundle) as file:
        start, packed, plain = read_seek_table(file)[frame]
        file.seek(start)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
    return parse_record(data, offset)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, frames, packer = None, [], zstandard.ZstdCompressor(level=3)
        plain, held = bytearray(), []

        def close_frame() -> pa.RecordBatch:
            packed = packer.compress(bytes(plain))
            start = file.write(packed)
            rows = [(*r, file.name, len(frames), start, len(packed), o, n) for *r, o, n in held]
            frames.append((len(packed), len(plain)))
            plain.clear()
            held.clear()
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in MANIFEST.split(", ")]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, html, digest, refers_to = (b.column(k)[i].as_py() for k in range(5))
                file = file or NewFile(folder, "bundle", ".warc.zst")
                record = record_bytes(page_id, url, (html or "").encode(), digest, refers_to)
                kind = "response" if refers_to is None else "revisit"
                held.append((page_id, record_name(page_id, digest), kind, refers_to, len(plain), len(record)))
                plain.extend(record)
                if len(plain) >= FRAME_BYTES:
                    yield close_frame()
        if file:
            if held:
                yield close_frame()
            file.write(seek_table(frames))
            file.close()

    return write


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) to bundles in folder; returns the manifest.

    The manifest has a row per record: page_id, record_id, record_type,
    refers_to, and its place: bundle, frame, frame_start, frame_bytes, offset in
    the plain frame, length. Of records with equal payloads of at least 100
    bytes the ones with the smallest page_id are responses and the others
    revisits of it. A null html is an empty payload; a null page_id is never the
    smallest, and where no page of a payload has one, all are responses;
    repeated rows each get a record; an empty table writes no bundle. Other
    columns of pages are left out. The manifest is a written table.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"),
        F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("bytes"),
    )
    large = base.filter(F.col("bytes") >= LEAST_REVISIT)
    again = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = keep(again.select("digest", "first"), f"{folder}/tables/again")
    joined = base.join(small_side(again), "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    rows = joined.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))
    make_folder(folder)
    return keep(rows.mapInArrow(released(_writer(folder)), MANIFEST), f"{folder}/tables/manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Read every record of the manifest from its bundle: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The payload's length and digest are those of the full payload: measured for
    a response, and named by the record for a revisit, which holds no payload.
    Raises if a response's payload doesn't have the digest that its record names.
    """
    frames = manifest.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, name, file, table = zstandard.ZstdDecompressor(), None, None, []
        for b in batches:
            out = []
            for bundle, frame, offsets in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bundle != name:
                    name, file = bundle, open_file(folder, bundle)
                    table = read_seek_table(file)
                start, packed, plain = table[frame]
                file.seek(start)
                data = unpacker.decompress(file.read(packed), max_output_size=plain)
                for offset in offsets:
                    head, body = parse_record(data, offset)
                    kind, named = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(body).hexdigest() != named:
                        raise ValueError(f"{bundle}, frame {frame}, offset {offset}: the payload does not have its digest")
                    page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
                    size = int(head.get("X-Payload-Length", len(body)))
                    out.append((page and int(page), size, named, kind, refers and int(refers)))
            if not out:
                continue
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return frames.sortWithinPartitions("bundle", "frame").mapInArrow(released(read), schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages to bundles in the shared work folder and read them back; see write_warc and read_warc."""
    folder = work_dir(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder)
