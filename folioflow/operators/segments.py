"""Texts in segments of bounded length, for speech synthesis.

Sentences are packed greedily; one that is too long goes by pieces between
punctuation marks, and a piece that is too long is cut after its last break
character, else at the limit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import zh

_SENTENCES = re.compile(r"[^。！？!?.\n]*[。！？!?.\n]+[”’」』）)\"']*\s*|[^。！？!?.\n]+")
_PIECES = re.compile(r"[，,;；：:、]\s*|[^，,;；：:、]+")
_AFTER_MARK = re.compile(r"([^\w\s]) ")
_BREAKS = frozenset(C.BREAKS)


def hard_split(text: str, most: int) -> Iterator[str]:
    """Cut a text after the last break character within the limit, else at the limit."""
    text = text.strip()
    at, end = 0, len(text)
    while end - at > most:
        cut = next((i + 1 for i in range(at + most - 1, at - 1, -1) if text[i] in _BREAKS), at + most)
        head = text[at:cut].strip()
        if not head:
            cut, head = at + most, text[at : at + most]
        while cut < end and text[cut].isspace():
            cut += 1
        if cut < end and len(head) + end - cut <= most and _BREAKS.issuperset(text[cut:]):
            yield head + text[cut:]
            return
        yield head
        at = cut
    if at < end:
        yield text[at:]


def sentences(text: str) -> list[str]:
    """Sentences by their end marks and line breaks, with what follows up to the next one."""
    return _SENTENCES.findall(text)


def tight(text: str) -> str:
    """text without the one space after each punctuation mark, as marks are spoken of by themselves."""
    return _AFTER_MARK.sub(lambda m: m[1] if unicodedata.category(m[1])[0] == "P" else m[0], text)


def pack(text: str, most: int, split: Callable[[str], Iterable[str]] = sentences) -> Iterator[str]:
    """Segments of at most this many characters; split cuts a text into sentences."""
    held = ""
    for sentence in map(tight, split(text.strip())):
        for part in [sentence] if len(sentence) <= most else _PIECES.findall(sentence):
            if held and len(held) + len(part.rstrip()) > most:
                yield from hard_split(held, most)
                held = ""
            held += part
    yield from hard_split(held, most)


def _exploded(docs: DataFrame, cut: Callable[[str], Iterable[str]], most: int, key: str) -> DataFrame:
    """key (of any type), pos, segment of column text."""
    if most < 1:
        raise ValueError("the limit must be at least 1")
    names = [key, "pos", "segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, places, out = [], [], []
            for row in range(b.num_rows):
                for i, segment in enumerate(cut(b.column(1)[row].as_py() or "")):
                    of.append(row)
                    places.append(i)
                    out.append(segment)
            columns = [b.column(0).take(pa.array(of, pa.int64())), pa.array(places, pa.int32()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    wanted = docs.select(F.col(key), F.col("text").cast("string"))
    return wanted.mapInArrow(run, f"`{key}` {wanted.schema[key].dataType.simpleString()}, pos int, segment string")


def hard_segments(docs: DataFrame, most: int = C.SEGMENT_CHARS, key: str = "doc_id") -> DataFrame:
    """key, pos, segment by break characters only."""
    return _exploded(docs, lambda text: hard_split(text, most), most, key)


def segments(docs: DataFrame, most: int = C.SEGMENT_CHARS, level: str = "basic", key: str = "doc_id", split: Callable[[str], Iterable[str]] = sentences) -> DataFrame:
    """key, pos, segment of the normalised texts; blank texts have none. split cuts a text into sentences, as a language model may."""
    return _exploded(zh.normalize(docs.select(key, "text"), level), lambda text: pack(text, most, split), most, key)
