"""Licence scans: sparse TF-IDF cosine to templates, then inheritance down the directory tree.

Every line of a file is a candidate header, and so is every run of words, over
line breaks and comment marks, that is as long as a template and holds one of
its three-word sequences; both are compared with the templates by the cosine of
TF-IDF vectors, runs also with paragraphs of the licences' own texts. A text of
which a run takes nearly all words is a licence file as a whole. Document frequencies of the templates' words are counted over
all files. A directory has the licence of its licence files, and a file without
a licence of its own takes the one of its nearest ancestor, by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, small_side, work_dir
from .shingles import text_slices, word_hashes
from .tasks import released

#: The usual short notices, as they stand in file headers.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_MIT_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"
_GNU = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
#: Distinctive paragraphs of licence texts and their long notices, which runs of words are compared with.
BODIES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAME + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("GPL-3.0", _GNU.format(":", "General Public License", "3")),
    ("GPL-2.0", _GNU.format(";", "General Public License", "2")),
    ("LGPL-3.0", _GNU.format(":", "Lesser General Public License", "3")),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
#: A run of words is the whole text if it has this share of its words; titles and copyright lines are the rest.
WHOLE = 0.75
#: Words that only mark comments.
_MARKS = (b"#", b"##", b"//", b"///", b"*", b"**", b"/*", b"/**", b"*/", b"--", b";", b";;", b"%", b"%%", b"!", b"<!--", b"-->", b"rem", b"dnl", b"|", b">")
#: Least cosine of a line or file to a template.
THRESHOLD = 0.8
#: A line is looked at if this share of its words is in the templates.
KNOWN_WORDS = 0.5
#: Names that make a file its directory's licence file, whatever its text: LICENSE, LICENSE.txt, LICENSE-MIT, LICENSE.lib.txt, LICENSES/MIT.txt.
LICENSE_NAMES = r"(?i)(?:^|/)(?:(?:un)?licen[cs]e|copying|notice)(?:[-_.][a-z0-9+._-]*)?\z|(?:^|/)licen[cs]es/[^/]+\z"
#: Bytes of lines whose scores a task remembers, about.
CACHE_BYTES = 1 << 24
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z) without punctuation around them."""
    return [w for w in (x.lower().strip(b".,;:!?()[]{}\"'") for x in WORD.findall(text)) if w]


class _Vectors:
    """TF-IDF vectors of the templates; a word of no template weighs as much as the rarest that is in one."""

    def __init__(self, templates, frequency: dict[bytes, int], files: int):
        self.idf = {w: math.log((1 + files) / (1 + n)) + 1 for w, n in frequency.items()}
        self.other = max(self.idf.values(), default=1.0)
        self.names = [name for name, _ in templates]
        self.sizes = [len(tokens(text.encode())) for _, text in templates]
        self.unit = [self._unit(Counter(tokens(text.encode()))) for _, text in templates]

    def _unit(self, bag: Counter) -> dict[bytes, float]:
        weights = {w: (1 + math.log(n)) * self.idf.get(w, self.other) for w, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        return {w: x / norm for w, x in weights.items()} if norm else {}

    def best(self, text: bytes) -> tuple[float, str | None]:
        """(cosine, name) of the nearest template."""
        mine = self._unit(Counter(tokens(text)))
        scores = [(sum(x * mine.get(w, 0.0) for w, x in unit.items()), name) for unit, name in zip(self.unit, self.names, strict=True)]
        return max(scores, key=lambda s: s[0], default=(0.0, None))


def _plain(text: bytes) -> list[bytes]:
    """tokens, without the words that only mark comments."""
    return [w for w in (x.lower().strip(b".,;:!?()[]{}\"'") for x in WORD.findall(text) if x.lower() not in _MARKS) if w]


class _Runs:
    """Finds runs of words that are near a template, whatever the line breaks."""

    def __init__(self, templates, vectors: _Vectors):
        self.vectors, self.at = vectors, {}
        for k, (_, text) in enumerate(templates):
            words = tokens(text.encode())
            for i in range(len(words) - 2):
                self.at.setdefault(tuple(words[i : i + 3]), set()).add((k, i))
        # The rarest kind of word of each sequence, as it may stand in a text, picks the rows to look at.
        self.anchor = _vocabulary([("", w.decode()) for w in sorted({max(x, key=len) for x in self.at})])[1]

    def rows(self, offsets: np.ndarray, data: np.ndarray) -> list[int]:
        """Rows in which two at least of any five words in sequence are such words."""
        words, first = word_hashes(offsets, data)
        if not len(words):
            return []
        hit = self.anchor[np.minimum(np.searchsorted(self.anchor, words), len(self.anchor) - 1)] == words
        at = np.flatnonzero(hit)
        close = at[1:][np.diff(at) <= 5]
        return np.unique(np.searchsorted(first, close, "right") - 1).tolist()

    def best(self, text: bytes) -> tuple[float, str | None, bool]:
        """(cosine, name, whether it is nearly all of the text) of the run that is nearest to a template."""
        words, best, near = _plain(text), (0.0, 0), (0.0, None, False)
        lines = [x[0] for x in (WORD.findall(line.lower()) for line in text.split(b"\n")) if x]
        comment = 2 * sum(x in _MARKS for x in lines) > len(lines)
        starts: dict[int, set[int]] = {}
        for i in range(len(words) - 2):
            for k, j in self.at.get(tuple(words[i : i + 3]), ()):
                starts.setdefault(k, set()).add(max(i - j, 0))
        for k, some in starts.items():
            size, unit = self.vectors.sizes[k], self.vectors.unit[k]
            for start in some:
                mine = self.vectors._unit(Counter(words[start : start + size]))
                score = sum(x * mine.get(w, 0.0) for w, x in unit.items())
                # Of templates that fit equally well the longer one says more. A comment's file is no licence file.
                if (round(score, 6), size) > best:
                    best = (round(score, 6), size)
                    near = (score, self.vectors.names[k], size >= WHOLE * len(words) and not comment)
        return near


def _known_lines(offsets: np.ndarray, data: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(row, line) of the lines of which enough words are known; compares hashes of words with and without a full stop."""
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, breaks, breaks + 1]))
    words, first = word_hashes(edges, data)
    hit = known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words
    sums = np.concatenate([[0], np.cumsum(hit)])[first]
    counts = np.diff(first)
    for k in np.flatnonzero((np.diff(sums) >= KNOWN_WORDS * counts) & (counts > 0)).tolist():
        start = int(edges[k])
        yield int(np.searchsorted(offsets, start, "right")) - 1, data[start : edges[k + 1]].tobytes()


def _vocabulary(templates) -> tuple[list[bytes], np.ndarray]:
    """Words of the templates, and the hashes under which they may stand in a text, sorted."""
    words = sorted({w for _, text in templates for w in tokens(text.encode())})
    forms = [(w + end).decode() for w in words for end in (b"", b".", b",", b";", b":")]
    hashes = word_hashes(*_column(forms))[0]
    return words, np.unique(hashes)


def _column(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = next(text_slices(pa.array(texts, pa.large_string()), 1 << 30))
    return offsets, data


def word_frequencies(files: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """How many files have each word of the templates; one row per such word and task is shuffled."""
    words, _ = _vocabulary(templates)
    forms = [(w + end).decode() for w in words for end in (b"", b".", b",", b";", b":")]
    hashes = word_hashes(*_column(forms))[0]
    order = np.argsort(hashes)
    sorted_hashes, number = hashes[order], order // 5

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for b in batches:
            for _, offsets, data in text_slices(b.column("content")):
                found, first = word_hashes(offsets, data)
                at = np.minimum(np.searchsorted(sorted_hashes, found), len(sorted_hashes) - 1)
                hits = np.flatnonzero(sorted_hashes[at] == found)
                row = np.searchsorted(first, hits, "right") - 1
                pairs = np.unique(row * len(words) + number[at[hits]])
                total += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int32()), pa.array(total)], ["word", "n"])

    rows = files.select("content").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {w: 0 for w in words} | {words[r["word"]]: r["n"] for r in rows.collect()}


def own_licenses(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, bodies=BODIES) -> DataFrame:
    """path and id of each file with the licence of its header or text: license, score, whole (the text is no more)."""
    wider, count = (*templates, *bodies), files.count()
    frequency = word_frequencies(files, wider)
    runs = _Runs(wider, _Vectors(wider, frequency, count))
    shared = files.sparkSession.sparkContext.broadcast((_Vectors(templates, frequency, count), runs))
    known = _vocabulary(templates)[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vectors, runs), cache, held = shared.value, {}, 0
        for b in batches:
            best: list[tuple[float, str | None, bool]] = [(0.0, None, False)] * b.num_rows
            for row, offsets, data in text_slices(b.column("content")):
                for k, line in _known_lines(offsets, data, known):
                    if line in cache:
                        score, name = cache[line]
                    else:
                        score, name = vectors.best(line)
                        held += len(line) + 200
                        if held > CACHE_BYTES:
                            cache, held = {}, len(line)
                        cache[line] = score, name
                    if score >= threshold and score > best[row + k][0]:
                        whole = data[offsets[k] : offsets[k + 1]].tobytes().strip() == line.strip()
                        best[row + k] = (score, name, whole)
                for k in runs.rows(offsets, data):
                    score, name, whole = runs.best(data[offsets[k] : offsets[k + 1]].tobytes())
                    if score >= threshold and score > best[row + k][0]:
                        best[row + k] = (score, name, whole)
            scores, names, whole = zip(*best, strict=True) if best else ((), (), ())
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(whole, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("path"), *columns], ["id", "path", "license", "score", "whole"])

    schema = "id long, path string, license string, score double, whole boolean"
    return files.select("id", "path", "content").mapInArrow(released(scan), schema)


def parent(path: Column) -> Column:
    """The directory of a path; that of a name without a slash is the empty path, and the empty path has none."""
    return F.when(path == "", F.lit(None)).otherwise(F.regexp_replace(path, r"/?[^/]*\z", ""))


def scan_licenses(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of files (id, path, content): id, path, license, score, origin, license_path.

    origin: header (a line or run of words of the file matches a template), file (the file is a
    licence file: by its name, or its text is little but the notice), inherited
    (from the licence file of the nearest ancestor directory, license_path) or
    none. Of a directory's licence files with a known licence the first by path counts, then the
    greatest score. A licence file by name whose licence is not known has none, inherits
    nothing, and where it is all that a directory has, nothing from above comes
    past it. A folder LICENSES speaks for the directory that it is in. Null and empty contents have no licence of their own; a file
    with a null path inherits nothing; repeated rows get the same answer each;
    an empty table gives no rows. Other columns of files are left out.
    """
    spark = files.sparkSession
    typed = files.select(F.col("id").cast("long"), F.col("path").cast("string"), F.col("content").cast("string"))
    own = keep(own_licenses(typed, templates, threshold), work_dir(spark, "licenses") + "/own")
    named = F.coalesce(F.col("path").rlike(LICENSE_NAMES), F.lit(False))
    is_file = F.col("license").isNotNull() & (named | F.col("whole"))
    by_rank = F.struct(F.col("license").isNull(), F.col("path"), -F.col("score"), F.col("license"))
    speaks_for = F.when(named, F.regexp_replace(parent(F.col("path")), r"(?i)(?:^|/)licen[cs]es\z", "")).otherwise(parent(F.col("path")))
    granted = own.filter((is_file | named) & F.col("path").isNotNull()).groupBy(speaks_for.alias("dir"))
    granted = granted.agg(F.min(by_rank).alias("grant")).select("dir", F.col("grant.license").alias("granted"), F.col("grant.path").alias("license_path"))
    granted = keep(granted, work_dir(spark, "licenses") + "/granted")

    # Directories of files that need one, with all their ancestors: one row per directory and depth.
    need = own.filter("license is null and path is not null").select(parent(F.col("path")).alias("dir")).distinct()
    pieces = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(pieces)), lambda i: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), i), "/"))
    above = need.select("dir", F.posexplode(ups).alias("depth", "ancestor"))
    found = above.join(small_side(granted.withColumnRenamed("dir", "ancestor")), "ancestor")
    nearest = found.groupBy("dir").agg(F.max_by(F.struct("granted", "license_path"), "depth").alias("up"))
    nearest = keep(nearest.select(F.col("dir").alias("up_dir"), "up.*"), work_dir(spark, "licenses") + "/nearest")

    takes = F.col("license").isNull() & ~named & (parent(F.col("path")) == F.col("up_dir"))
    joined = own.join(small_side(nearest), takes, "left")
    origin = (
        F.when(is_file, F.lit("file"))
        .when(F.col("license").isNotNull(), F.lit("header"))
        .when(F.col("granted").isNotNull(), F.lit("inherited"))
        .otherwise(F.lit("none"))
    )
    return joined.select(
        "id",
        "path",
        F.coalesce("license", "granted").alias("license"),
        "score",
        origin.alias("origin"),
        F.when(origin == "inherited", F.col("license_path")).alias("license_path"),
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """scan_licenses over documents: the path is source/lang/doc_id; returns doc_id in place of id."""
    part = lambda c: F.coalesce(F.regexp_replace(c, "/", "_"), F.lit("none"))
    path = F.concat_ws("/", part("source"), part("lang"), F.col("doc_id").cast("string"))
    files = docs.select(F.col("doc_id").alias("id"), path.alias("path"), F.col("text").alias("content"))
    return scan_licenses(files).withColumnRenamed("id", "doc_id")
