"""Spelling variants: words one edit apart, and the form that each rare spelling stands for.

Words are counted in tasks and summed by Spark. The vocabulary is cut along its
sorted order into shards of bounded size, each a compact trie; shards are broadcast
in rounds of bounded size, and every task walks its sorted words depth-first through
each shard with the automaton of all strings at distance one, which shares the
states of a prefix among all words that begin with it. Neighbours are reduced to
counts and best forms.

Defined results: null texts have no words; a null doc_id is the empty string in the
hash; rows that repeat count each time; an empty table gives no rows. A word may be
as long as a text: one that is larger than a shard makes a shard of its own.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, work_dir
from .tasks import released

#: Runs of A-Z, a-z and U+00C0 to U+00FF in lower-cased UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: One in so many (document, run) loses a character.
SLIP = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
FACTOR = 5
#: Different words that a task counts before it emits them, and sorted words that it walks through the shards at a time.
COUNTED, WALKED = 200_000, 100_000
#: Characters of the words of a shard, so about a third as many nodes at least, and bytes of the shards of one broadcast.
SHARD_CHARS, ROUND_BYTES = 600_000, 48 << 20
_LAST = chr(0x10FFFF)


def _slipped(run: bytes, doc: int) -> bytes:
    """run with one character taken out if its hash in the document whose prefix's crc32 is doc says so."""
    h = zlib.crc32(run, doc)
    if h % SLIP:
        return run
    text = run.decode()
    k = h % len(text)
    return (text[:k] + text[k + 1 :]).encode()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.binary()).cast(pa.string()), "n": pa.array(total.values(), pa.int64())})
        total.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch["doc"], batch["text"], strict=True):
            prefix = zlib.crc32(doc.as_py().encode() + b":")
            # A lower-cased byte string changes A-Z alone.
            for run, n in Counter(_RUN.findall(text.as_py().encode().lower())).items():
                if len(run) >= LEAST_LENGTH:
                    word = _slipped(run, prefix)
                    if len(word) >= LEAST_LENGTH:
                        total[word] += n
            if len(total) >= COUNTED:
                yield emit()
    if total:
        yield emit()


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of the words with LEAST_LENGTH characters and LEAST_COUNT occurrences at least."""
    rows = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    counts = rows.mapInArrow(released(_count_words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while low < n and a[low] == b[low]:
        low += 1
    return low


def build_trie(words: list[str], counts: list[int]) -> dict[str, bytes]:
    """A trie of sorted, different words as arrays over its nodes in depth-first order; node 0 is the root.

    parent; label, the character that leads to a node; end, one past the last node
    below it; n, the count of the word that ends there, else 0.
    """
    parent, label, n, end = [-1], [0], [0], [0]
    path, before = [0], ""
    for word, count in zip(words, counts, strict=True):
        d = common_prefix(before, word)
        for x in path[d + 1 :]:
            end[x] = len(parent)
        del path[d + 1 :]
        for c in word[d:]:
            parent.append(path[-1])
            path.append(len(label))
            label.append(ord(c))
            n.append(0)
            end.append(0)
        n[path[-1]] = count
        before = word
    for x in path:
        end[x] = len(parent)
    kinds = {"parent": np.int32, "label": np.int32, "end": np.int32, "n": np.int64}
    return {k: np.array(v, kinds[k]).tobytes() for k, v in zip(kinds, (parent, label, end, n), strict=True)}


_SHARD = "shard string, size long, parent binary, label binary, end binary, n binary"


def _build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: list[str] = []
    counts: list[int] = []
    chars = 0

    def shard() -> pa.RecordBatch:
        trie = build_trie(words, counts)
        row = {"shard": words[0], "size": sum(map(len, trie.values()))} | trie
        kinds = {"shard": pa.string(), "size": pa.int64()}
        return pa.RecordBatch.from_pydict({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})

    for batch in batches:
        for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
            if words and chars + len(word) > SHARD_CHARS:
                yield shard()
                words, counts, chars = [], [], 0
            words.append(word)
            counts.append(n)
            chars += len(word)
    if words:
        yield shard()


class Trie:
    """A shard, ready to be walked."""

    def __init__(self, parent: bytes, label: bytes, end: bytes, n: bytes):
        self.label = np.frombuffer(label, np.int32).tolist()
        self.end = np.frombuffer(end, np.int32).tolist()
        self.n = np.frombuffer(n, np.int64).tolist()
        keys = np.frombuffer(parent, np.int32).astype(np.int64) << 21 | np.frombuffer(label, np.int32)
        self.child = dict(zip(keys[1:].tolist(), range(1, len(keys)), strict=True))
        self._parent = np.frombuffer(parent, np.int32)

    def word(self, node: int) -> str:
        out = []
        while node:
            out.append(chr(self.label[node]))
            node = int(self._parent[node])
        return "".join(reversed(out))

    def children(self, node: int) -> Iterator[int]:
        x, stop = node + 1, self.end[node]
        while x < stop:
            yield x
            x = self.end[x]

    def neighbours(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(place of a word, node) of every word of the trie at distance one from a word of words, which are sorted and different.

        For each prefix there is the node that it leads to without an edit, if any,
        and the nodes that it leads to with one. A prefix that leads nowhere rules
        out all words that begin with it.
        """
        child, label, n = self.child, self.label, self.n
        exact: list[int] = [0]
        edited: list[set[int]] = [set()]
        at, before = 0, ""
        while at < len(words):
            word = words[at]
            d = common_prefix(before, word)
            del exact[d + 1 :], edited[d + 1 :]
            before = word
            for k in range(len(exact) - 1, len(word)):
                c = ord(word[k])
                node, near = exact[k], {y for x in edited[k] if (y := child.get(x << 21 | c))}
                after = -1
                if node >= 0:
                    near.add(node)  # c is left out
                    for x in self.children(node):
                        if label[x] == c:
                            after = x
                        else:
                            near.add(x)  # c is replaced
                        if y := child.get(x << 21 | c):
                            near.add(y)  # a character comes before c
                exact.append(after)
                edited.append(near)
                if after < 0 and not near:
                    at = bisect_right(words, word[: k + 1] + _LAST, at)
                    before = word[: k + 1]
                    break
            else:
                ends = edited[-1]
                if exact[-1] >= 0:
                    ends = ends.union(self.children(exact[-1]))
                for x in ends:
                    if n[x]:
                        yield at, x
                at += 1


def _walk(shards: list[tuple[bytes, ...]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, near, near_n for the words of a task, which come sorted."""

    def found(words: list[str]) -> Iterator[pa.RecordBatch]:
        for shard in shards:
            trie = Trie(*shard)
            pairs = list(trie.neighbours(words))
            if pairs:
                columns = {
                    "word": pa.array([words[i] for i, _ in pairs], pa.string()),
                    "near": pa.array([trie.word(x) for _, x in pairs], pa.string()),
                    "near_n": pa.array([trie.n[x] for _, x in pairs], pa.int64()),
                }
                yield from pa.Table.from_pydict(columns).to_batches(10_000)

    held: list[str] = []
    for batch in batches:
        held += batch["word"].to_pylist()
        if len(held) >= WALKED:
            yield from found(held)
            held = []
    if held:
        yield from found(held)


def neighbours(counts: DataFrame) -> DataFrame:
    """word, near and near_n of every two words of counts (word, n; a written table of different words) at distance one, both ways."""
    spark = counts.sparkSession
    folder = work_dir(spark, "spelling")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = counts.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    ordered = keep(ordered, f"{folder}/words")
    # A task may read several files, so words are sorted again within tasks.
    shards = keep(ordered.sortWithinPartitions("word").mapInArrow(released(_build_shards), _SHARD), f"{folder}/shards", tidy=True)
    rounds: list[list[str]] = []
    size = 0
    for name, bytes_ in shards.select("shard", "size").orderBy("shard").toLocalIterator():
        if not rounds or size + bytes_ > ROUND_BYTES:
            rounds.append([])
            size = 0
        rounds[-1].append(name)
        size += bytes_
    schema = "word string, near string, near_n long"
    out = []
    for k, names in enumerate(rounds):
        rows = shards.filter(F.col("shard").between(names[0], names[-1])).orderBy("shard").collect()  # ROUND_BYTES at most, or one shard
        sent = spark.sparkContext.broadcast([(bytes(r.parent), bytes(r.label), bytes(r.end), bytes(r.n)) for r in rows])
        del rows
        found = ordered.select("word").sortWithinPartitions("word").mapInArrow(released(lambda b, sent=sent: _walk(sent.value, b)), schema)
        out.append(keep(found, f"{folder}/near/{k}"))
        sent.destroy()
    if not out:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/near/{k}" for k in range(len(out))])


def forms(counts: DataFrame, near: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, form, form_n, root and n_near of each word of counts.

    The form is the near word with the largest count (of equal ones the smallest
    word) if it has factor times the word's own count at least. Counts grow by factor
    along forms, so their chains are short; roots are found by doubling.
    """
    spark = counts.sparkSession
    folder = work_dir(spark, "forms")
    # The least of (-count, word) is the best form.
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = counts.select("word", "n").join(best, "word", "left")
    fits = -F.col("best.less") >= factor * F.col("n")
    rows = rows.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    rows = keep(rows, f"{folder}/rows")
    roots = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    least, most = (x or 0 for x in rows.agg(F.min("n"), F.max("form_n")).first())
    steps, n = 0, max(least, 1)
    while n * factor <= most:
        n *= factor
        steps += 1
    for k in range(max(steps - 1, 0).bit_length()):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = keep(roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), f"{folder}/roots-{k}")
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """forms of the words of docs."""
    counts = keep(word_counts(docs), f"{work_dir(docs.sparkSession, 'words')}/counts", tidy=True)
    return forms(counts, neighbours(counts))
