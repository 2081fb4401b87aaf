"""N-gram Jaccard join by prefix filters under several global token orders.

A document's set holds its distinct five-word shingles, and two documents link
when their sets' Jaccard similarity is at least 3/4. Under any one order of all
tokens, two such sets share tokens among the first ones of each, so documents
and pairs must pass that test under several orders:

1. by hash: how many of a set's first tokens do other sets have among theirs?
   Needs no counts and emits no pairs; only documents that share enough go on.
2. by the number of sets that have a token, the rarest first: sets with a
   common first token are candidates. Tokens that no other set has come first
   and can't match, and passages that many documents share come last, so that
   they make candidates only of texts that hold little else. A set must also
   have enough tokens that other sets have.
3. by a second, independent hash: each candidate pair must share a first token
   here as well. Only then are the two sets compared.

Equal sets are one class from the start. Inside a group of sets with a common
first token, all are first compared with the most central alone; then only pairs
that these links left in different components are compared, so a large group of
near copies costs a row per member and not a row per pair, and no link between
components is lost. Groups that are still large are compared block by block,
each pair of blocks in a task of its own that yields links and no pairs. In the
same way, the links inside each component are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, keep, small_side, work_dir
from .shingles import distinct, mix, shingle_hashes, text_slices, word_hashes
from .tasks import arrays, released

#: The threshold as a fraction of the union.
NUMERATOR, DENOMINATOR = 75, 100
#: A token that more than this many sets have is not counted any further and comes last, so that no task gathers all
#: its sets; doubled until the list of such tokens fits.
FREQUENT = 48
#: Most tokens on that list, which every task holds (8 bytes each).
MOST_FREQUENT = 1 << 20
#: Postings that a task holds before it sends them on, and that a group of tokens is to have.
HELD = 1 << 20
#: Sets with a common token of which pairs are rows; more are compared in blocks.
CROWD = 64
#: Sets, and tokens of them, in a block.
BLOCK_SETS, BLOCK_TOKENS = 256, 1 << 19
_SECOND = np.uint64(0xA24BAED4963EE407)


def needed(n):
    """Least size of the intersection with any set that a set of size n can link with."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _spare(n):
    """Tokens beyond the plain prefix that order 1 looks at, plus one."""
    return 1 + n // 8


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit hash of a whole set, which stands for the class of documents that have this set."""
    parts = np.array([np.bitwise_xor.reduce(mix(tokens + _SECOND)), tokens.sum(dtype=np.uint64)], np.uint64)
    return int(mix(parts[:1] + mix(parts[1:])).view(np.int64)[0])


def _sets(text: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    for row, offsets, data in text_slices(text):
        yield row, distinct(*shingle_hashes(*word_hashes(offsets, data)))


def _row_key(docs: DataFrame, *others: Column) -> DataFrame:
    """doc_id, text_hash and text of docs: rows that share the first two have the same text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), *others)


def document_classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n (size of the set) and cls of each row of docs; cls is null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, classes = [], []
            for _, sets in _sets(b.column("text")):
                sizes += [len(s) for s in sets]
                classes += [class_of(s) if len(s) else None for s in sets]
            columns = [b.column("doc_id"), b.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "cls"])

    return _row_key(docs).mapInArrow(released(run), "doc_id long, text_hash long, n long, cls long")


def _groups(tokens: int, least: int) -> int:
    """Number of groups by token range for so many postings: about HELD in each, but least at least."""
    return max(least, -(-tokens // HELD))


def _shared_prefixes(parts: int):
    """Map side of order 1: blocks of (token, cls) by token range, at most one set per token and block.

    A token that several sets of a block have is counted for them right here,
    and only the first of these sets is sent on, marked as counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, classes, held, seen = [], [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            t, c = np.concatenate(tokens), np.concatenate(classes)
            tokens.clear()
            classes.clear()
            order = np.argsort(t, kind="stable")
            t, c = t[order], c[order]
            del order
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            counts = np.diff(np.append(first, len(t)))
            shared = np.repeat(counts > 1, counts)
            here, n = np.unique(c[shared], return_counts=True)
            yield _counts(here, n, parts)
            t, c, many = t[first], c[first], (counts > 1).astype(np.uint8)
            part = (t >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            rows = [(k, a, b) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in rows], pa.int32()),
                    pa.array([t[a:b].tobytes() for _, a, b in rows], pa.binary()),
                    pa.array([c[a:b].tobytes() for _, a, b in rows], pa.binary()),
                    pa.array([many[a:b].tobytes() for _, a, b in rows], pa.binary()),
                    pa.nulls(len(rows), pa.int64()),
                    pa.nulls(len(rows), pa.int64()),
                ],
                ["part", "tokens", "classes", "many", "cls", "n_shared"],
            )

        for b in batches:
            for _, sets in _sets(b.column("text")):
                for s in sets:
                    if not len(s) or (c := class_of(s)) in seen:
                        continue
                    seen.add(c)
                    n = len(s)
                    prefix = s[: n - needed(n) + min(_spare(n), needed(n))]
                    tokens.append(prefix)
                    classes.append(np.full(len(prefix), c, np.int64))
                    held += len(prefix)
                    if held >= HELD:
                        yield from flush()
                        held, seen = 0, set()
        if held:
            yield from flush()

    return released(run)


def _counts(classes: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    part = (classes.view(np.uint64) % np.uint64(parts)).astype(np.int32)
    blank = [pa.nulls(len(classes), pa.binary())] * 3
    columns = [pa.array(part), *blank, pa.array(classes, pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["part", "tokens", "classes", "many", "cls", "n_shared"])


def _count_shared(table: pa.Table) -> pa.Table:
    """Reduce side of order 1: for each set that was not counted yet, tokens that another set has; then the other counts."""
    counted = table.filter(pc.is_valid(table["cls"])).select(["cls", "n_shared"])
    table = table.filter(pc.is_valid(table["tokens"]))
    if not table.num_rows:
        return counted
    t, c, many = (np.concatenate(arrays(table[k], d)) for k, d in (("tokens", np.uint64), ("classes", np.int64), ("many", np.uint8)))
    order = np.argsort(t, kind="stable")
    t, c, many = t[order], c[order], many[order]
    del order
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    counts = np.diff(np.append(first, len(t)))
    low, high = np.minimum.reduceat(c, first), np.maximum.reduceat(c, first)
    some = np.maximum.reduceat(many, first) > 0
    shared = np.repeat((low != high) | some, counts) & (many == 0)
    here, n = np.unique(c[shared], return_counts=True)
    return pa.concat_tables([counted, pa.table({"cls": pa.array(here, pa.int64()), "n_shared": pa.array(n, pa.int64())})])


def surviving_classes(docs: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """cls, n and row (doc_id and text_hash of one row) of the classes that share enough first tokens under order 1."""
    wanted = docs.select(F.col("text").cast("string").alias("text"))
    postings = classes.filter("cls is not null").agg(F.sum("n")).first()[0] or 0
    parts = _groups(postings * 3 // 8, parts)
    schema = "part int, tokens binary, classes binary, many binary, cls long, n_shared long"
    blocks = wanted.mapInArrow(_shared_prefixes(parts), schema)
    counted = blocks.groupBy("part").applyInArrow(_count_shared, "cls long, n_shared long")
    total = counted.groupBy("cls").agg(F.sum("n_shared").alias("n_shared"))
    groups = classes.filter("cls is not null").groupBy("cls", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    # The smallest set that links with this one has needed(n) tokens, and both share its spare tokens at least.
    smallest = F.expr(f"(({NUMERATOR} * n + {DENOMINATOR - 1}) div {DENOMINATOR})")
    least = F.least(F.lit(1) + F.expr("n div 8"), F.lit(1) + F.floor(smallest / 8), smallest)
    return total.join(groups, "cls").filter(F.col("n_shared") >= least).select("cls", "n", "row")


def class_sets(docs: DataFrame, survivors: DataFrame, repeated: bool) -> DataFrame:
    """cls, n and the set (sorted 64-bit tokens) of each surviving class, from one of its rows.

    repeated: rows of docs may repeat; a class comes once all the same.
    """
    one = survivors.select(F.col("row.doc_id").alias("_doc"), F.col("row.text_hash").alias("_hash"), F.col("cls").alias("_cls"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    chosen = _row_key(docs).join(small_side(one), same).select("_cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, sets in _sets(b.column("text")):
                columns = [b.column("_cls").slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["cls", "n", "tokens"])

    found = chosen.mapInArrow(released(run), "cls long, n long, tokens binary")
    return found.dropDuplicates(["cls"]) if repeated else found


def _token_counts(parts: int):
    """Map side of the counts: (token, number of sets) by token range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            part = (t >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            rows = [(k, a, b) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            columns = [
                pa.array([k for k, _, _ in rows], pa.int32()),
                pa.array([t[a:b].tobytes() for _, a, b in rows], pa.binary()),
                pa.array([n[a:b].astype(np.int32).tobytes() for _, a, b in rows], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["part", "tokens", "counts"])

        for b in batches:
            for x in arrays(b.column("tokens"), np.uint64):
                held.append(x)
                size += len(x)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return released(run)


def frequent_tokens(sets: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens that more than FREQUENT sets have, and how many; FREQUENT is doubled until there are MOST_FREQUENT at most."""

    def add(table: pa.Table) -> pa.Table:
        t, n = np.concatenate(arrays(table["tokens"], np.uint64)), np.concatenate(arrays(table["counts"], np.int32))
        t, of = np.unique(t, return_inverse=True)
        n = np.bincount(of, n).astype(np.int64)
        many = n > FREQUENT
        return pa.table({"token": pa.array(t[many].view(np.int64)), "sets": pa.array(n[many])})

    blocks = sets.select("tokens").mapInArrow(_token_counts(parts), "part int, tokens binary, counts binary")
    counted = keep(blocks.groupBy("part").applyInArrow(add, "token long, sets long"), work_dir(sets.sparkSession, "ngram") + "/counts")
    least = FREQUENT
    while counted.filter(F.col("sets") > least).count() > MOST_FREQUENT:
        least *= 2
    rows = counted.filter(F.col("sets") > least).toPandas()
    tokens, count = rows["token"].to_numpy(np.int64).view(np.uint64), rows["sets"].to_numpy(np.int64).astype(np.int32)
    order = np.argsort(tokens)
    return tokens[order], count[order]


def _rare_tokens(frequent, parts: int):
    """Map side of order 2: blocks of (token, set) by token range; a set's frequent tokens pass with their counts instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, often_sets = frequent.value

        def flush(held: list[np.ndarray], classes: list[int]) -> Iterator[pa.RecordBatch]:
            of = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
            t, c = np.concatenate(held), np.array(classes, np.int64)
            at = np.minimum(np.searchsorted(last, t), max(len(last) - 1, 0))
            often = last[at] == t if len(last) else np.zeros(len(t), bool)
            bounds = np.searchsorted(of[often], np.arange(len(held) + 1))
            some, sets = t[often], often_sets[at[often]] if len(last) else often_sets
            rows = [(k, i, j) for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if j > i]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(c[k].view(np.uint64) % np.uint64(parts)) for k, _, _ in rows], pa.int32()),
                    pa.array([some[i:j].tobytes() for _, i, j in rows], pa.binary()),
                    pa.array([sets[i:j].tobytes() for _, i, j in rows], pa.binary()),
                    pa.nulls(len(rows), pa.binary()),
                    pa.array([classes[k] for k, _, _ in rows], pa.int64()),
                ],
                _RARE,
            )
            t, of = t[~often], of[~often]
            order = np.argsort(t, kind="stable")
            t, of = t[order], of[order]
            part = (t >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            rows = [(k, i, j) for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if j > i]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in rows], pa.int32()),
                    pa.array([t[i:j].tobytes() for _, i, j in rows], pa.binary()),
                    pa.array([of[i:j].tobytes() for _, i, j in rows], pa.binary()),
                    pa.array([c.tobytes()] * len(rows), pa.binary()),
                    pa.nulls(len(rows), pa.int64()),
                ],
                _RARE,
            )

        held, classes, size = [], [], 0
        for b in batches:
            for c, x in zip(b.column("cls").to_pylist(), arrays(b.column("tokens"), np.uint64), strict=True):
                held.append(x)
                classes.append(c)
                size += len(x)
                if size >= HELD:
                    yield from flush(held, classes)
                    held, classes, size = [], [], 0
        if size:
            yield from flush(held, classes)

    return released(run)


_RARE = ["part", "tokens", "of", "classes", "cls"]


def _count_sets(table: pa.Table) -> pa.Table:
    """Reduce side of order 2: for each set, its tokens that other sets have, with the number of sets."""
    alone = table.filter(pc.is_valid(table["cls"]))
    table = table.filter(pc.is_null(table["cls"]))
    out = pa.table({"cls": alone["cls"], "tokens": alone["tokens"], "counts": alone["of"]})
    if not table.num_rows:
        return out
    t = np.concatenate(arrays(table["tokens"], np.uint64))
    blocks = zip(arrays(table["of"], np.uint32), arrays(table["classes"], np.int64), strict=True)
    c = np.concatenate([y[x] for x, y in blocks])
    order = np.argsort(t, kind="stable")
    t, c = t[order], c[order]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    n = np.diff(np.append(first, len(t)))
    n = np.repeat(n, n).astype(np.int32)
    t, c, n = t[n > 1], c[n > 1], n[n > 1]
    order = np.argsort(c, kind="stable")
    t, c, n = t[order], c[order], n[order]
    starts = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(c))
    rows = list(zip(starts.tolist(), ends.tolist(), strict=True)) if len(c) else []
    shared = pa.table(
        {
            "cls": pa.array(c[starts], pa.int64()),
            "tokens": pa.array([t[i:j].tobytes() for i, j in rows], pa.binary()),
            "counts": pa.array([n[i:j].tobytes() for i, j in rows], pa.binary()),
        }
    )
    return pa.concat_tables([out, shared])


_POSTING = "token long, prev long, rest long, cls long, n long, common double"


def _second_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each set's prefix under order 2 that other sets have too; a set with too few such tokens has none.

    Tokens of no other set come first in this order and cannot match. prev is
    the token before in the prefix: sets with the same one meet there already.
    rest is the number of the set's tokens from this one on, all that it can
    share with a set whose first common token is this one; common is the mean
    logarithm of the counts of all tokens: it is greatest for the text that a
    group's members are copies of.
    """
    names = [x.split()[0] for x in _POSTING.split(", ")]
    for b in batches:
        prefixes, classes, sizes, rest, common = [], [], [], [], []
        for c, n, parts in zip(*(b.column(k).to_pylist() for k in ("cls", "n", "parts")), strict=True):
            t = np.concatenate([np.frombuffer(x["tokens"], np.uint64) for x in parts])
            m = np.concatenate([np.frombuffer(x["counts"], np.int32) for x in parts])
            if len(t) < needed(n):
                continue
            prefix = t[np.lexsort((t, m))][: len(t) - needed(n) + 1]
            prefixes.append(prefix.view(np.int64))
            classes.append(c)
            sizes.append(n)
            rest.append(len(t) - np.arange(len(prefix)))
            common.append(float(np.log(m).sum() / n))
        if prefixes:
            lengths = np.array([len(x) for x in prefixes])
            token = np.concatenate(prefixes)
            begins = np.zeros(len(token), bool)
            begins[np.cumsum(lengths) - lengths] = True
            columns = [pa.array(token), pa.array(np.roll(token, 1), mask=begins), pa.array(np.concatenate(rest))]
            columns += [pa.array(np.repeat(x, lengths)) for x in (classes, sizes, common)]
            yield pa.RecordBatch.from_arrays(columns, names)


def second_order_postings(sets: DataFrame, survivors: DataFrame, parts: int, path: str) -> DataFrame:
    """token, prev, rest, cls, n, common of the tokens in each set's prefix under order 2 that other sets have too; a written table."""
    parts = _groups(survivors.agg(F.sum("n")).first()[0] or 0, parts)
    frequent = sets.sparkSession.sparkContext.broadcast(frequent_tokens(sets, parts))
    rows = sets.select("cls", "tokens").mapInArrow(_rare_tokens(frequent, parts), "part int, tokens binary, of binary, classes binary, cls long")
    counted = rows.groupBy("part").applyInArrow(_count_sets, "cls long, tokens binary, counts binary")
    gathered = counted.groupBy("cls").agg(F.collect_list(F.struct("tokens", "counts")).alias("parts"))
    out = keep(gathered.join(survivors.select("cls", "n"), "cls").mapInArrow(released(_second_prefix), _POSTING), path, tidy=True)
    frequent.destroy()
    return out


def _third_prefix(t: np.ndarray) -> np.ndarray:
    return np.sort(mix(t ^ _SECOND))[: len(t) - needed(len(t)) + 1]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Order 3 on each candidate pair, then the whole sets; yields the pairs that link."""
    for batch in batches:
        ends = zip(*(batch.column(k).to_pylist() for k in ("a", "b")), *(arrays(batch.column(k), np.uint64) for k in ("tokens_a", "tokens_b")), strict=True)
        a_, b_ = [], []
        for a, b, s, t in ends:
            if not np.intersect1d(_third_prefix(s), _third_prefix(t), assume_unique=True).size:
                continue
            both = len(np.intersect1d(s, t, assume_unique=True))
            if DENOMINATOR * both >= NUMERATOR * (len(s) + len(t) - both):
                a_.append(a)
                b_.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"])


def links_between(sets: list[np.ndarray], side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j > i that link with it) of two blocks of sets, each pair from both sides; of one block if no side is 1."""
    sizes = np.array([len(s) for s in sets])
    tokens, run = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(run, kind="stable")]
    count = np.bincount(run, minlength=len(tokens))
    first, bounds, within = np.cumsum(count) - count, np.cumsum(sizes) - sizes, not side.any()
    for i in np.flatnonzero(side == 0).tolist():
        mine, both = run[bounds[i] : bounds[i] + sizes[i]], np.zeros(len(sets), np.int64)
        mine = mine[count[mine] > 1]
        for k in range(0, len(mine), 1024):
            some = mine[k : k + 1024]
            n = count[some]
            at = np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both += np.bincount(owner[at], minlength=len(sets))
        link = DENOMINATOR * both >= NUMERATOR * (sizes[i] + sizes - both)
        if within:
            link[: i + 1] = False
        else:
            link &= side == 1
        yield i, np.flatnonzero(link)


def _count_links(table: pa.Table) -> pa.Table:
    """cls and how many others of the table it links with, of pairs from both sides."""
    degree = np.zeros(table.num_rows, np.int64)
    for i, others in links_between(arrays(table["tokens"], np.uint64), table["side"].to_numpy()):
        degree[i] += len(others)
        degree[others] += 1
    return pa.table({"cls": table["cls"], "n_links": pa.array(degree)})


def _join_crowd(table: pa.Table) -> pa.Table:
    """Links (a, b) that join the components which links of the table's sets join; no more than there are components."""
    name, comp = np.unique(table["component"].to_numpy(), return_inverse=True)
    parent, out, classes = np.arange(len(name)), [], table["cls"].to_pylist()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(name) > 1:
        for i, others in links_between(arrays(table["tokens"], np.uint64), table["side"].to_numpy()):
            for j in others.tolist():
                x, y = find(comp[i]), find(comp[j])
                if x != y:
                    parent[x] = y
                    out.append((min(classes[i], classes[j]), max(classes[i], classes[j])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _in_blocks(members: DataFrame, sets: DataFrame, key: str, run, schema: str) -> DataFrame:
    """run on every pair of blocks of the sets of each key.

    members: key, cls and what run needs besides cls, side and tokens. A key's
    sets are dealt to blocks by a hash, so that a block has about BLOCK_SETS sets
    and BLOCK_TOKENS tokens at most, and each set goes to as many groups as its
    key has blocks.
    """
    sizes = members.groupBy(key).agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks")
    )
    sizes = keep(sizes, work_dir(members.sparkSession, "ngram") + "/blocks")
    rows = members.drop("n").join(small_side(sizes), key).join(sets.select("cls", "tokens"), "cls")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    rows = rows.withColumn("side", F.when((F.col("own") == F.col("high")) & (F.col("low") < F.col("high")), 1).otherwise(0))
    return rows.drop("own", "other", "blocks").groupBy(key, "low", "high").applyInArrow(run, schema)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of classes (a, b) whose sets link."""
    left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(released(_compare), "a long, b long").distinct()


def _could_link() -> Column:
    """Whether two sets whose first common token is this one can link by what they have from there on."""
    most = F.least("rest_a", "rest_b")
    return (NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (F.col("n_a") + F.col("n_b"))


def components(links: DataFrame, folder: str) -> DataFrame:
    """cls and component (its smallest class) of every class in links, a written table.

    Each round, a class takes the smallest component among its own and its
    neighbours', then that class's own component; rounds end when none changes.
    """
    both = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(links.select("b", "a"))
    both = keep(both.distinct(), f"{folder}/both")
    labels = keep(both.groupBy("cls").agg(F.least(F.min("other"), F.first("cls")).alias("component")), f"{folder}/labels0")
    for k in range(1, 1000):
        of = labels.select(F.col("cls").alias("other"), F.col("component").alias("seen"))
        best = both.join(of, "other").groupBy("cls").agg(F.min("seen").alias("seen"))
        near = labels.join(best, "cls").select("cls", F.least("component", "seen").alias("next"), F.col("component").alias("was"))
        up = labels.select(F.col("cls").alias("next"), F.col("component").alias("up"))
        jumped = near.join(up, "next", "left").select("cls", "was", F.least("next", "up").alias("component"))
        jumped = keep(jumped, f"{folder}/labels{k}")
        labels = jumped.select("cls", "component")
        if jumped.filter("was != component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def _crossing_pairs(placed: DataFrame) -> DataFrame:
    """Pairs of classes in different components with a common token at which they can link and did not meet before."""
    side = lambda x: [F.col(c).alias(f"{c}_{x}" if c != "cls" else x) for c in ("cls", "n", "rest", "component", "prev")]
    # The largest component of a token is only compared with the others, never with itself.
    rest = placed.filter("component <> largest").select("token", *side("a"))
    every = placed.select("token", "largest", *side("b"))
    once = (F.col("component_b") == F.col("largest")) | (F.col("a") < F.col("b"))
    first = F.coalesce(F.col("prev_a") != F.col("prev_b"), F.lit(True))
    pairs = rest.join(every, "token").filter((F.col("component_a") != F.col("component_b")) & once & first & _could_link())
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _component_links(docs: DataFrame, classes: DataFrame, folder: str, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """(cls, component) and (cls, n_links) of the classes that link with others; written tables."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    survivors = keep(surviving_classes(docs, classes, parts), f"{folder}/survivors", tidy=True)
    repeated = not classes.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty()
    sets = keep(class_sets(docs, survivors, repeated), f"{folder}/sets")
    postings = second_order_postings(sets, survivors, max(parts // 4, 1), f"{folder}/postings")

    # First round: every set with the most central one of its token, if there are others.
    heads = postings.groupBy("token").agg(F.max(F.struct("common", "cls", "n", "rest")).alias("head"), F.count("*").alias("m"))
    heads = keep(heads.filter("m > 1").select("token", "head"), f"{folder}/heads")
    ends = [F.col(f"head.{x}").alias(f"{y}a") for x, y in (("cls", ""), ("n", "n_"), ("rest", "rest_"))]
    stars = postings.join(heads, "token").select(*ends, F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"))
    stars = stars.filter(F.col("a") != F.col("b")).filter(_could_link())
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = keep(stars, f"{folder}/stars")
    links = keep(linked(stars, sets), f"{folder}/links1", tidy=True)
    labels = components(links, f"{folder}/first")

    # Second round: pairs of sets with a common token that are in different components.
    placed = postings.drop("common").join(heads.select("token"), "token", "left_semi").join(labels, "cls", "left")
    placed = keep(placed.withColumn("component", F.coalesce("component", "cls")), f"{folder}/placed", tidy=True)
    drop_folder(spark, f"{folder}/postings")
    # room: what a set has left for the size of another one; a set must have room for the smallest of its token, and the
    # roomiest one for it.
    room = (NUMERATOR + DENOMINATOR) * F.col("rest") - NUMERATOR * F.col("n")
    edges = placed.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max(room).alias("most"),
        (F.min("prev").eqNullSafe(F.max("prev")) & (F.count("prev") == F.count("*"))).alias("met"),
    )
    # Where all sets come from one token before, they have met there.
    edges = keep(edges.filter("low < high and not met").select("token", "least", "most"), f"{folder}/edges")
    fits = (room >= NUMERATOR * F.col("least")) & (NUMERATOR * F.col("n") <= F.col("most"))
    fit = keep(placed.join(edges, "token").filter(fits).drop("least", "most"), f"{folder}/fit", tidy=True)
    drop_folder(spark, f"{folder}/placed")
    sizes = fit.groupBy("token", "component").agg(F.count("*").alias("m")).groupBy("token")
    sizes = sizes.agg(F.max(F.struct("m", "component"))["component"].alias("largest"), F.sum("m").alias("m"), F.count("*").alias("components"))
    sizes = keep(sizes.filter("components > 1").drop("components"), f"{folder}/sizes")
    fit = fit.join(sizes, "token")
    pairs = _crossing_pairs(fit.filter(F.col("m") <= CROWD)).join(stars, ["a", "b"], "left_anti")
    pairs = keep(pairs, f"{folder}/pairs", tidy=True)
    crowds = _in_blocks(fit.filter(F.col("m") > CROWD).select("token", "cls", "n", "component"), sets, "token", _join_crowd, "a long, b long")
    more = keep(linked(pairs, sets).unionByName(crowds), f"{folder}/links2", tidy=True)
    if not more.isEmpty():
        labels = components(links.unionByName(more), f"{folder}/second")

    if not count_links:
        return labels, labels.select("cls", F.lit(None).cast("long").alias("n_links"))
    members = labels.join(survivors.select("cls", "n"), "cls")
    # Written counts leave the join plain exchanges on both sides, of which Spark can split a large component's.
    sizes = keep(members.groupBy("component").agg(F.count("*").alias("m")).filter("m > 1"), f"{folder}/component_sizes")
    members = keep(members.join(small_side(sizes), "component"), f"{folder}/members")
    two = members.filter("m = 2").select("cls", F.lit(1).cast("long").alias("n_links"))
    many = _in_blocks(members.filter("m > 2").select("component", "cls", "n"), sets, "component", _count_links, "cls long, n_links long")
    many = many.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    return labels, keep(two.unionByName(many), f"{folder}/degree", tidy=True)


def near_duplicates(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_shingles, component_id, class_id, n_links.

    component_id: the smallest doc_id that links reach, the row's own included.
    class_id: the smallest doc_id with the same set; n_links: the other classes
    that its class links with. The links inside a component are counted pair by
    pair, in blocks; without count_links, n_links is null. text_hash tells rows
    with one doc_id but different texts apart.

    Null texts and texts without words have no shingles and link with nothing,
    not even each other; rows with equal sets always link; a doc_id that repeats
    keeps its rows; a null doc_id is never the smallest, and a component of null
    ids only has a null component_id. An empty table gives no rows. Other columns
    of docs, whatever their names, are left out.
    """
    folder = work_dir(docs.sparkSession, "ngram")
    classes = keep(document_classes(docs), f"{folder}/classes")
    labels, degree = _component_links(docs, classes, f"{folder}/work", count_links)
    groups = classes.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("class_id"))
    groups = groups.join(labels, "cls", "left").join(degree, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    groups = keep(groups, f"{folder}/groups", tidy=True)
    drop_folder(docs.sparkSession, f"{folder}/work")
    smallest = keep(groups.groupBy("component").agg(F.min("class_id").alias("component_id")), f"{folder}/smallest")
    groups = groups.join(small_side(smallest), "component").select("cls", "class_id", "component_id", "n_links")
    none = F.when(F.lit(count_links), F.lit(0).cast("long"))
    return classes.join(groups, "cls", "left").select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", none).alias("n_links"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest doc_id.

    Columns stay as they are, whatever their names. Where several rows have that
    doc_id, the one with the smallest hash of its text stays, once; a group whose
    ids are all null keeps one row likewise. Rows without shingles have no group
    and all stay. See near_duplicates for other odd inputs.
    """
    folder = work_dir(docs.sparkSession, "ngram")
    classes = keep(document_classes(docs), f"{folder}/classes")
    labels, _ = _component_links(docs, classes, f"{folder}/work", False)
    placed = classes.filter("cls is not null").join(labels, "cls", "left")
    placed = placed.select("doc_id", "text_hash", F.coalesce("component", "cls").alias("component"))
    row = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    placed = keep(placed, f"{folder}/placed", tidy=True)
    drop_folder(docs.sparkSession, f"{folder}/work")
    first = placed.groupBy("component").agg(F.min(row).alias("first"), F.count("*").alias("m")).filter("m > 1")
    first = first.select("component", F.col("first.doc_id").alias("first_doc"), F.col("first.text_hash").alias("first_hash"))
    first = small_side(keep(first, f"{folder}/first"))
    own = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_hash") == F.col("first_hash"))
    # Rows to drop, and rows that stay but come several times.
    some = placed.join(first, "component").groupBy("doc_id", "text_hash").agg(F.max(own).alias("stays"), F.count("*").alias("m"))
    some = keep(some.filter("not stays or m > 1"), f"{folder}/some")
    gone = some.filter("not stays").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    again = some.filter("stays").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = _row_key(docs, whole).drop("text")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    kept = rows.join(small_side(gone), same, "left_anti")
    if again.isEmpty():
        return kept.select("_row.*")
    again = small_side(again)
    repeated = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return kept.join(again, same, "left_anti").unionByName(repeated).select("_row.*")
