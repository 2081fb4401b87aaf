"""What each filter of a chain removes under every order of the filters.

A document's failures are the bits of one small number, so the step at which an
order removes it is an entry of a table with a row for each set of failures and a
column for each order. Documents are scanned once, natively; tasks count them by
part, failures and label, look the counts' steps up and emit arrays that Spark adds up.

Defined results: a null text is an empty one; a null part is the empty string; a
null doc_id is neither smaller nor larger than another, has no label and is never
a later copy; rows with equal doc_id and text are copies of a smaller id only; a
doc_id with several labels has each of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, small_side, work_dir, words
from .tasks import released

#: The filters of failure_bits, in the order of their bits.
FILTERS = "ABCDE"
#: A task holds the counts of so many parts before it emits them.
PARTS_HELD = 256
#: Bits of a label.
GOOD, TOXIC = 1, 2
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders(names: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(names)]


def first_failures(names: str = FILTERS) -> np.ndarray:
    """Step, from 1, at which an order removes a set of failures, or 0; a row per set, a column per order."""
    table = np.zeros((1 << len(names), len(orders(names))), np.int8)
    sets = np.arange(len(table))
    for o, order in enumerate(orders(names)):
        for step in range(len(names), 0, -1):
            table[sets >> names.index(order[step - 1]) & 1 == 1, o] = step
    return table


def text_failures(text: Column) -> Column:
    """Bits 0 to 3 of a text: under 200 words, few distinct words, many capitals, a symbol."""
    text = F.coalesce(text, F.lit(""))
    w = words(text)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = (
        F.size(w) < 200,
        100 * F.size(F.array_distinct(w)) < 50 * F.size(w),
        100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def judged_documents(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, failures (five bits) and label (two bits) of each document.

    Later copies are found on digests: one narrow shuffle for the first id of each
    text, then a join with those that occur more than once, whose large side
    adaptive execution can split.
    """
    folder = work_dir(docs.sparkSession, "audit")
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        text_failures(F.col("text")).alias("_bits"),
        F.unhex(F.sha2(text, 256)).alias("_digest"),
    )
    marks = keep(marks, f"{folder}/marks")
    copied = marks.groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_rows")).filter("_rows > 1")
    copied = keep(copied.drop("_rows"), f"{folder}/copied", tidy=True)
    of = labels.groupBy("doc_id").agg(
        *[F.max(F.when(F.col(c) == 1, bit).otherwise(0)).alias(c) for c, bit in (("quality", GOOD), ("toxic", TOXIC))]
    )
    of = keep(of.select("doc_id", (F.col("quality") + F.col("toxic")).alias("label")).filter("label > 0 AND doc_id IS NOT NULL"), f"{folder}/labels")
    out = marks.join(small_side(copied), "_digest", "left").join(small_side(of), "doc_id", "left")
    later = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    failures = F.col("_bits") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)
    return out.select("doc_id", "part", failures.alias("failures"), F.coalesce("label", F.lit(0)).alias("label"))


def _partial_sums(names: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's part: counts by part, failures and label, turned into counts by part, order and step."""
    steps, every, first = len(names), orders(names), first_failures(names)
    sets = len(first)
    tested = np.array([[names.index(x) for x in o] for o in every])  # the filter at each order's step
    fails = np.arange(sets)[:, None, None] >> tested & 1 == 1
    redundant = (fails & (first[:, :, None] < np.arange(1, steps + 1)) & (first[:, :, None] > 0)).astype(np.int64)
    passing = ((first[:, :, None] == 0) | (first[:, :, None] > np.arange(1, steps + 1))).astype(np.int64)

    def emit(parts: dict[str, int], counts: np.ndarray) -> pa.RecordBatch:
        n = len(parts)
        counts = counts[:n]
        total = counts.sum(axis=2)
        where = np.arange(n)[:, None, None] * len(every) * steps + np.arange(len(every)) * steps + first.astype(np.int64) - 1
        hit = np.broadcast_to(first > 0, where.shape)
        # [part, order, step] of documents by label; sums of whole numbers below 2^53 are exact
        removed = [
            np.bincount(where[hit], np.broadcast_to(counts[:, :, None, k], where.shape)[hit], n * len(every) * steps)
            .astype(np.int64)
            .reshape(n, len(every), steps)
            for k in range(4)
        ]
        all_removed = sum(removed)
        of_filter = np.stack([(all_removed * (tested == f)).sum(axis=(1, 2)) for f in range(steps)], axis=1)
        columns = {
            "kept": np.einsum("ps,sok->pok", total, passing),
            "removed": all_removed,
            "redundant": np.einsum("ps,sok->pok", total, redundant),
            "unique_fails": total[:, 1 << tested],
            "good_lost": removed[GOOD] + removed[GOOD | TOXIC],
            "toxic_lost": removed[TOXIC] + removed[GOOD | TOXIC],
            "shapley": of_filter[:, tested],
        }
        keys = {
            "part": pa.array([p for p in parts for _ in range(len(every) * steps)], pa.string()),
            "filter_order": pa.array([o for o in every for _ in range(steps)] * n, pa.string()),
            "step": pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), n * len(every))),
        }
        return pa.RecordBatch.from_pydict(keys | {c: pa.array(columns[c].reshape(-1)) for c in COUNTS})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, int] = {}
        counts = np.zeros((PARTS_HELD, sets, 4), np.int64)
        for batch in batches:
            coded = batch["part"].dictionary_encode()
            cells = np.asarray(coded.indices).astype(np.int64) * sets * 4 + np.asarray(batch["failures"]) * 4 + np.asarray(batch["label"])
            found = np.bincount(cells, minlength=len(coded.dictionary) * sets * 4).reshape(-1, sets, 4)
            for name, count in zip(coded.dictionary.to_pylist(), found, strict=True):
                if name not in parts:
                    if len(parts) == PARTS_HELD:
                        yield emit(parts, counts)
                        parts.clear()
                        counts[:] = 0
                    parts[name] = len(parts)
                counts[parts[name]] += count
        if parts:
            yield emit(parts, counts)

    return released(run)


def audit(judged: DataFrame, names: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of documents for every part and every order of the filters names.

    judged has part (string), failures (a bit per filter, in the order of names) and
    label (bits GOOD and TOXIC). shapley is the number that a step's filter removes,
    added up over all orders; divided by their number, it is its fair share.
    """
    schema = f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}"
    sums = judged.select("part", F.col("failures").cast("int"), F.col("label").cast("int")).mapInArrow(_partial_sums(names), schema)
    return sums.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])
