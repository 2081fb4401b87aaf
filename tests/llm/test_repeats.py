"""Removal of repeated passages, and the suffix construction, against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import queries, repeats
from folioflow.llm.suffixes import Segments, repeated_starts

from ..duck import connect

SF = "/root/testdata/sf0.001"
W = 200


def aligned(rng, many=8):
    n = rng.randint(0, many)
    strings = [bytes(rng.choices(b"ab\x00\xff", k=rng.randint(1, 14))) for _ in range(n)]
    return strings, [rng.randint(0, 4) for _ in strings], sorted(rng.randint(0, 2) for _ in strings)


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_segments_equal_a_sort():
    rng = random.Random(1)
    for _ in range(200):
        strings, leads, groups = aligned(rng)
        built = Segments(strings, leads, groups)
        while built.column:
            built.insert()
            here = [k for k, b in enumerate(built.begin) if b <= built.column < built.end[k]]
            suffix = {k: strings[k][built.column - built.begin[k] :] for k in here}
            rows = built.rows.tolist()
            assert sorted(rows) == here
            assert [(groups[k], suffix[k]) for k in rows] == sorted((groups[k], suffix[k]) for k in here)
            wanted = [common(suffix[i], suffix[j]) if groups[i] == groups[j] else 0 for i, j in zip(rows, rows[1:], strict=False)]
            assert built.common.tolist() == ([0, *wanted] if rows else [])


def test_repeated_starts():
    rng = random.Random(2)
    for _ in range(200):
        strings, leads, groups = aligned(rng, 9)
        counts = Counter((g, i - x, s[i : i + 3]) for s, x, g in zip(strings, leads, groups, strict=True) for i in range(len(s) - 2))
        got = repeated_starts(strings, leads, groups, 3)
        wanted = [[i for i in range(len(s) - 2) if counts[g, i - x, s[i : i + 3]] > 1] for s, x, g in zip(strings, leads, groups, strict=True)]
        assert [g.tolist() for g in got] == wanted


def test_anchors_are_those_of_equal_windows(monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 300)
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 123, 260).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, int(n)).astype(np.uint8), shared, rng.integers(97, 123, 900).astype(np.uint8)]) for n in (0, 5, 333, 700)]
    at = {}
    for n, text in zip((0, 5, 333, 700), texts, strict=True):
        h, place, first, last = repeats.anchors(text)
        assert first[0] == 0 and last[-1] == len(text) - W and (first[1:] == last[:-1] + 1).all()
        assert (place >= last).all() and (place + repeats.GRAM <= first + W).all()
        for k in range(61):
            run = np.searchsorted(first, n + k, "right") - 1
            at.setdefault(k, set()).add((int(h[run]), int(place[run]) - n))
    assert all(len(x) == 1 for x in at.values())


def plain(docs):
    texts = [(t or "").encode() for _, t in docs]
    counts = Counter(t[i : i + W] for t in texts for i in range(len(t) - W + 1))
    out = []
    for (i, _), t in zip(docs, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - W + 1):
            if counts[t[k : k + W]] > 1:
                gone[k : k + W] = b"\1" * W
        spans = sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1]))
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, b"t", 2, "h") for d in docs], "doc_id long, text string, start int, t binary, pieces int, h string")


def mixed_documents(rng):
    letters = "abcdefghijklmnop étü"
    text = lambda n: "".join(rng.choices(letters, k=n))
    shared = [text(n) for n in (120, 199, 200, 201, 230, 260, 300, 500, 900)]
    docs = [(1, None), (2, ""), (None, "x" * 199), (None, "y" * 200), (None, "y" * 200), (3, "z" * 1500), (4, "ab" * 300), (5, ("line of text %d. " * 20) + text(50))]
    docs += [(6, shared[4] + shared[4]), (7, shared[5][:250]), (7, shared[5][:250]), (8, text(30) + shared[6][10:280] + text(9))]
    for i in range(70):
        docs.append((10 + i // 2, "".join(rng.choice([text(rng.randint(0, 150)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 60) :]]) for _ in range(rng.randint(1, 7)))))
    whole = docs[-1][1] + shared[-1]
    for i in range(40):  # near copies
        k = rng.randrange(len(whole))
        docs.append((100 + i, whole[:k] + rng.choice(["", "#", "##"]) + whole[k + 1 :]))
    docs += [(200, whole), (201, whole), (None, whole)]
    return docs


@pytest.mark.parametrize("crowd, batch", [(2048, 1 << 20), (3, 500)])
def test_removal_equals_plain_python(spark, monkeypatch, crowd, batch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BATCH_BYTES", batch)
    docs = mixed_documents(random.Random(13))
    wanted = plain(docs)
    got = Counter(tuple(r) for r in repeats.without_repeats(frame(spark, docs)).collect())
    assert got == wanted
    assert sum(1 for r in wanted if 0 < r[2] < r[1]) > 50


def test_empty_table(spark):
    assert repeats.without_repeats(frame(spark, [])).count() == 0
    assert [tuple(r)[1:4] for r in repeats.without_repeats(frame(spark, [(1, None)])).collect()] == [(0, 0, 0)]


def test_query_equals_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op13_repeated_passages"](spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain(docs)
    assert Counter(connect(SF).sql(queries.ORACLE_SQL["op13_repeated_passages"]).fetchall()) == plain(docs)
