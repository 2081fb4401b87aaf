"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from folioflow.llm import queries, spelling
from folioflow.llm.common import keep, work_dir

from ..duck import assert_same

SF = "/root/testdata/sf0.001"


def near(a, b):
    """One edit apart, by trying all edits."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, out = {}, {}
    for w, n in counts.items():
        around = [x for x in counts if near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
        out[w] = [form[w], w, n, len(around), counts[form[w]] if form[w] else None]
    for w in out:
        while form[out[w][1]]:
            out[w][1] = form[out[w][1]]
    return {w: tuple(v) for w, v in out.items()}


def frame(spark, docs):
    rows = [(i, t, "x", 7, 1) for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n long, root int")


def test_variants_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_CHARS", 60)
    monkeypatch.setattr(spelling, "ROUND_BYTES", 4000)
    monkeypatch.setattr(spelling, "WALKED", 20)
    monkeypatch.setattr(spelling, "COUNTED", 30)
    rng = random.Random(12)
    base = ["".join(rng.choices("abé", k=rng.randint(5, 8))) for _ in range(30)] + ["Straßen", "À×÷ÿAbc", "aaaaaa", "aaaaaaa", "a" * 70, "b" * 300]
    docs = [(None, None), (1, ""), (1, "aaaaaa " * 8), (None, "Straßen " * 6), (2, "aaaaaab" * 2000)]
    docs += [(3, "wonderful " * 150 + "Wonderfil " * 30 + "wonderfill " * 6 + "onderfill " * 5)]
    for i in range(150):
        words = []
        for w in rng.choices(base, weights=[5**(k % 4) for k in range(len(base))], k=40):
            k = rng.randrange(len(w))
            words.append(w if rng.random() < 0.8 else w[:k] + rng.choice(["", "a", "bé"]) + w[k + 1 :])
        docs.append((i // 2, rng.choice([" ", "1", "—", "_"]).join(words)))
    wanted = plain(docs)
    assert wanted["wonderfill"][:2] == ("wonderfil", "wonderful")
    got = spelling.spelling_variants(frame(spark, docs))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == wanted


def test_slips(spark):
    docs = [(i, " ".join(["Encyclopaedia"] * 10)) for i in range(400)]
    wanted = plain(docs)
    assert len(wanted) > 1
    got = spelling.spelling_variants(frame(spark, docs))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == wanted


def test_neighbours_of_any_words(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 7))) for _ in range(150)} | {"\U0001f600b", "b", "\U0001f600"})
    trie = spelling.Trie(**spelling.build_trie(words[::2], list(range(1, len(words[::2]) + 1))))
    got = Counter((words[i], trie.word(x)) for i, x in trie.neighbours(words))
    assert got == Counter((a, b) for a in words for b in words[::2] if near(a, b))
    assert not list(trie.neighbours([]))
    assert not list(spelling.Trie(**spelling.build_trie([], [])).neighbours(["ab"]))


def test_no_words(spark):
    for docs in ([], [(1, None)], [(1, "short words only")]):
        assert spelling.spelling_variants(frame(spark, docs)).count() == 0
    counts = keep(spark.range(3).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("word"), F.lit(9).cast("long").alias("n")), work_dir(spark, "t"))
    assert spelling.neighbours(counts).count() == 6


def test_query_equals_its_sql(spark):
    assert_same(spark, queries.QUERIES["op12_spelling_variants"], queries.ORACLE_SQL["op12_spelling_variants"], SF)
