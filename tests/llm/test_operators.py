"""The operators against plain Python on small fixtures, with odd inputs."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import decontam, licenses, mixing, ngram_join, pii, quality, queries, sharding, token_files, url_filter, warc
from folioflow.llm.common import keep, work_dir

from ..duck import assert_same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def frame(spark, texts):
    rows = [(i, t, f"s{i % 2}" if i % 5 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumn("n", F.lit(1)).withColumn("cls", F.lit("x")).withColumn("token", F.lit(None).cast("string")).withColumn("number", F.lit(2))


# --- personal data

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_pii_base_spans(spark, documents):
    odd = [
        None, "", "a@b.c_d@e.f.g.", "x@@y.z 1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 4111 1111-1111 1111 +1 (212) 555-1234", "😀 joe@ex.com😀1.1.1.1",
        "1" * 50 + " 4111111111111111", "a" * 20000 + "@b.cc", "+1+2+3 +123-456-78-90-.", "4111111111111111.4111111111111111", "a." * 30000 + "@x." + "b." * 20000 + "c",
    ]
    texts = odd + [r.text for r in documents.collect()]
    for r in pii.personal_data(frame(spark, texts)).collect():
        spans = base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        counts = Counter(k for k, _, _ in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [counts[k] for k, _ in BASE]


EXTRA = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.8, r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.4, r"(?i)\b(?:ssn|social security|taxpayer)\b"),
    "local_phone": (
        r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", 0.4,
        r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|fax|whatsapp|teléfono|téléphone|telefon)\b",
    ),
}


def extra_spans(text):
    out = []
    for rank, (kind, (pattern, prior, context)) in enumerate(EXTRA.items(), len(BASE)):
        ends = [0, *[m.end() for m in re.finditer(pattern, text)]]
        for k, m in enumerate(re.finditer(pattern, text)):
            gap_end = next((x.start() for x in re.finditer(pattern, text) if x.start() >= m.end()), len(text))
            before = text[max(ends[k], m.start() - 48) : m.start()]
            near = re.search(context, before) or re.search(context, text[m.end() : min(gap_end, m.end() + 48)])
            if kind == "iban":
                bare = m[0].replace(" ", "").upper()
                if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 != 1:
                    continue
            if prior + 0.4 * bool(near) >= 0.7:
                out.append((m.start(), rank, kind, m.end()))
    return out


def test_pii_all_spans(spark, documents):
    rng = random.Random(8)
    pool = ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", "123-45-6789", "000-12-3456", "(212) 555-1234", "212.555.1234", "SSN", "phone", "bank", "a@b.cc", "1.2.3.4", "lot", "and so on " * 6]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(300)] + ["tel 212 555 1234, " * 700] + [r.text for r in documents.collect()]
    for r in pii.personal_data(frame(spark, texts)).collect():
        text = texts[r.doc_id] or ""
        base = [(s, [k for k, _ in BASE].index(kind), kind, e) for kind, s, e in base_spans(text)]
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(base + extra_spans(text)))


def test_redacting_many_spans(spark):
    texts = ["mail a@b.cc or c@d.ee! " * 1500, "1.2.3.4@x.yy", "no"]
    got = [r.text for r in pii.redact(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["mail [email] or [email]! " * 1500, "[email]", "no"]


def test_pii_checks_and_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32.", "IBAN GB82 WEST 1234 5698 7654 33.", "my SSN: 123-45-6789", "part 123-45-6789", "call 212 555 1234", "lot 212 555 1234"]
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, texts)).collect()}
    assert got == {0: "iban:5:32", 1: "", 2: "ssn:8:19", 3: "", 4: "local_phone:5:17", 5: ""}
    text = pii.redact(frame(spark, ["mail a@b.cc now", None])).orderBy("doc_id").collect()
    assert [r.text for r in text] == ["mail [email] now", None]
    assert pii.personal_data(frame(spark, ["x"]).limit(0)).count() == 0


# --- quality


def measures(text):
    text, w = text or "", words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, documents):
    texts = [None, "", " \n", "a " * 40, "w " * 8, "x y z " * 3, "a\nb\na\nb", "\r\na\r\n"] + [r.text for r in documents.collect()]
    for r in quality.judge_quality(frame(spark, texts)).collect():
        n = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)


def test_quality_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", "kept", 7, "x")], "doc_id long, text string, _w string, N_WORDS int, `a.b` string")
    row = quality.judge_quality(df).first()
    assert (row["_w"], row["n_words"], row["a.b"], row.doc_id, row.text) == ("kept", 2, "x", 1, "a b")


def test_quality_keeps_good_documents(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.judge_quality(documents).join(labels, "doc_id").filter("not base_failed")
    assert judged.filter("quality = 1 and not kept").count() == 0
    assert judged.filter("quality = 0 and kept").count() == 0
    kept = quality.kept_documents(frame(spark, [f"the cat and the dog are in the house of the man who came from a town by the sea with {i} boats" for i in range(3)] + ["x"]))
    assert kept.count() == 3 and "number" in kept.columns and "kept" not in kept.columns


# --- decontamination


def leaks(docs, items, threshold=0.75):
    out = {}
    for doc, text in docs:
        s = shingles(text)
        for item, passage in items:
            bag = Counter(shingles(passage))
            n = sum(bag.values())
            w = len(words(passage))
            runs = [s[i : i + n] for i in range(len(s) - n + 1)] if w >= 5 else [[tuple(words((text or "").lower())[i : i + w])] for i in range(len(words(text or "")) - w + 1)]
            best = 0.0
            for run in runs if n else ():
                both = sum((Counter(run) & bag).values())
                best = max(best, both / (2 * n - both))
            if best >= threshold:
                out[doc, item] = best
    return out


def test_leaks(spark):
    rng = random.Random(2)
    some = lambda n: [f"w{rng.randint(0, 300)}" for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(14, 60)))) for i in range(30)] + [(30, None), (31, ""), (32, "two words"), (33, "a b a b a b a b a b a b")]
    docs = [(0, None), (1, ""), (2, "said two Words here"), (3, "x a b a b a b a b a b a b y")]
    for d in range(4, 90):
        passage = items[rng.randrange(30)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            passage[rng.randrange(len(passage))] = "changed"
        docs.append((d, " ".join(some(rng.randint(0, 80)) + passage + some(rng.randint(0, 80)))))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontam.find_leaks(df, bench).collect()}
    assert found == pytest.approx(leaks(docs, items))
    assert decontam.find_leaks(df, bench.limit(0)).count() == decontam.find_leaks(df.limit(0), bench).count() == 0
    kept = {r.doc_id for r in decontam.clean_documents(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}
    assert decontam.find_leaks(df.union(df), bench).count() == 2 * len(found)
    with pytest.raises(ValueError):
        decontam.find_leaks(df, bench, 0)


def test_leaks_in_shorter_documents(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40))) for i in range(8)] + [(8, "one two three four five six seven eight nine")]
    docs, wanted = [], {}
    for i, passage in items:
        w = passage.split()
        n = len(w) - 4
        for start in (0, 1, 3):
            for end in range(max(len(w) - 12, 0), len(w) + 1):
                text, m = " ".join(w[start:end]), max(min(end - start - 4, n), 0)
                docs.append((len(docs), text))
                if m / n >= 0.75:
                    wanted[len(docs) - 1, i] = m / n
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_leaks(df, bench).collect()
    assert all(r.start_word == 0 for r in found)
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    # Fingerprints of texts near the threshold may lie too far apart; see the README.
    assert got == pytest.approx({k: wanted[k] for k in got}) and {k for k, s in wanted.items() if s > 0.8} <= set(got)
    assert min(got.values()) < 0.8
    assert {r.doc_id for r in decontam.clean_documents(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_benchmark_in_blocks(spark, monkeypatch, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {tuple(r) for r in decontam.find_leaks(documents, bench).collect()}
    for name, value in (("BLOCK_ITEMS", 7), ("BLOCK_BYTES", 3000), ("WINDOWS", 3), ("MOST_BITS", 1 << 17)):
        monkeypatch.setattr(decontam, name, value)
    assert {tuple(r) for r in decontam.find_leaks(documents, bench).collect()} == whole and whole


def test_leaks_with_null_and_repeated_ids(spark):
    passage, other = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(None, passage), (None, passage), (1, other), (1, passage)], "item_id long, text string")
    rows = [(1, passage), (1, "clean text of this row"), (None, f"x {other} y"), (None, "clean too"), (2, f"x {passage} y {other}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_leak", F.lit(1)).withColumn("_doc", F.lit(2)).withColumn("_row", F.lit(2))
    got = Counter((r.doc_id, r.item_id, r.start_word) for r in decontam.find_leaks(df, bench).collect())
    assert got == Counter({(1, None, 0): 1, (1, 1, 0): 1, (None, 1, 1): 1, (2, None, 1): 1, (2, 1, 1): 1, (2, 1, 32): 1})
    kept = decontam.clean_documents(df, bench)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "clean too"), (1, "clean text of this row")]


def test_stretches_hold_every_dense_window():
    rng = random.Random(7)
    for _ in range(300):
        n, least = rng.randint(1, 40), rng.randint(1, 12)
        most, hit = least + rng.randint(0, 10), np.array([rng.random() < 0.8 for _ in range(n)])
        found = decontam.stretches(hit, least, most, 0.75)
        assert all(b > c for (b, _), (_, c) in zip(found[1:], found[:-1], strict=True))
        for a in range(n):
            for size in range(min(least, n), min(most, n) + 1):
                if a + size <= n and hit[a : a + size].sum() >= 6 / 7 * size:
                    assert any(i <= a and a + size <= e for i, e in found)


def test_hamming_index_finds_all():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 50, dtype=np.uint64)
    near = [int(prints[i % 50]) ^ sum(1 << int(b) for b in rng.choice(63, i % 26, replace=False)) for i in range(300)]
    index = decontam.HammingIndex(prints)
    for p, got in zip(near, index.near(np.array(near, np.uint64)), strict=True):
        assert sorted(got) == [i for i, q in enumerate(prints.tolist()) if (p ^ q).bit_count() <= decontam.RADIUS]


# --- mixing


def test_mix(spark, documents):
    docs = documents.select("doc_id", "text", F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("source"))
    rows = mixing.mix_sources(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and len(r.positions) == -(-r.taken // max(r.size, 1))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s, x in share.items() if x > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert target[s] == pytest.approx(2 * sizes[s] if s in full else share[s])
        assert abs(taken[s] - target[s]) <= 0.5
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_positions_follow_the_schedule(spark):
    knots = ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5))
    df = spark.range(101).select((F.col("id") / 100).alias("x")).select("x", mixing.due(F.col("x"), knots).alias("t"))
    total = 0.75 + 0.375
    for r in df.collect():
        t = r.t
        done = 2 * t - t * t if t <= 0.5 else 0.75 + (t - 0.5) - (t - 0.5) ** 2 / 2
        assert done / total == pytest.approx(r.x, abs=1e-9)


def test_mixed_documents(spark):
    df = frame(spark, [None, "", *["w " * (i % 40 + 1) for i in range(200)]])
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert max(Counter(r.doc_id for r in out.collect()).values()) <= 2


    order = [(r.positions[0] if r.positions else 2.0) for r in mixing.mix_sources(df).collect()]
    assert order == sorted(order)


def test_mixed_documents_follow_the_plan(spark, documents):
    docs = documents.select("doc_id", "text", "source")
    plan = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    out = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    times = Counter(out)
    assert all(times[i] * r.size == r.whole_words for i, r in plan.items())
    # Whole documents are due at the positions of the plan; the one that is cut may have no position there.
    seen, due = Counter(), []
    for i in out:
        positions = plan[i].positions
        if seen[i] < len(positions):
            due.append(positions[seen[i]])
        seen[i] += 1
    assert due == sorted(due) and len(due) >= len(out) - len({r.source for r in plan.values()})
    for source in {r.source for r in plan.values()}:
        own = [r for r in plan.values() if r.source == source]
        assert abs(sum(r.whole_words for r in own) - own[0].target) <= max(r.size for r in own)


# --- token files


def test_token_files(spark, documents):
    odd = [None, "", " ", "\n", "a\nb", "a \n b", "x\t \xa0b", "é é\nß", "it's 'll  don't\n'll", "<|endoftext|> a", "a\r\nb\r\n", "end \n", "\nstart", "long " * 40000]
    texts = odd + [r.text for r in documents.collect()]
    df = frame(spark, texts).repartition(3)
    folder = work_dir(spark, "test-tokens")
    manifest = token_files.write_tokens(df, folder, queries.tokenizer_path())
    from tokenizers import Tokenizer

    plain, at = Tokenizer.from_file(queries.tokenizer_path()), 0
    for r in sorted(token_files.read_tokens(manifest, folder).collect(), key=lambda r: r.doc_id):
        ids = plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for m in manifest.collect():
        reader = token_files.open_sequences(folder, m.tokens_file)
        batches = [reader.get_batch(k) for k in range(reader.num_record_batches)]
        assert sum(b.column("mask").flatten().to_numpy(zero_copy_only=False).sum() for b in batches) == m.tokens
        assert all(b.column("ids").type.list_size == token_files.SEQUENCE for b in batches)
    assert token_files.token_output(df.limit(0), queries.tokenizer_path()).count() == 0
    twice = token_files.token_output(df.union(df).filter("doc_id < 2"), queries.tokenizer_path()).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in twice) == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (3, 1, 1)]


def test_long_texts_are_encoded_in_parts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SLICE_BYTES", 1 << 10)
    path, rng = queries.tokenizer_path(), random.Random(3)
    encoder, plain = token_files.Encoder(path), Tokenizer.from_file(path)
    pool = [" ", "\n", "\n\n", " \n ", "\u3000", "word", "Été", "中文字", "1234", "...", "'s", "\t", "<|endoftext|>", "x" * 700]
    for text in ["".join(rng.choices(pool, k=n)) for n in (1, 50, 400, 3000)] + ["y" * 9000, "\n" * 9000, ""]:
        data = np.frombuffer(text.encode(), np.uint8)
        parts = list(encoder.encode_slice(np.array([0, len(data)]), data))
        ids = np.concatenate([x for x, _ in parts])
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and parts[-1][1].tolist() == [0, len(ids)]
    monkeypatch.setattr(token_files, "MOST_PIECES", 300)
    for _ in range(60):
        text = " ".join(rng.choice(["the", "lamp", f"x{rng.randint(0, 10**6)}", "a\tb", "\u3000c", "d\x1d"]) for _ in range(rng.randint(0, 120)))
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = encoder.encode(np.array([0, len(data)]), data)
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert 0 < len(encoder._keys) < 600
    encoder.cuts = False
    texts = ["a b", "", "c\nd"]
    ids, bounds = encoder.encode(np.array([0, 3, 3, 6]), np.frombuffer("".join(texts).encode(), np.uint8))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_only_known_tokenizers_are_cut():
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = {"pre_tokenizer": level, "normalizer": None, "model": {"type": "BPE"}, "added_tokens": []}
    assert token_files.can_be_cut(plain)
    odd = [{"pre_tokenizer": level | {"add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "NFC"}}, {"model": {"type": "Unigram"}}]
    odd.append({"added_tokens": [{"content": "a b", "lstrip": False, "rstrip": False}]})
    assert not any(token_files.can_be_cut(plain | x) for x in odd)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    from folioflow.llm import shingles as hashing

    text = " ".join(["word" * (i % 7 + 1) + str(i % 13) for i in range(4000)]) + "x" * 5000 + "\n\n"
    data = np.frombuffer(text.encode(), np.uint8)
    whole = hashing.word_hashes(np.array([0, len(data)]), data)
    monkeypatch.setattr(hashing, "SLICE_BYTES", 1 << 9)
    parts = hashing.word_hashes(np.array([0, len(data)]), data)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    some = hashing.shingle_hashes(*parts)
    monkeypatch.setattr(hashing, "SLICE_BYTES", 1 << 20)
    assert (hashing.shingle_hashes(*whole)[0] == some[0]).all()


# --- URL filters


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://EXAMPLE.com/en/77?q#f", "https://a.b.net/de/x", "x://example.net/de/81", "http://notexample.com/en/7", "http://com/en/",
        "http://net/de", "http://org/es/?a", "http://m.ads-track.example.com/x", "http://xads-track.org/es", "a://b://c/en/", "http://h?x/en/", "http://example.com:80/en/7",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("html", F.lit(""))
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    for r in url_filter.judge_urls(df).collect():
        _, found, rest = (urls[r.page_id] or "").partition("://")
        host = re.split(r"[/?#]", rest)[0] if found else ""
        path = re.split(r"[?#]", rest[len(host) :])[0] if found else ""
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        blocked = "ads-track" in re.split(r"\.", host) or host.split(".")[1:2] == ["ads-track"]
        assert r.verdict == (max(fits)[2] if fits else "block" if blocked else "allow")
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_rules_in_blocks_and_from_a_table(spark, monkeypatch):
    table = spark.createDataFrame(
        [("domain", "example.com", None, "block"), ("domain", "example.com", "/ok", "allow"), ("word", "spam-farm", None, "block"), ("domain", "b.org", "/x", "block")],
        "kind string, host string, path string, verdict string",
    )
    rules = url_filter.read_rules(table)
    urls = ["http://example.com", "http://example.com?q", "http://a.example.com/x", "http://example.community/", "http://example.com/okay", "http://spam-farm.net/", "http://b.org/xy", "http://example.com:80/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    wanted = ["block", "block", "block", "allow", "allow", "block", "block", "allow"]
    for most in (500_000, 1):
        monkeypatch.setattr(url_filter, "MOST_RULES", most)
        assert [r.verdict for r in url_filter.judge_urls(df, rules).orderBy("page_id").collect()] == wanted
    assert {r.verdict for r in url_filter.judge_urls(df, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.domain_rule("a.b", "c", "block")


# --- WARC


def test_warc(spark):
    big, rows = "é" * 100, []
    rows = [(3, "u", big), (1, "u", big), (2, None, big), (4, "u", "s"), (5, "u", "s"), (6, "u", None), (7, "u\r\nX: y", "a\r\n\r\nb" * 300_000), (None, "u", big), (1, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = work_dir(spark, "test-warc")
    manifest = warc.write_warc(df, folder)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(manifest, folder).collect())
    wanted = Counter((p, len((h or "").encode()), "revisit" if h == big and p != 1 else "response", 1 if h == big and p != 1 else None) for p, _, h in rows)
    assert got == wanted
    m = manifest.filter("page_id = 7").first()
    head, body = warc.read_record(folder, m.bundle, m.frame, m.offset)
    assert head["WARC-Record-ID"] == m.record_id and body.decode() == rows[6][2]
    assert warc.archive_pages(df.limit(0)).count() == 0


# --- licences


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        (1, "a/LICENSE", f"{mit}\nmore words of the text follow here"), (2, "a/b/c.py", "code"), (3, "a/b/d.py", f"x\n{apache}\ny"), (4, "e.py", None), (5, "a/b/LICENSE.txt", apache),
        (6, "a/x.py", ""), (7, None, "code"), (8, "z/one.txt", "Licensed under CC BY-NC 4.0."), (9, "z/y/two.txt", "text under the sun"), (2, "a/b/c.py", "code"),
    ]
    df = spark.createDataFrame(files, "id long, path string, content string").withColumn("license", F.lit(1))
    got = {r.id: (r.license, r.origin, r.license_path) for r in licenses.scan_licenses(df).collect()}
    assert got == {
        1: ("MIT", "file", None), 2: ("Apache-2.0", "inherited", "a/b/LICENSE.txt"), 3: ("Apache-2.0", "header", None), 4: (None, "none", None),
        5: ("Apache-2.0", "file", None), 6: ("MIT", "inherited", "a/LICENSE"), 7: (None, "none", None), 8: ("CC-BY-NC-4.0", "file", None),
        9: ("CC-BY-NC-4.0", "inherited", "z/one.txt"),
    }
    assert licenses.scan_licenses(df).count() == len(files)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_texts_over_lines(spark):
    mit = f"The MIT License\n\nCopyright (c) 2020 A. Person\n\n{textwrap.fill(licenses._MIT + licenses._MIT_END, 72)}\n"
    body = textwrap.fill(licenses._MIT + licenses._MIT_END, 60)
    gnu = "# x.py\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\nimport os\n"
    files = [
        (1, "a/LICENSE", body), (2, "a/b/c.py", "code"), (3, "b/x.py", gnu.format(3)), (4, "b/y.py", gnu.format(2)), (5, "c/terms.txt", mit), (6, "c/d/e.py", ""),
        (7, "d/a.c", " * This work is licensed under the GNU General\n * Public License, version 3.\n int x;\n" + "int y;\n" * 40), (8, "e/a.txt", "the terms of the License and any person obtaining a copy of this story"),
        (9, "f/COPYING", textwrap.fill(licenses._BSD + licenses._BSD_NAME + licenses._BSD_END, 50)), (10, "g/COPYING", textwrap.fill(licenses._BSD + licenses._BSD_END, 50)),
    ]
    df = spark.createDataFrame(files, "id long, path string, content string")
    got = {r.id: (r.license, r.origin) for r in licenses.scan_licenses(df).collect()}
    assert got == {
        1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "header"), 4: ("GPL-2.0", "header"), 5: ("MIT", "file"), 6: ("MIT", "inherited"),
        7: ("GPL-3.0", "header"), 8: (None, "none"), 9: ("BSD-3-Clause", "file"), 10: ("BSD-2-Clause", "file"),
    }


def test_license_scores_and_ancestors_by_hand(spark):
    rng = random.Random(6)
    templates = licenses.TEMPLATES
    common = [w for _, t in templates for w in t.split()] + ["road", "lamp", "river", "stone"]
    lines = [t for _, t in templates] + [" ".join(rng.choices(common, k=rng.randint(3, 10))) for _ in range(60)]
    folders = ["", "a/", "a/b/", "a/b/c/", "d/", "d/e/f/"]
    files = []
    for i in range(120):
        name = rng.choice(["LICENSE", "x.py", "y.c", "COPYING.txt"])
        body = "\n".join(rng.choices(lines[: len(templates)] if rng.random() < 0.3 else lines[len(templates) :], k=rng.randint(0, 3)))
        files.append((i, f"{rng.choice(folders)}{i if name[0] in 'xy' else ''}{name}", body))
    split = lambda text: [w for w in (x.lower().strip(".,;:!?()[]{}\"'") for x in words(text)) if w]
    known = {w for _, t in (*templates, *licenses.BODIES) for w in split(t)}
    n = {w: sum(w in split(b) for _, _, b in files) for w in known}
    idf = {w: np.log((1 + len(files)) / (1 + n[w])) + 1 for w in known}

    def unit(some):
        bag = {w: (1 + np.log(k)) * idf.get(w, max(idf.values())) for w, k in Counter(some).items()}
        return {w: x / np.sqrt(sum(y * y for y in bag.values())) for w, x in bag.items()}

    vectors, own = [(name, unit(split(t))) for name, t in templates], {}
    for i, _, body in files:
        scores = [(sum(x * unit(split(line)).get(w, 0) for w, x in v.items()), name) for line in body.split("\n") if split(line) for name, v in vectors]
        own[i] = max(scores, default=(0, None))
    df = spark.createDataFrame(files, "id long, path string, content string")
    got = {r.id: r for r in licenses.scan_licenses(df).collect()}
    direct = {i for i, r in got.items() if r.origin in ("file", "header")}
    # Runs over line breaks may find more than single lines, never less.
    assert {i for i, (score, _) in own.items() if score >= licenses.THRESHOLD} <= direct
    assert all(got[i].score >= own[i][0] - 1e-9 for i in direct)
    granted = {}
    named = {i for i, path, _ in files if path.rpartition("/")[2] in ("LICENSE", "COPYING.txt")}
    for i, path, _ in files:
        if got[i].origin == "file" or i in named:
            folder = path.rpartition("/")[0]
            granted.setdefault(folder, []).append((i not in direct, path, -(got[i].score or 0), got[i].license if i in direct else None))
    for i, path, _ in files:
        if i not in direct:
            up = path.rpartition("/")[0]
            while up and up not in granted:
                up = up.rpartition("/")[0]
            # An unknown licence file has nothing, and where it is all that a folder has, it stops what is above.
            unknown, wanted, _, name = min(granted.get(up, [(True, None, 0, None)]), key=lambda x: x[:3])
            assert (got[i].license, got[i].license_path) == ((None, None) if unknown or i in named else (name, wanted))
    assert len(granted) > 2 and len(direct) < len(files) - 20


def test_unknown_license_files_shield_their_folder(spark):
    mit, apache = licenses._MIT + licenses._MIT_END, "Licensed under the Apache License, Version 2.0."
    own = "You may use this work if you send its author a postcard from your town and never sell it to anyone at all."
    files = [
        (1, "LICENSE", mit), (2, "a.c", "int x;"), (3, "lib/LICENSE.libbz2.txt", own), (4, "lib/b.c", "int x;"), (5, "lib/deep/c.c", "int x;"),
        (6, "both/LICENSE-APACHE", apache), (7, "both/LICENSE.other-1.1.txt", own), (8, "both/d.c", "int x;"), (9, "named/LICENSE_APACHE", apache),
        (10, "named/e.c", "int x;"), (11, "reuse/LICENSES/MIT.txt", mit), (12, "reuse/f.c", "int x;"), (13, "lib/COPYING", None), (14, "licenser/g.c", "int x;"),
    ]
    df = spark.createDataFrame(files, "id long, path string, content string")
    got = {r.id: (r.license, r.origin) for r in licenses.scan_licenses(df).collect()}
    assert {i for i, x in got.items() if x == (None, "none")} == {3, 4, 5, 7, 13}
    assert got[1] == got[11] == ("MIT", "file") and got[6] == got[9] == ("Apache-2.0", "file")
    assert got[2] == got[12] == got[14] == ("MIT", "inherited") and got[8] == got[10] == ("Apache-2.0", "inherited")


def test_thresholds_that_the_radius_does_not_cover(spark, documents):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    for threshold in (0.5, 0.69, 1.1):
        with pytest.raises(ValueError, match="threshold"):
            decontam.find_leaks(documents, benchmark, threshold)


def test_licenses_of_documents(spark, documents):
    wanted = {r.doc_id for r in documents.collect() if "icensed under" in r.text or "MIT License" in r.text}
    assert {r.doc_id for r in licenses.scan_documents(documents).collect() if r.license} == wanted


# --- n-gram join


def components(rows):
    """doc_id -> size of its set, smallest linked doc_id, and the different sets that its own links with."""
    sets, at, parent = [(i, frozenset(shingles(t))) for i, t in rows], defaultdict(list), {i: i for i, _ in rows}
    links = defaultdict(set)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, n in Counter(j for x in s for j in at[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
                if s != sets[j][1]:
                    links[s].add(sets[j][1])
                    links[sets[j][1]].add(s)
        for x in s:
            at[x].append(k)
    return {i: (len(s), find(i), len(links[s])) for i, s in sets}


def join_rows():
    rng, rows = random.Random(5), [None, "", " \n", "one two", "ONE  two", "one two three"]
    common = " ".join(f"w{rng.randint(0, 400)}" for _ in range(120)).split()
    for g in range(5):
        for _ in range(40):
            w = [f"g{g}w{i}" for i in range(60)]
            for _ in range(rng.randint(0, 3)):
                p = rng.randrange(len(w))
                w[p : p + rng.randint(0, 1)] = [f"x{rng.randint(0, 10**9)}"]
            rows.append(" ".join(w + common[: rng.randint(0, 20) * (rng.random() < 0.3)]))
    rows += [" ".join([f"c{i}" for i in range(100 - 2 * k)] + [f"n{j}" for j in range(2 * k)]) for k in range(30)]
    rows += [" ".join(common[: rng.randint(40, 60)] + [f"u{rng.randint(0, 10**9)}" for _ in range(rng.randint(5, 30))]) for _ in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("frequent", "crowd", "block", "held"), [(48, 64, 1024, 1 << 20), (3, 2, 7, 900)])
def test_ngram_join(spark, monkeypatch, frequent, crowd, block, held):
    for name, value in (("FREQUENT", frequent), ("CROWD", crowd), ("BLOCK_SETS", block), ("HELD", held)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = join_rows()
    wanted = components(list(enumerate(rows)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == wanted


def test_ngram_join_on_repeated_rows(spark):
    rows = join_rows()[:80]
    wanted, df = components(list(enumerate(rows))), frame(spark, rows)
    got = [(r.doc_id, r.component_id, r.n_links) for r in ngram_join.near_duplicates(df.union(df)).collect()]
    assert Counter(got) == Counter({(i, c, n): 2 for i, (_, c, n) in wanted.items()})
    kept = ngram_join.one_of_each(df.union(df))
    blank = [i for i, t in enumerate(rows) if not (t or "").split()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i, (_, c, _) in wanted.items() if i == c] + blank)
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_ngram_join_on_null_and_repeated_ids(spark):
    w = [f"w{i}" for i in range(60)]
    base, near, end, other = " ".join(w), " ".join([*w[:52], "x", *w[53:]]), " ".join([*w[:20], "z", *w[21:52], "x", *w[53:]]), "some other text of seven words here"
    rows = [(5, base), (None, near), (7, end), (9, other), (9, base), (None, other), (3, None), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gone", F.lit(1)).withColumn("_doc", F.lit(2)).withColumn("_row", F.lit(3))
    assert components([(0, base), (1, near), (2, end)])[2][1] == 0
    got = Counter((r.doc_id, r.component_id, r.n_links) for r in ngram_join.near_duplicates(df).collect())
    n = {i: x[2] for i, x in components([(0, base), (1, near), (2, end)]).items()}
    assert got == Counter({(5, 5, n[0]): 1, (None, 5, n[1]): 1, (7, 5, n[2]): 1, (9, 9, 0): 1, (9, 5, n[0]): 1, (None, 9, 0): 1, (3, 3, 0): 2, (None, None, 0): 1})
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(5, base), (9, other), (3, None), (3, None), (None, None)])


# --- sharding


def test_shards(spark, documents):
    docs = documents.select("doc_id", "text", F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("source"))
    docs = docs.union(docs.limit(9)).union(spark.createDataFrame([(-1, None, None), (None, "", "s")], docs.schema))
    rows = sharding.assign_shards(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    slots, mix = defaultdict(list), Counter()
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
        mix[r.source, r.shard] += 1
    sizes = [len(slots[k]) for k in range(16)]
    assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # Before a fraction x lie n * x rows of a source, give or take half a row, so a cut is off by half a row a source.
    names = {s for s, _ in mix}
    for source in names:
        own = [mix[source, k] for k in range(16)]
        assert max(abs(x - sum(own) / 16) for x in own) <= 1 + sum(own) * (len(names) + 1) / len(rows)
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, sharding.assign_shards(docs).collect()))


# --- pipeline


def test_pipeline(spark, documents):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {r.doc_id: r for r in documents.collect()}
    judged = quality.judge_quality(documents).filter("kept").select("doc_id").collect()
    good = sorted(r.doc_id for r in judged)
    groups = components([(i, docs[i].text) for i in good])
    single = [i for i in good if groups[i][1] == i]
    assert len(single) < len(good)
    found = {d for d, _ in leaks([(i, docs[i].text) for i in single], bench)}
    clean = documents.filter(F.col("doc_id").isin([i for i in single if i not in found]))
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(clean).collect())
    out = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in out.collect()) == mixed


def test_pipeline_tokens_follow_the_mix(spark, documents):
    folder = work_dir(spark, "test-mix")
    mixed = keep(mixing.mixed_documents(documents.limit(150)), f"{folder}/mix")
    files = sorted({r.f for r in mixed.select(F.col("_metadata.file_path").alias("f")).collect()})
    wanted = [x for f in files for x in duckdb.sql(f"SELECT doc_id FROM '{f.removeprefix('file://')}'").fetchall()]
    out = corpus_pipeline.token_output(spark, mixed, SF).orderBy("start").collect()
    assert [(r.doc_id,) for r in out] == wanted and len(files) > 1
    at = defaultdict(list)
    for k, (i,) in enumerate(wanted):
        at[i].append(k)
    assert [i for (i,) in wanted] != sorted(i for (i,) in wanted)
    assert max(max(v) - min(v) for v in at.values()) > 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_work_folders_have_schemes(spark, monkeypatch):
    from folioflow.llm import common, files

    assert re.match(r"[a-z]+:/", work_dir(spark, "x"))
    monkeypatch.setattr(spark.conf.__class__, "get", lambda self, key, default=None: "/plain/folder" if key == "spark.checkpoint.dir" else default)
    assert work_dir(spark, "x").startswith("file:/plain/folder/x-")
    monkeypatch.undo()
    for uri in ("/plain/folder", "nosuch://host/folder"):
        with pytest.raises(ValueError):
            files.make_folder(uri)
    folder = work_dir(spark, "gone")
    keep(spark.range(3), f"{folder}/t")
    common.drop_folder(spark, folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/t")


def test_every_operator_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))
    assert duckdb.__version__ and len(corpus_pipeline.STAGES) == 5
