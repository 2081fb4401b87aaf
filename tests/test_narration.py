import json
import math
import random
import re
import unicodedata
import uuid
import wave
import weakref
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow import constants as C
from folioflow import sinks
from folioflow.functions import text as T
from folioflow.functions import zh
from folioflow.operators import audio, navigation, readability, reports, segments, speech
from folioflow.plans import books as runs
from folioflow.plans.queries import QUERIES
from folioflow.sources import audio as audio_source
from folioflow.sources import containers
from folioflow.sources import reports as report_source


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    df = spark.createDataFrame([(1, "列车在2031/7/9停运，见第31节，票价降了8.25%。"), (2, "船上有7盏灯，渡口18:05关门。"), (3, None)], "i int, text string")
    got = {r.i: r.text for r in zh.normalize(df).collect()}
    assert got[1] == "列车在二零三一年七月九日停运，见第三十一节，票价降了百分之八点二五。"
    assert got[2] == "船上有七盏灯，渡口十八点五分关门。"
    assert got[3] is None
    assert zh.normalize(df, "off") is df
    with pytest.raises(ValueError):
        zh.normalize(df, "full")


def test_numbers(spark):
    cases = {
        0: "零", 10: "十", 12: "十二", 100: "一百", 101: "一百零一", 110: "一百一十", 1001: "一千零一", 1010: "一千零一十", 10010: "一万零十",
        100000500: "一亿零五百", 20000: "二万", 12345678: "一千二百三十四万五千六百七十八", 10**12: "一兆", 10**16: None, 9007199254740993: "九千零七兆一千九百九十二亿五千四百七十四万零九百九十三",
    }
    assert column(spark, list(cases), zh.int_to_zh, "long") == list(cases.values())
    assert column(spark, ["-3", "2.50", "", ".5"], zh.number_to_zh) == ["负三", "二点五零", "", "零点五"]


def test_numbers_are_read_once(spark):
    """The token and the value stand once in their expressions, however many digits are made of them, and short ones are said as long ones."""
    for said in (zh.number_to_zh, zh.int_to_zh):
        assert str(said(F.col("the_token"))).count("the_token") == 1
    tokens = ["0", "7", "007", "10", "0000", "9999", "10000", "-5", "-0", " 12 ", "3.25", ".5", "5.", "-1.0a2", "", " ", "1x", "12345678901234567890", "１２", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(zh.number_to_zh(F.col("t"))).collect()]
    assert got == [
        "零", "七", "七", "十", "零", "九千九百九十九", "一万", "负五", "负零", "十二", "三点二五", "零点五", "五", "负一点零二", "", "", "1x", "12345678901234567890", "１２", None,
    ]


def test_text_functions(spark):
    assert column(spark, ["nav.xhtml", "text/toc.xhtml", "contents.xhtml", "7358.xhtml", "chap_2.xhtml", "", "#a"], T.is_non_content_href) == [True] * 3 + [False] * 2 + [True] * 2
    assert column(spark, ["a/chapter12.xhtml", "my_part-2.html", "x", "o'neil_1st-ÉCOLE.v2.xhtml"], T.title_from_filename) == ["Chapter 12", "My Part 2", "X", "O'Neil 1St École.V2"]
    assert column(spark, ["FFD8FF00", "89504E470D0A1A0A", "474946383961", "00", "424D"], lambda x: T.image_suffix(F.unhex(x))) == [".jpg", ".png", ".gif", ".jpg", ".bmp"]


def _cut(text, most):
    """hard_split, the rest of the text copied at each step."""
    rest = text.strip()
    while len(rest) > most:
        cut = max((i + 1 for i in range(most) if rest[i] in C.BREAKS), default=most)
        head = rest[:cut].strip()
        if not head:
            cut, head = most, rest[:most]
        tail = rest[cut:].lstrip()
        if tail and len(head) + len(tail) <= most and set(tail) <= set(C.BREAKS):
            yield head + tail
            return
        yield head
        rest = tail
    if rest:
        yield rest


def test_segments_keep_the_limit(spark):
    assert [len(x) for x in segments.pack("春" * 1500, 600)] == [600, 600, 300]
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab 。，.!?\n春天") for _ in range(rng.randint(0, 300)))
        for cut in (segments.pack, segments.hard_split):
            out = list(cut(text, 40))
            assert all(0 < len(x) <= 40 for x in out)
            assert "".join("".join(out).split()) == "".join(text.split())
        assert list(segments.hard_split(text, 17)) == list(_cut(text, 17))
    assert segments.tight("One, two (three) $5 a_ b. C") == "One,two (three)$5 a_ b.C"
    assert list(segments.pack("ab. cd. ef", 3, lambda text: re.findall(r"\S+ ?", text))) == ["ab.", "cd.", "ef"]
    long = "word " * 200_000
    assert "".join(segments.hard_split(long, 50)).replace(" ", "") == "word" * 200_000
    df = spark.createDataFrame([(1, None), (2, " "), (3, "Hello there.")], "doc_id long, text string")
    assert [(r.doc_id, r.segment) for r in segments.segments(df).collect()] == [(3, "Hello there.")]
    with pytest.raises(ValueError):
        segments.segments(df, 0)


def test_navigation(spark):
    nav = spark.createDataFrame(
        [("b", 1, "T", "toc.xhtml"), ("b", 2, "One", "c1.xhtml#a"), ("b", 3, "Again", "C1.xhtml"), ("b", 4, "Two", "c2.xhtml")],
        "book string, pos int, title string, href string",
    )
    rows = navigation.content_chapters(nav)
    assert [r.title for r in rows.orderBy("pos").collect()] == ["One", "Two"]
    assert [r.title for r in navigation.limited(rows, 1).collect()] == ["One"]
    assert [r.progress_pct for r in navigation.with_progress(rows).orderBy("pos").collect()] == [0.0, 50.0]
    items = spark.createDataFrame([("b", "c1.xhtml", "body"), ("b", "c2.xhtml#x", "no")], "book string, href string, content string")
    assert [r.html for r in navigation.with_bodies(rows, items).orderBy("pos").collect()] == ["body", None]
    with pytest.raises(ValueError):
        navigation.limited(rows, 0)


OPF = """<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A</dc:title>
<dc:title>B</dc:title><dc:creator>C</dc:creator><meta name="cover" content="img"/></metadata><manifest>
<item id="img" href="pic.png" media-type="image/png"/><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/>{nav}</manifest></package>"""
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text> One </text></navLabel><content src="c1.xhtml"/>
<navPoint><navLabel><text>Inner</text></navLabel><content src="c1.xhtml#in"/></navPoint></navPoint></navMap></ncx>"""
NAV = """<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><nav><a href="x.xhtml">no</a></nav>
<nav epub:type="toc"><a href="c1.xhtml">O<b>ne</b></a></nav></html>"""


def container(path, nav_item, files, opf=OPF):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", opf.format(nav=nav_item))
        for name, body in {"O/pic.png": b"\x89PNG", "O/c1.xhtml": "<p>x</p>", **files}.items():
            z.writestr(name, body)


def test_containers(spark, tmp_path):
    container(tmp_path / "two.epub", '<item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/>', {"O/t.ncx": NCX})
    container(tmp_path / "three.epub", '<item id="n" href="nav3.xhtml" media-type="application/xhtml+xml"/>', {"O/nav3.xhtml": NAV})
    container(tmp_path / "none.epub", "", {})
    (tmp_path / "bad.epub").write_text("no zip")
    books = containers.read_containers(spark, f"{tmp_path}/*.epub")
    short = F.element_at(F.split("book", "/"), -1)
    items = containers.items(books)
    versions = {r[0]: r[1] for r in containers.navigation_item(items).select(short, "version").collect()}
    assert versions == {"two.epub": "EPUB2", "three.epub": "EPUB3"}
    chapters = {(r[0], r.title, r.href) for r in containers.chapters(books).select(short, "title", "href").collect()}
    assert chapters == {("two.epub", "One", "c1.xhtml"), ("three.epub", "One", "c1.xhtml"), ("none.epub", "C1", "c1.xhtml")}
    meta = containers.metadata(books)
    assert {r.title for r in containers.joined_metadata(meta, "title").collect()} == {"A / B"}
    assert {(r[0], r.href) for r in containers.covers(items, meta).select(short, "href").collect()} == {(b, "pic.png") for b in ("two.epub", "three.epub", "none.epub")}


def test_covers_by_each_way(spark):
    rows = [
        ("p", 0, "a", "x.png", "image/png", "cover-image"), ("m", 0, "pic", "y.png", "image/png", ""), ("i", 0, "cover", "z.png", "image/png", ""),
        ("n", 0, "q", "my-Cover.jpg", "image/jpeg", ""), ("none", 0, "q", "r.jpg", "image/jpeg", ""), ("text", 0, "cover", "cover.xhtml", "application/xhtml+xml", ""),
    ]
    items = spark.createDataFrame([(*r, b"1") for r in rows], containers.ITEMS)
    meta = spark.createDataFrame([("m", 0, "cover", "pic")], containers.META)
    assert {r.book: r.href for r in containers.covers(items, meta).collect()} == {"p": "x.png", "m": "y.png", "i": "z.png", "n": "my-Cover.jpg"}


def test_book_without_documents(spark):
    items = spark.createDataFrame([("b", "pic.png", "image/png"), ("c", "pic.png", "image/png")], "book string, href string, media_type string")
    titles = spark.createDataFrame([("b", "The Book")], "book string, title string")
    got = {r.book: r.title for r in navigation.virtual_navigation(items, titles=titles).collect()}
    assert got == {"b": "The Book", "c": "Content"}
    raw = spark.createDataFrame([(bytearray("é".encode() + b"\xff\xfex"),), (bytearray(b"ok"),), (None,)], "x binary")
    assert [r[0] for r in raw.select(navigation.as_text(F.col("x"))).collect()] == ["éx", "ok", None]


STORY = "<h1>Chapter {n}</h1><p>The lamp was still burning, so they sat down and read the letter again. Nobody said a word.</p>"
TWO = """<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Lamps</dc:title>
<dc:creator>W. Light</dc:creator></metadata><manifest><item id="c1" href="one.xhtml" media-type="application/xhtml+xml"/>
<item id="c2" href="two.xhtml" media-type="application/xhtml+xml"/><item id="c3" href="zero.xhtml" media-type="application/xhtml+xml"/>{nav}</manifest></package>"""


def test_conversion(spark, tmp_path):
    container(tmp_path / "a.epub", "", {"O/one.xhtml": STORY.format(n=1), "O/two.xhtml": STORY.format(n=2), "O/zero.xhtml": "<p> </p>"}, TWO)
    calls = tmp_path / "calls"
    calls.mkdir()

    def speak(text):
        (calls / uuid.uuid4().hex).write_text(text)
        return speech.tone(text)

    out = runs.convert(containers.read_containers(spark, f"{tmp_path}/*.epub"), speak, segment_chars=60)
    documents = {r.title: r for r in out.documents.collect()}
    assert set(documents) == {"One", "Two", "Zero"} and documents["Zero"].cleaned_chars == documents["Zero"].total_blocks == 0
    assert [documents[x].audio_generated for x in ("One", "Two", "Zero")] == [True, True, False]
    assert documents["One"].text.startswith("Chapter 1\nThe lamp") and documents["One"].kept_blocks == 2
    parts = out.segments.filter(F.col("chapter_key").startswith("1#")).orderBy("pos").collect()
    assert len(parts) > 1 and all(len(r.segment) <= 60 for r in parts)
    spoken = {r.chapter: r for r in out.spoken.collect()}
    assert set(spoken) == {1, 2} and spoken[1].file == "chapter_001_One.wav"
    assert len(spoken[1].samples) == sum(len(r.segment) * 80 for r in parts)
    runs.write_audio(out, f"{tmp_path}/audio")
    with wave.open(f"{tmp_path}/audio/a/chapter_001_One.wav") as w:
        assert (w.getnframes(), w.getframerate()) == (len(spoken[1].samples), 8000)
    summary = out.summary.first()
    assert (summary.planned_chapter_count, summary.generated_audio_count, summary.empty_chapter_count) == (3, 2, 1)
    assert summary.order_consistent and len(summary.documents) == 3
    text = out.markers.first().markers
    assert "title=Lamps" in text and "artist=W. Light" in text and text.count("[CHAPTER]") == 2
    assert out.audio_qc.count() == 2 and out.covers.count() == 0
    assert sorted(p.read_text() for p in calls.iterdir()) == sorted(r.segment for r in out.segments.collect())  # each once
    assert {r.chapter for r in runs.chapter_texts(containers.read_containers(spark, f"{tmp_path}/*.epub"), 1).collect()} == {1}


def test_retries():
    waits, calls = [], []

    def failing(errors):
        def call(text):
            calls.append(text)
            if len(calls) <= len(errors):
                raise errors[len(calls) - 1]
            return len(text)

        return call

    assert speech.retrying(failing([speech.ServiceError(503), TimeoutError()]), wait=waits.append)("abc") == 3
    assert waits == [2.0, 4.0] and len(calls) == 3
    for errors, most in (([speech.ServiceError(404)], 1), ([ConnectionError()] * 9, 3)):
        calls.clear()
        with pytest.raises((speech.ServiceError, ConnectionError)):
            speech.retrying(failing(errors), wait=waits.append)("x")
        assert len(calls) == most
    with pytest.raises(ValueError):
        speech.retrying(len, 0)


def test_rounding_is_that_of_python(spark):
    values = [1 / 128, 41 / 640, 0.0005, 2.5, -0.0015, -2.5, 1e-9, 0.0, None, *(k / n for n in range(1, 200) for k in range(0, n, 7))]
    for digits in (3, 6):
        assert column(spark, values, lambda x: T.rounded(x, digits), "double") == [None if v is None else round(v, digits) for v in values]
    assert column(spark, [1], lambda x: T.ratio(x, F.lit(128)), "long") == [0.007812]


def test_readability_of_odd_texts(spark):
    rng = random.Random(11)
    pool = ["a", "word", " ", "\n", "\r\n", "\u2028", "\x1c", "\x0b", "\u3000", "。", "！", "?", "；", ";", "\ufdd0", "12", "²", "***", "\ufffd", "é"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(400)] + [None, "", "x" * 300, " 。 "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in readability.readability(df).collect():
        text = (texts[r.i] or "").strip()
        lengths = [len(x.strip()) for x in re.findall(r"[^\n。！？!?；;]+[。！？!?；;]?", text) if x.strip()] or ([len(text)] if text else [])
        assert (r.sentence_count, r.max_sentence_length) == (len(lengths), max(lengths, default=0)), repr(text)
        assert r.avg_sentence_length == round(sum(lengths) / max(len(lengths), 1), 3)
        assert r.paragraph_count == sum(1 for x in text.splitlines() if x.strip()), repr(text)
        assert r.numeric_char_count == sum(c.isdigit() for c in text)
        assert r.abnormal_symbol_count == sum(map(len, re.findall("[*#=_~]{3,}|\ufffd", text)))


def test_digits_of_all_kinds(spark):
    some = "".join(chr(c) for c in range(0x3000) if chr(c).isdigit()) + "\U0001f100\U00010a40 Ⅷ½一 x"
    got = readability.readability(spark.createDataFrame([(some,)], "text string")).first()
    assert got.numeric_char_count == sum(c.isdigit() for c in some.strip()) and unicodedata.unidata_version


def test_sample_widths_and_channels(spark, tmp_path):
    left, right = [0.5, -0.5, 0.25], [0.0, 0.5, 0.25]
    for width in (1, 2, 3, 4):
        flat = [round(x * 2 ** (8 * width - 1)) + (128 if width == 1 else 0) for pair in zip(left, right, strict=True) for x in pair]
        with wave.open(str(tmp_path / f"w{width}.wav"), "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(width)
            w.setframerate(8000)
            w.writeframes(b"".join((x & (2 ** (8 * width) - 1)).to_bytes(width, "little") for x in flat))
    files = audio_source.list_audio(spark, str(tmp_path))
    names = sorted(r.file for r in files.collect())
    rms = round(20 * math.log10(math.sqrt((0.25**2 + 0 + 0.25**2) / 3)), 3)
    for r in audio.signal_metrics(audio_source.decode_audio(files)).collect():
        assert (r.channels, r.sample_count, r.peak_dbfs, r.rms_dbfs) == (2, 3, round(20 * math.log10(0.25), 3), rms)
    assert {(r.channels, r.frames) for r in audio_source.header_durations(files).collect()} == {(2, 3)}
    report = runs.build_audio_qc(spark, str(tmp_path)).first()
    assert (report.file_count, report.failed_file_count) == (4, 0) and [x.file for x in report.files] == names


def test_audio_files(spark, tmp_path):
    rate, quiet = 24000, np.zeros(2400)
    tone = 0.3 * np.sin(2 * np.pi * 440 * np.arange(4800) / rate)
    (tmp_path / "good.wav").write_bytes(audio_source.encode_pcm16(np.concatenate([quiet, tone, quiet]), rate))
    (tmp_path / "bad.wav").write_text("no audio")
    (tmp_path / "other.txt").write_text("x")
    decoded = audio_source.decode_audio(audio_source.list_audio(spark, str(tmp_path)))
    metrics = audio.signal_metrics(decoded)
    good = metrics.filter("error is null").first()
    assert good.duration_seconds == 0.4 and good.leading_silence_seconds > 0.05 and good.trailing_silence_seconds > 0.05
    total = audio.qc_rollup(metrics).first()
    assert (total.file_count, total.analyzed_file_count, total.failed_file_count) == (2, 1, 1)


def test_assembly(spark):
    rows = [(1, 0, [0.0] * 160, 16000), (1, 1, [0.5] * 480, 48000), (1, 2, None, None), (2, 0, [1.0, -1.0], 8000)]
    df = spark.createDataFrame(rows, "doc int, pos int, samples array<float>, sample_rate int")
    out = {r.doc: r for r in audio.assemble(df, "doc").collect()}
    assert (out[1].sample_rate, len(out[1].samples), len(out[2].samples)) == (16000, 320, 2)
    assert abs(out[1].samples[-80] - 0.5) < 1e-6
    two = spark.createDataFrame([([1.0, 0.0, 0.5, 0.5],)], "x array<double>")
    assert two.select(audio.mono(F.col("x"), F.lit(2)).alias("m")).first().m == [0.5, 0.5]
    silent = spark.createDataFrame([([0.0, 0.0],), ([],), ([0.1, -0.1],)], "samples array<double>")
    assert [r[0] for r in silent.select(audio.is_silent()).collect()] == [True, True, False]


def test_spoken_audio_is_passed_on_in_pieces(spark):
    """A task with many segments never holds the audio of all: each one's first sample tells how many are held."""
    size, held = 1 << 14, []

    def speak(text):
        if text == "none":
            return None
        held[:] = [x for x in held if x() is not None]
        out = np.full(size, len(held), np.float32)
        held.append(weakref.ref(out))
        return out

    rows = spark.range(600).coalesce(1).selectExpr("id", "CASE WHEN id % 100 = 99 THEN 'none' ELSE string(id) END AS segment")
    got = audio.synthesize(rows, speak, 16000).selectExpr("id", "segment", "size(samples) AS n", "samples[0] AS held", "sample_rate").collect()
    assert [r.id for r in got] == list(range(600)) and {r.sample_rate for r in got} == {16000}
    assert all(r.segment == "none" if r.n is None else (r.segment, r.n) == (str(r.id), size) for r in got)
    assert max(r.held or 0 for r in got) * size <= 3 * audio.HELD


def test_durations_read_no_sample(spark, tmp_path):
    """The length of audio needs the size of its array only, no pass over the samples, and segments are dealt out by number."""
    rows = spark.createDataFrame(
        [(1, [0.5] * 7, 2), (2, [0.5], 2), (3, [], 2), (4, [0.5] * 3, 1), (5, None, 1), (6, [0.5] * 9, 4)], "id int, samples array<float>, channels int"
    ).withColumn("sample_rate", F.lit(2))
    for given, wanted in ((rows, {1: 3, 2: 1, 3: 0, 4: 3, 5: None, 6: 2}), (rows.drop("channels"), {1: 7, 2: 1, 3: 0, 4: 3, 5: None, 6: 9})):
        out = audio.signal_metrics(given).select("id", "sample_count", "duration_seconds")
        assert {r.id: r.sample_count for r in out.collect()} == wanted
        assert "_abs" not in out._jdf.queryExecution().optimizedPlan().toString()
    text = "One or two words, then a mark. " * 9
    spark.createDataFrame([(1 + (t > 98), t, "user", text) for t in range(100)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = QUERIES["synthesized_durations"](spark, str(tmp_path))
    said = {r.conv_id: r for r in out.collect()}
    assert said[1].segments > 200 and said[2].segments == 3 and said[1].seconds > 99 * said[2].seconds
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and "MapInPandas" not in plan


def test_timeline_and_markers(spark):
    df = spark.createDataFrame([("b", 1, "One", 1.5), ("b", 2, "T=wo", 2.25)], "book string, idx int, title string, duration_seconds double")
    timed = audio.timeline(df)
    assert [(r.start_ms, r.end_ms) for r in timed.orderBy("idx").collect()] == [(0, 1500), (1500, 3750)]
    titles = spark.createDataFrame([("b", "A / B", None)], "book string, title string, creator string")
    text = sinks.chapter_markers(timed, titles).first().markers
    assert text.startswith(";FFMETADATA1\ntitle=A / B\n[CHAPTER]\n") and "title=T\\=wo" in text and "START=1500\nEND=3750" in text


def test_report_folder(spark, tmp_path):
    (tmp_path / "one.cleaning_report.json").write_text('{"raw_chars": 10, "kept_chars": 7, "removed_samples": [{"reason": "noise_pattern"}]}')
    (tmp_path / "one.cleaned.txt").write_text("1234567")
    reports_df = report_source.read_reports(spark, str(tmp_path))
    filled = reports.fallback_reasons(reports_df).withColumn("book", F.lit("b")).withColumn("idx", F.lit(1)).withColumn("href", F.col("name"))
    chapter = reports.chapter_reports(filled)
    row = chapter.first()
    assert (row.removed_chars, row.retention_ratio, row.char_metrics_estimated) == (3, 0.7, True)
    assert row.reason_counts == row.removed_reason_counts == {"noise_pattern": 1}
    assert reports.book_summary(chapter).first().document_count == 1
    first = reports.merged_reasons(chapter, "reason_counts").first()
    assert (first.reason, first.blocks) == ("noise_pattern", 1)
    (tmp_path / "two.cleaning_report.json").write_text(json.dumps({"strictness": "aggressive", "total_blocks": 4, "reason_counts": {"content_like": 3}}))
    (tmp_path / "summary.json").write_text('{"book": "Old Name"}')
    whole = runs.build_summary(spark, str(tmp_path)).first()
    assert (whole.book, whole.document_count, whole.total_blocks, whole.duplicate_name_count, whole.strictness) == ("Old Name", 2, 4, 0, None)
    assert whole.reason_counts == {"content_like": 3, "noise_pattern": 1} and [x.href for x in whole.documents] == ["one", "two"]
    assert reports.first_value(chapter.withColumn("idx", F.lit(1)), "href").first().href == "one"
    summaries = report_source.earlier_summary(spark.createDataFrame([('{"book": "x"}',), ("no json",)], "value string"))
    assert [r.book for r in summaries.collect()] == ["x", None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1)], "book string, n int")
    sinks.write_json(df, f"{tmp_path}/json", "book")
    assert spark.read.json(f"{tmp_path}/json").first().n == 1
    assert json.loads(sinks.as_json(df, "book").first().value) == {"book": "b", "n": 1}
    wav = audio_source.with_wav(spark.createDataFrame([("a.wav", [0.1, 0.2], 8000)], "name string, samples array<double>, sample_rate int"))
    sinks.write_files(wav, f"{tmp_path}/wav", "name", "wav")
    assert audio_source.decode_pcm((tmp_path / "wav" / "a.wav").read_bytes())[0] == 8000


def test_blocks_stream(spark, tmp_path):
    from folioflow.operators.blocks import html_blocks
    from folioflow.streaming.pages import append_blocks, page_stream

    schema = "page_id long, url string, html string"
    for k in range(2):
        rows = [(10 * k + i, "u", f"<p>one {k}</p><h2>two {i}</h2><p>cut <b") for i in range(3)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        append_blocks(page_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    pages = spark.read.parquet(f"{tmp_path}/in")
    assert got == sorted(tuple(r) for r in html_blocks(pages).collect()) and len(got) == 18
    assert "Exchange" not in html_blocks(pages)._jdf.queryExecution().executedPlan().toString()


def test_stream(spark, tmp_path):
    from folioflow.streaming.pages import append_reports, page_stream

    spark.createDataFrame([(1, "u", "<p>42</p>"), (2, "u", "<p>A whole sentence, really!</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/in")
    append_reports(page_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert {(r.page_id, r.kept_blocks) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 0), (2, 1)}
