"""Named queries over a folder of tables, and the same in DuckDB SQL.

Tables take the roles of the document model: pages are chapter bodies, documents
cleaned texts (source is the book, doc_id the order), conversations ordered
chapters, embeddings audio frames; events, orders, part and lineitem give dates,
numbers and lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..functions import zh
from ..operators import audio, blocks, clean, long_audio, navigation, readability, reports, segments
from ..functions.order import numbered
from ..operators.classify import classify, features, first_pass, judged_blocks, second_pass, together, with_levels
from .. import sinks
from ..session import ship_package
from . import sql as S

LEVELS = tuple(C.LEVELS)
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, python: bool = False):
    """Register a query, with its SQL if there is any; python: it runs Python functions on the executors."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if python:
                ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "html")


def _judged(spark, sf_dir, levels=LEVELS):
    return judged_blocks(blocks.html_blocks(_pages(spark, sf_dir)), levels)


@query(S.HTML_TOKENS)
def html_tokens_by_kind(spark, sf_dir):
    tokens = blocks.html_tokens(_pages(spark, sf_dir))
    return tokens.groupBy("kind", "name").agg(F.count("*").alias("tokens"), F.sum(F.length("token")).alias("chars"))


@query(S.BLOCKS + "SELECT * FROM blocks")
def html_blocks(spark, sf_dir):
    out = blocks.html_blocks(_pages(spark, sf_dir))
    return out.withColumn("block_index", F.col("block_index").cast("long"))


@query(S.BLOCKS + "SELECT tag, count(*) AS blocks, sum(total_chars)::BIGINT AS chars, sum(link_chars)::BIGINT AS link_chars FROM blocks GROUP BY tag")
def blocks_by_tag(spark, sf_dir):
    rows = blocks.html_blocks(_pages(spark, sf_dir)).groupBy("tag")
    return rows.agg(F.count("*").alias("blocks"), F.sum("total_chars").alias("chars"), F.sum("link_chars").alias("link_chars"))


@query(S.REGEX_BLOCKS)
def regex_blocks_fallback(spark, sf_dir):
    return blocks.regex_blocks(_pages(spark, sf_dir)).select("page_id", F.col("block_index").cast("long").alias("block_index"), "text", "total_chars")


FEATURES = ["page_id", "block_index", "text", "n_chars", "link_density", "punct_density", "stopword_density", "noise", "heading_like", "n_words"]


@query(S.FEATURES + f"SELECT {', '.join(FEATURES)} FROM features")
def block_features(spark, sf_dir):
    out = features(blocks.html_blocks(_pages(spark, sf_dir)))
    return out.withColumn("block_index", F.col("block_index").cast("long")).select(*FEATURES)


@query(S.CLASSIFIED + "SELECT page_id, block_index, strictness, score, classification, reason FROM classified")
def block_classification(spark, sf_dir):
    out = classify(with_levels(features(blocks.html_blocks(_pages(spark, sf_dir))), LEVELS))
    return out.select("page_id", F.col("block_index").cast("long").alias("block_index"), "strictness", "score", "classification", "reason")


@query(S.JUDGED + "SELECT page_id, strictness, block_index, classification, reason, keep FROM judged")
def context_reclassification(spark, sf_dir):
    out = _judged(spark, sf_dir)
    return out.select("page_id", "strictness", F.col("block_index").cast("long").alias("block_index"), "classification", "reason", "keep")


@query(S.JUDGED + S.CLEANED)
def cleaned_text(spark, sf_dir):
    return clean.cleaned_text(_judged(spark, sf_dir))


@query(S.JUDGED + S.REPORT)
def cleaning_report(spark, sf_dir):
    return clean.cleaning_report(_judged(spark, sf_dir))


@query(S.JUDGED + "SELECT page_id, strictness, reason, count(*) AS blocks FROM judged GROUP BY ALL")
def reason_histogram(spark, sf_dir):
    return clean.reason_counts(_judged(spark, sf_dir))


@query(S.JUDGED + "SELECT page_id, strictness, reason, count(*) AS blocks FROM judged WHERE NOT keep GROUP BY ALL")
def removed_reason_histogram(spark, sf_dir):
    return clean.reason_counts(_judged(spark, sf_dir), removed_only=True)


@query(S.JUDGED + S.samples("NOT keep"))
def first20_removed_samples(spark, sf_dir):
    return clean.samples(_judged(spark, sf_dir), False).select("page_id", "strictness", F.col("place").cast("long").alias("place"), F.col("block_index").cast("long").alias("block_index"), "text", "reason", "score", "stopword_density")


@query(S.JUDGED + S.samples("keep"))
def first20_kept_samples(spark, sf_dir):
    return clean.samples(_judged(spark, sf_dir), True).select("page_id", "strictness", F.col("place").cast("long").alias("place"), F.col("block_index").cast("long").alias("block_index"), "text", "reason", "score", "stopword_density")


@query(S.JUDGED + "SELECT strictness, count(*) AS blocks, count(*) FILTER (WHERE keep) AS kept, coalesce(sum(length(text)) FILTER (WHERE keep), 0)::BIGINT AS kept_chars FROM judged GROUP BY strictness")
def strictness_comparison(spark, sf_dir):
    rows = _judged(spark, sf_dir).groupBy("strictness")
    size = F.sum(F.when(F.col("keep"), F.length("text")))
    return rows.agg(F.count("*").alias("blocks"), F.count_if("keep").alias("kept"), F.coalesce(size, F.lit(0)).alias("kept_chars"))


@query(S.JUDGED + S.NESTED)
def cleaning_report_nested(spark, sf_dir):
    """The nested report's totals, samples and maps, a row for each entry."""
    report = clean.full_report(_judged(spark, sf_dir, (C.DEFAULT_LEVEL,)))
    entry = lambda part, item, n, text: F.struct(F.lit(part).alias("part"), item.alias("item"), n.cast("long").alias("n"), text.alias("text"))
    none = F.lit(None).cast("string")
    counts = [entry("total", F.lit(c), F.col(c), none) for c in ("total_blocks", "kept_blocks", "raw_chars", "removed_chars")]
    sampled = lambda c: F.transform(c, lambda x: entry(c, x["reason"], x["block_index"], x["text"]))
    counted = lambda c: F.transform(F.map_entries(c), lambda x: entry(c, x["key"], x["value"], none))
    lists, maps = map(sampled, ("removed_samples", "kept_samples")), map(counted, ("removed_reason_counts", "reason_counts"))
    return report.select("page_id", "strictness", F.explode(F.concat(F.array(*counts), *lists, *maps)).alias("e")).select("page_id", "strictness", "e.*")


def _lines(spark, sf_dir):
    """Lines of the kinds that contents pages have, from part and lineitem."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("n"))
    pick = F.col("id") % 8
    line = (
        F.when(pick == 0, F.concat(F.lit("Chapter "), F.col("n").cast("string")))
        .when(pick == 1, F.concat(F.lit("Chapter "), F.col("n").cast("string"), F.lit(" ..... "), F.col("id").cast("string")))
        .when(pick == 2, F.concat(F.lit("第"), F.col("n").cast("string"), F.lit("章 …… 12")))
        .when(pick == 3, F.col("n").cast("string"))
        .when(pick == 4, F.concat(F.lit("第三章 "), F.col("name")))
        .when(pick == 5, F.lit("======"))
        .when(pick == 6, F.concat(F.lit("Page "), F.col("n").cast("string")))
        .otherwise(F.col("name"))
    )
    return parts.select("id", line.alias("line"))


@query(S.LINES + f"SELECT id, line, {S.noise('line')} AS noise FROM lines")
def noise_lines(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("noise", T.is_noise(F.col("line")))


@query(S.LINES + f"SELECT id, line, {S.heading('line')} AS heading FROM lines")
def standalone_headings(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("heading", T.is_standalone_heading(F.col("line")))


READABILITY = [
    "paragraph_count", "sentence_count", "avg_sentence_length", "p95_sentence_length", "max_sentence_length", "overlong_sentence_count",
    "overlong_sentence_ratio", "abnormal_symbol_count", "abnormal_symbol_ratio", "numeric_token_count", "numeric_char_count",
    "numeric_char_ratio",
]


def _chapters(spark, sf_dir):
    """Reports of documents as chapters of their sources; measured first, so that only narrow rows are numbered."""
    docs = table(spark, sf_dir, "documents")
    href = F.concat(F.lit("text/"), (F.col("doc_id") % 97).cast("string"), F.lit(".xhtml"))
    rows = docs.select(F.col("source").alias("book"), href.alias("href"), "doc_id", "text", F.col("n_chars").alias("raw_chars"))
    return numbered(reports.chapter_reports(rows).drop("text"), "book", "doc_id", "idx")


@query(S.READABILITY + f"SELECT doc_id, {', '.join(READABILITY)} FROM readability")
def readability_metrics(spark, sf_dir):
    return readability.readability(table(spark, sf_dir, "documents")).select("doc_id", *READABILITY)


@query(S.READABILITY + "SELECT doc_id, p95_sentence_length FROM readability")
def p95_sentence_length(spark, sf_dir):
    return readability.readability(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "p95_sentence_length")


ROLLUP = [
    "document_count", "total_cleaned_chars", "total_sentence_count", "total_overlong_sentence_count", "total_abnormal_symbol_count",
    "total_numeric_char_count", "max_sentence_length", "empty_chapter_count", "ultra_short_chapter_count", "duplicate_href_count",
    "order_consistent", "avg_sentence_length", "abnormal_symbol_ratio",
]


@query(S.READABILITY + S.ROLLUP)
def book_rollup(spark, sf_dir):
    return reports.book_rollup(_chapters(spark, sf_dir)).select("book", *ROLLUP)


@query(S.READABILITY + S.INTEGRITY)
def chapter_integrity(spark, sf_dir):
    out = reports.book_rollup(_chapters(spark, sf_dir))
    return out.select("book", "document_count", "empty_chapter_count", "ultra_short_chapter_count", "duplicate_href_count", "order_consistent")


@query(S.READABILITY + S.FALSE_KEEP)
def false_keep_candidates(spark, sf_dir):
    out = reports.candidates(_chapters(spark, sf_dir), reports.is_false_keep())
    return out.select("book", "doc_id", F.col("place").cast("long").alias("place"), "abnormal_symbol_ratio", "numeric_char_ratio")


@query(S.JUDGED + S.FALSE_DROP)
def false_drop_candidates(spark, sf_dir):
    report = clean.cleaning_report(_judged(spark, sf_dir)).withColumnRenamed("page_id", "idx")
    out = reports.candidates(report, reports.is_false_drop(), "strictness")
    return out.select("strictness", F.col("idx").alias("page_id"), F.col("place").cast("long").alias("place"), "retention_ratio", "removed_chars")


@query(S.READABILITY + """SELECT coalesce(quality, -1)::INTEGER AS quality, count(*) AS documents, sum(abnormal_symbol_count)::BIGINT AS abnormal_symbols
    FROM readability r LEFT JOIN labels l ON r.doc_id = l.doc_id GROUP BY 1""")
def labelled_quality_vs_cleaning(spark, sf_dir):
    out = readability.readability(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = out.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    quality = F.coalesce("quality", F.lit(-1)).cast("int").alias("quality")
    return out.groupBy(quality).agg(F.count("*").alias("documents"), F.sum("abnormal_symbol_count").alias("abnormal_symbols"))


def _hrefs(spark, sf_dir):
    """References made of page addresses, with repeats, fragments and contents pages."""
    name = F.element_at(F.array(*map(F.lit, ("chap_1.xhtml", "nav.xhtml", "Text/TOC.xhtml", "Table_of_Contents.html", "7358.xhtml", "my-toc-2.html", "cover.html"))), (F.col("page_id") % 7 + 1).cast("int"))
    last = F.element_at(F.split("url", "/"), -1)
    href = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("OEBPS/"), name, F.lit("#x"))).when(F.col("page_id") % 3 == 1, name).otherwise(last)
    return table(spark, sf_dir, "pages").select((F.col("page_id") % 11).alias("book"), F.col("page_id").alias("pos"), href.alias("href"))


@query(S.HREFS + f"SELECT pos, href, {S.NON_CONTENT} AS non_content FROM hrefs")
def non_content_hrefs(spark, sf_dir):
    return _hrefs(spark, sf_dir).select("pos", "href", T.is_non_content_href(F.col("href")).alias("non_content"))


@query(S.HREFS + f"SELECT book, pos, href FROM hrefs WHERE NOT {S.NON_CONTENT} QUALIFY row_number() OVER (PARTITION BY book, {S.HREF_KEY} ORDER BY pos) = 1")
def nav_first_occurrence(spark, sf_dir):
    return navigation.content_chapters(_hrefs(spark, sf_dir)).select("book", "pos", "href")


@query("SELECT conv_id, turn, chapter FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chapter FROM conversations) WHERE chapter <= 3")
def max_chapters_per_book(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return navigation.limited(rows, 3, "conv_id", "turn").withColumn("chapter", F.col("chapter").cast("long"))


@query(S.PROGRESS)
def progress_percent(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return navigation.with_progress(rows, "conv_id", "turn")


@query(S.TITLES)
def title_from_filename(spark, sf_dir):
    name = F.concat(F.lit("text/"), F.translate("p_name", " ", "_"), F.lit("_o'neil-1st-chapter"), F.col("p_size").cast("string"), F.lit(".xhtml"))
    return table(spark, sf_dir, "part").select("p_partkey", T.title_from_filename(name).alias("title"))


@query("""SELECT p_partkey, 'chapter_' || lpad(p_size::VARCHAR, 3, '0') || '_' || substr(regexp_replace(p_name || ': "' || p_brand || '" <' || p_type || '>|?*/', '[<>:"/|?*]', '_', 'g'), 1, 50) AS path FROM part""")
def sanitized_path(spark, sf_dir):
    title = F.concat("p_name", F.lit(': "'), "p_brand", F.lit('" <'), "p_type", F.lit(">|?*/"))
    return table(spark, sf_dir, "part").select("p_partkey", T.chapter_file(F.col("p_size"), title).alias("path"))


@query("SELECT o_orderkey, translate(strftime(o_orderdate, '%Y'), '0123456789', '零一二三四五六七八九') AS spoken FROM orders")
def year_to_zh(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", zh.digits_to_zh(F.date_format("o_orderdate", "yyyy")).alias("spoken"))


@query(S.INT_TO_ZH)
def int_to_zh(spark, sf_dir):
    factor = F.element_at(F.array(*[F.lit(x).cast("long") for x in (1, 10, 1000, 10007, 99999999977)]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    value = F.col("o_orderkey") * factor % 10**16
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"), zh.int_to_zh(value).alias("spoken"))


@query(S.NORMALIZED)
def normalize_texts(spark, sf_dir):
    d = lambda f: F.date_format("o_orderdate", f)
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit("列车在"), d("yyyy-MM-dd"), F.lit("停运，见第"), (key % 100).cast("string"), F.lit("节，票价降了"), (key % 90).cast("string"),
        F.lit(".25%。\n\n  船上有"), (key % 7).cast("string"), F.lit("盏灯，渡口18:05关门。  "),
    )
    return zh.normalize(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")))


@query(S.HARD_SPLIT, python=True)
def hard_split_segments(spark, sf_dir):
    out = segments.hard_segments(table(spark, sf_dir, "documents"), 200)
    return out.withColumn("pos", F.col("pos").cast("long"))


@query(S.NARRATION + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, pos) - 1 AS pos, segment FROM r WHERE pos >= 0", python=True)
def narration_segments(spark, sf_dir):
    return segments.segments(table(spark, sf_dir, "documents")).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT conv_id, turn, (sum(ms) OVER w - ms)::BIGINT AS start_ms, (sum(ms) OVER w)::BIGINT AS end_ms FROM
    (SELECT conv_id, turn, floor(length(text) / 15.0 * 1000)::BIGINT AS ms FROM conversations)
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def chapter_timeline(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") / 15.0).alias("duration_seconds"))
    return audio.timeline(rows, "conv_id", "turn").select("conv_id", "turn", "start_ms", "end_ms")


def _audio(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("samples"))
    return rows.withColumn("sample_rate", F.lit(16000))


METRICS = [
    "sample_count", "duration_seconds", "peak_dbfs", "rms_dbfs", "silence_ratio", "leading_silence_seconds", "trailing_silence_seconds",
    "clipped_samples", "clipped_ratio",
]


@query(S.METRICS + f"SELECT vec_id, {', '.join(METRICS)} FROM metrics")
def signal_metrics(spark, sf_dir):
    return audio.signal_metrics(_audio(spark, sf_dir), clip=0.25, silence=0.05).select("vec_id", *METRICS)


@query(S.STEREO_METRICS + f"SELECT vec_id, {', '.join(METRICS)} FROM metrics")
def stereo_signal_metrics(spark, sf_dir):
    rows = _audio(spark, sf_dir).withColumn("channels", F.lit(2))
    return audio.signal_metrics(rows, clip=0.25, silence=0.05).select("vec_id", *METRICS)


@query(S.METRICS + S.QC_ROLLUP)
def audio_qc_rollup(spark, sf_dir):
    return audio.qc_rollup(audio.signal_metrics(_audio(spark, sf_dir), clip=0.25, silence=0.05), ["label"])


@query("""SELECT vec_id // 8 AS chapter, count(*) * 64 AS samples, round(sum(list_sum(embedding::DOUBLE[])), 3) AS total,
    list_first(first(embedding ORDER BY vec_id))::DOUBLE AS first, list_last(last(embedding ORDER BY vec_id))::DOUBLE AS last FROM embeddings GROUP BY 1""")
def concat_samples(spark, sf_dir):
    rows = _audio(spark, sf_dir).withColumn("chapter", F.expr("vec_id div 8"))
    out = long_audio.chunk_sums(long_audio.chunked(rows, ["chapter"], ["vec_id"], 200), ["chapter"])
    return out.select("chapter", "samples", F.round("total", 3).alias("total"), "first", "last")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.data.id'), json_extract_string(props, '$.id'), json_extract_string(props, '$.page'), event_type) AS task FROM events""")
def reply_json_fallbacks(spark, sf_dir):
    task = T.from_first(F.col("props"), "$.data.id", "$.id", "$.page")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(task, "event_type").alias("task"))


@query("SELECT conv_id::VARCHAR AS book, string_agg(turn || ' ' || role, ' / ' ORDER BY turn) AS title FROM conversations GROUP BY conv_id")
def metadata_join_titles(spark, sf_dir):
    from ..sources.containers import joined_metadata

    value = F.concat(F.col("turn").cast("string"), F.lit(" "), F.col("role"))
    meta = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book"), F.col("turn").alias("pos"), F.lit("title").alias("name"), value.alias("value"))
    return joined_metadata(meta, "title")


@query("SELECT source AS book, count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY source")
def duplicate_count(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("book"))
    return rows.agg((F.count("*") - F.count_distinct("text")).alias("duplicates"))


def _talk_segments(spark, sf_dir):
    """Conversations as narrated texts, cut into segments of 120 characters at most."""
    lines = F.sort_array(F.collect_list(F.struct("turn", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))
    return segments.segments(rows, 120, "off", "conv_id")


@query(S.PACKED + "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i, pos) - 1 AS pos, segment FROM r WHERE pos >= 0", python=True)
def greedy_sentence_packing(spark, sf_dir):
    return _talk_segments(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))


@query(S.PACKED + f"SELECT conv_id, count(*) AS segments, round(sum({S.rounded('length(segment) * 80 / 8000::DOUBLE', 3)}), 3) AS seconds FROM r WHERE pos >= 0 GROUP BY conv_id", python=True)
def synthesized_durations(spark, sf_dir):
    # Few bytes of text make much audio, so segments are dealt out by number, not by the bytes or the conversation they come from.
    calls = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spoken = audio.signal_metrics(audio.synthesize(_talk_segments(spark, sf_dir), calls=calls))
    return spoken.groupBy("conv_id").agg(F.count("*").alias("segments"), F.round(F.sum("duration_seconds"), 3).alias("seconds"))


@query(S.READABILITY + S.SUMMARIES)
def book_summaries(spark, sf_dir):
    return reports.summary_rows(_chapters(spark, sf_dir)).withColumn("idx", F.col("idx").cast("long"))


@query("""SELECT p_partkey, 'caf' || chr(233) || ' ' || chr((8217 + p_partkey % 5)::INTEGER) || ' ' || chr(20013) || ' a < b ' || chr(8776) || ' ' || chr(252) || ' & x' AS text FROM part""", python=True)
def decoded_references(spark, sf_dir):
    """Named, numeric and hexadecimal character references, with and without a semicolon."""
    code = (8217 + F.col("p_partkey") % 5).cast("string")
    text = F.concat(F.lit("caf&eacute; &#"), code, F.lit("; &#x4e2d; a &lt; b &asymp; &uuml &amp; x"))
    return table(spark, sf_dir, "part").select("p_partkey", blocks.decode_entities(text).alias("text"))


@query(S.JUDGED + "SELECT page_id, strictness, block_index, c AS classification, r AS reason FROM fold")
def context_pass1(spark, sf_dir):
    out = first_pass(classify(with_levels(features(together(blocks.html_blocks(_pages(spark, sf_dir)))), LEVELS)))
    return out.select("page_id", "strictness", F.col("block_index").cast("long").alias("block_index"), "classification", "reason")


@query(S.JUDGED + "SELECT page_id, strictness, block_index, classification, reason FROM five WHERE open")
def context_pass2(spark, sf_dir):
    """What the second pass makes of the blocks that the first one left short."""
    out = second_pass(first_pass(classify(with_levels(features(together(blocks.html_blocks(_pages(spark, sf_dir)))), LEVELS))))
    return out.filter("_open").select("page_id", "strictness", F.col("block_index").cast("long").alias("block_index"), "classification", "reason")


@query(S.RESAMPLED, python=True)
def resampled_audio(spark, sf_dir):
    """Vectors at two rates, brought to the rate of the first of each four; resampling keeps a signal's mean."""
    rows = _audio(spark, sf_dir).withColumn("chapter", F.expr("vec_id div 4"))
    rows = rows.withColumn("sample_rate", F.when(F.col("vec_id") % 2 == 0, 16000).otherwise(8000))
    out = long_audio.assembled(rows, "chapter", "vec_id", size=100)
    sums = long_audio.chunk_sums(out, ["chapter"]).join(out.select("chapter", "sample_rate").distinct(), "chapter")
    return sums.select("chapter", "sample_rate", "samples", F.round("total", 2).alias("total"))


@query("SELECT page_id, length(coalesce(html, '')) AS chars, substr(coalesce(html, ''), 1, 200) AS head, length(coalesce(html, '')) > 200 AS cut FROM pages")
def html_previews(spark, sf_dir):
    return blocks.html_preview(_pages(spark, sf_dir), 200).withColumn("chars", F.col("chars").cast("long"))


@query(S.COVER_SUFFIXES)
def cover_suffixes(spark, sf_dir):
    """Image suffixes of contents that begin like images of some kinds."""
    heads = F.array(*[F.unhex(F.lit(x)) for x in S.IMAGE_HEADS])
    content = F.concat(F.element_at(heads, (F.col("p_partkey") % len(S.IMAGE_HEADS) + 1).cast("int")), F.col("p_name").cast("binary"))
    return table(spark, sf_dir, "part").select("p_partkey", T.image_suffix(content).alias("suffix"))


@query(S.MARKERS)
def chapter_marker_files(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.length("text") / 15.0).alias("duration_seconds"))
    timed = audio.timeline(rows, "conv_id", "turn").select(F.col("conv_id").alias("book"), F.col("turn").alias("idx"), F.concat("role", F.lit("; "), F.col("turn").cast("string")).alias("title"), "start_ms", "end_ms")
    titles = rows.filter("turn % 2 = 0").groupBy(F.col("conv_id").alias("book")).agg(F.concat(F.lit("Talk="), F.count("*").cast("string")).alias("title"), F.max("role").alias("creator"))
    return sinks.chapter_markers(timed, titles)


@query("""WITH items AS (SELECT page_id % 11 AS book, 'p' || page_id || '.xhtml' || CASE WHEN page_id % 4 = 0 THEN '#x' ELSE '' END AS href, html FROM pages),
    nav AS (SELECT page_id % 11 AS book, page_id AS pos, 'p' || page_id || CASE WHEN page_id % 5 = 4 THEN '.gone' ELSE '.xhtml' END || CASE WHEN page_id % 4 < 2 THEN '#x' ELSE '' END AS href FROM pages)
    SELECT nav.book, pos, nav.href, md5(coalesce(a.html, b.html)) AS digest FROM nav LEFT JOIN items a ON a.book = nav.book AND a.href = string_split(nav.href, '#')[1]
        LEFT JOIN items b ON b.book = nav.book AND b.href = nav.href""")
def chapter_bodies(spark, sf_dir):
    """Contents of navigation entries by their reference without the fragment, else by the whole."""
    book, key = (F.col("page_id") % 11).alias("book"), F.col("page_id").cast("string")
    pages = table(spark, sf_dir, "pages")
    items = pages.select(book, F.concat(F.lit("p"), key, F.lit(".xhtml"), F.when(F.col("page_id") % 4 == 0, "#x").otherwise("")).alias("href"), F.col("html").cast("binary").alias("content"))
    end = F.when(F.col("page_id") % 5 == 4, ".gone").otherwise(".xhtml")
    nav = pages.select(book, F.col("page_id").alias("pos"), F.concat(F.lit("p"), key, end, F.when(F.col("page_id") % 4 < 2, "#x").otherwise("")).alias("href"))
    return navigation.with_bodies(nav, items).select("book", "pos", "href", F.md5(F.col("html").cast("binary")).alias("digest"))


@query("""WITH i AS (SELECT page_id % 11 AS book, CASE page_id % 5 WHEN 4 THEN 'pic' || page_id || '.png' ELSE 'text/chapter' || lpad(page_id::VARCHAR, 7, '0') || '.xhtml' END AS href FROM pages)
    SELECT book, row_number() OVER (PARTITION BY book ORDER BY href) AS pos, 'Chapter ' || substr(href, 13, 7) AS title, href FROM i WHERE NOT starts_with(href, 'pic')""")
def virtual_chapters(spark, sf_dir):
    """Navigation made of file names, in their order; pictures are no chapters."""
    picture = F.col("page_id") % 5 == 4
    href = F.when(picture, F.concat(F.lit("pic"), F.col("page_id").cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("text/chapter"), F.lpad(F.col("page_id").cast("string"), 7, "0"), F.lit(".xhtml")))
    items = table(spark, sf_dir, "pages").select((F.col("page_id") % 11).alias("book"), href.alias("href"), F.when(picture, "image/png").otherwise("").alias("media_type"))
    return navigation.virtual_navigation(items).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cleaned_chars, CASE WHEN doc_id % 3 > 0 THEN n_chars + 5 END AS raw, CASE WHEN doc_id % 4 > 0 THEN n_chars // 2 END AS kept FROM documents),
    f AS (SELECT *, coalesce(raw, cleaned_chars) AS raw_chars, coalesce(kept, cleaned_chars) AS kept_chars FROM d)
    SELECT doc_id, cleaned_chars, raw_chars, kept_chars, greatest(raw_chars - kept_chars, 0) AS removed_chars, {S.ratio("kept_chars", "raw_chars")} AS retention_ratio FROM f""")
def report_defaults(spark, sf_dir):
    """Chapter reports of which some lack counts."""
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, n + 5).alias("raw_chars"), F.when(F.col("doc_id") % 4 > 0, F.call_function("div", n, F.lit(2))).alias("kept_chars"))
    return reports.chapter_reports(rows).select("doc_id", "cleaned_chars", "raw_chars", "kept_chars", "removed_chars", "retention_ratio")


def _page_reports(spark, sf_dir):
    return clean.full_report(_judged(spark, sf_dir, (C.DEFAULT_LEVEL,))).withColumn("book", F.col("page_id") % 11)


@query(S.JUDGED + f"SELECT page_id % 11 AS book, reason, count(*) AS blocks FROM judged {S.OF_LEVEL} AND NOT keep GROUP BY ALL")
def merged_reasons(spark, sf_dir):
    """Reason maps of pages added up for each of eleven books."""
    return reports.merged_reasons(_page_reports(spark, sf_dir), "removed_reason_counts")


@query(S.JUDGED + f"""SELECT page_id, reason, count(*) AS blocks FROM {S.PLACED} WHERE NOT keep AND (page_id % 2 = 1 OR place <= {C.LIST_CAP}) GROUP BY ALL""")
def reason_fallbacks(spark, sf_dir):
    """Removed reasons of pages; every other report has lost its map and has it from its samples."""
    out = _page_reports(spark, sf_dir)
    for c in ("removed_reason_counts", "reason_counts"):
        out = out.withColumn(c, F.when(F.col("page_id") % 2 == 1, F.col(c)))
    filled = reports.fallback_reasons(out)
    return filled.select("page_id", F.explode("removed_reason_counts").alias("reason", "blocks"))


@query("""WITH c AS (SELECT source AS book, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS idx FROM documents)
    SELECT book, idx, doc_id FROM c""")
def chapter_places(spark, sf_dir):
    """The place of each document in its source, by the buckets of a sampled order."""
    return numbered(table(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id"), "book", "doc_id", "idx")


@query("""SELECT source AS book, arg_min(lang, doc_id) AS lang, count(*) AS planned_chapter_count, count(*) FILTER (WHERE doc_id % 3 = 0) AS generated_audio_count FROM documents GROUP BY source""")
def generated_chapters(spark, sf_dir):
    """Planned and generated chapters of each book, and the language of its first."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("book"), F.col("doc_id").alias("idx"), "lang", "text", F.lit(None).cast("string").alias("href"), (F.col("doc_id") % 3 == 0).alias("audio_generated"))
    counts = reports.book_rollup(reports.chapter_reports(rows)).select("book", "planned_chapter_count", "generated_audio_count")
    first = reports.first_value(rows, "lang").withColumnRenamed("book", "_book")
    return counts.join(first, F.col("book").eqNullSafe(F.col("_book"))).drop("_book")


@query("""WITH a AS (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN list_transform(embedding, lambda x: 0.5::FLOAT) WHEN 1 THEN [] ELSE embedding END AS s FROM embeddings)
    SELECT vec_id, coalesce(list_max(s) - list_min(s) < 0.001, true) AS silent FROM a""")
def silent_audio(spark, sf_dir):
    kind = F.col("vec_id") % 5
    samples = F.when(kind == 0, F.transform("samples", lambda x: F.lit(0.5).cast("float"))).when(kind == 1, F.slice("samples", 1, 0)).otherwise(F.col("samples"))
    return _audio(spark, sf_dir).withColumn("samples", samples).select("vec_id", audio.is_silent().alias("silent"))


@query(S.METRICS + """SELECT count(*) AS file_count, count(*) FILTER (WHERE vec_id % 7 > 0) AS analyzed_file_count, count(*) FILTER (WHERE vec_id % 7 = 0) AS failed_file_count,
    count(*) FILTER (WHERE vec_id % 7 > 0 AND clipped_ratio > 0) AS clipped_file_count FROM metrics""")
def audio_qc_failures(spark, sf_dir):
    """The rollup of files of which every seventh can't be read."""
    rows = audio.signal_metrics(_audio(spark, sf_dir), clip=0.25, silence=0.05).withColumn("error", F.when(F.col("vec_id") % 7 == 0, "broken"))
    return audio.qc_rollup(rows).select("file_count", "analyzed_file_count", "failed_file_count", "clipped_file_count")


@query(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {S.spoken("p_size")} WHEN 1 THEN '负' || {S.spoken("p_size")} WHEN 2 THEN {S.spoken("p_size")} || '点二五' ELSE '' END AS said FROM part""")
def numbers_to_zh(spark, sf_dir):
    """Whole, negative, decimal and blank numbers as they stand in texts."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    token = F.when(kind == 0, size).when(kind == 1, F.concat(F.lit(" -"), size)).when(kind == 2, F.concat(size, F.lit(".25"))).otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", zh.number_to_zh(token).alias("said"))


@query(S.LONG_METRICS)
def long_signal_metrics(spark, sf_dir):
    """Vectors of a label as one long signal, measured in rows of 64 samples."""
    rows = numbered(_audio(spark, sf_dir), "label", "vec_id", "place")
    rows = rows.select("label", "sample_rate", F.lit(1).alias("channels"), ((F.col("place") - 1) * 64).alias("start"), "samples")
    out = long_audio.chunk_metrics(rows, ["label"], clip=0.25, silence=0.05)
    return out.select("label", *METRICS)
