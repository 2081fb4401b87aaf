"""DuckDB SQL of the queries, built from the same fixed values."""

from __future__ import annotations

from .. import constants as C
from ..operators.blocks import TOKENS, UNFINISHED


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return ", ".join(map(quoted, words))


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def matches(x: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({x}, {quoted(('(?i)' if ignore_case else '') + pattern)})"


def ratio(part: str, whole: str) -> str:
    return rounded(f"({part})::DOUBLE / greatest({whole}, 1)", 6)


def rounded(x: str, digits: int) -> str:
    """Half to even on the exact binary value, as functions.text.rounded has it."""
    scale, split, half = f"{10.0**digits}::DOUBLE", "134217729.0::DOUBLE", "0.5::DOUBLE"
    high = f"(v * {split} - (v * {split} - v))"
    lost = f"(({high} * {scale} - v * {scale}) + (v - {high}) * {scale})"
    gap = f"(v * {scale} - floor(v * {scale}))"
    up = f"CASE WHEN {gap} > {half} THEN 1 WHEN {gap} < {half} THEN 0 WHEN {lost} > 0 THEN 1 WHEN {lost} < 0 THEN 0 ELSE abs(floor(v * {scale})) % 2 END"
    return f"list_transform([({x})::DOUBLE], lambda v: (floor(v * {scale}) + {up}) / {scale})[1]"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(pattern)}))"


def noise(x: str) -> str:
    line = collapse(x)
    return f"({line} = '' OR {matches(line, C.TOC_HEADER, True)} OR {matches(line, C.DECORATION)} OR {matches(line, C.PAGE_NUMBER, True)} OR {toc(line)})"


def toc(line: str) -> str:
    return f"({matches(line, C.TOC_LEADER)} OR {matches(line, C.TOC_ENTRY_ZH)} OR {matches(line, C.TOC_ENTRY_EN, True)})"


def heading(x: str) -> str:
    line = collapse(x)
    shape = f"({matches(line, C.HEADING_EN, True)} OR {matches(line, C.HEADING_ZH)})"
    return f"({line} <> '' AND length({line}) <= 120 AND NOT {matches(line, C.SENTENCE_END)} AND NOT {toc(line)} AND {shape})"


_TOKENS = f"""tokens AS (
    SELECT page_id, pos, token,
        CASE WHEN NOT starts_with(token, '<') OR NOT ends_with(token, '>') OR regexp_matches(token, '(?is)^<(?:script|style)\\b.*</\\s*(?:script|style)\\s*>$') THEN ''
             ELSE lower(regexp_extract(token, '^(?:<|</\\s*)([A-Za-z][^ \\t\\n\\r\\f/>]*)', 1)) END AS name
    FROM (SELECT page_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos
          FROM (SELECT page_id, CASE WHEN regexp_matches(t[-1], {quoted(UNFINISHED)}) THEN t[:-2] ELSE t END AS t
                FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), {quoted(TOKENS)}) AS t FROM pages)))),
kinds AS (
    SELECT *, CASE WHEN NOT starts_with(token, '<') OR NOT ends_with(token, '>') THEN 'text' WHEN name = '' THEN 'other'
        WHEN starts_with(token, '</') THEN 'end' WHEN ends_with(token, '/>') THEN 'self' ELSE 'start' END AS kind FROM tokens)"""

HTML_TOKENS = f"WITH {_TOKENS} SELECT kind, name, count(*) AS tokens, sum(length(token))::BIGINT AS chars FROM kinds GROUP BY kind, name"

_ENTITIES = "token"
for _name, _char in (
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", " "), ("copy", "©"), ("reg", "®"), ("middot", "·"),
    ("hellip", "…"), ("mdash", "—"), ("ndash", "–"), ("lsquo", "‘"), ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("bull", "•"),
    ("amp", "&"),
):
    _ENTITIES = f"replace({_ENTITIES}, '&{_name};', {quoted(_char)})"

_W = "OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"
_BLOCKS = f"""{_TOKENS},
d1 AS (SELECT *, sum(CASE WHEN name IN ({listed(C.DROPPED_TAGS)}) THEN CASE kind WHEN 'start' THEN 1 WHEN 'end' THEN -1 ELSE 0 END ELSE 0 END) {_W} AS s
    FROM kinds WHERE kind <> 'other'),
d2 AS (SELECT page_id, pos, token, name, kind, s - least(0, min(s) {_W}) AS depth FROM d1),
d3 AS (SELECT *, sum(CASE WHEN name = 'a' THEN CASE kind WHEN 'start' THEN 1 WHEN 'end' THEN -1 ELSE 0 END ELSE 0 END) {_W} AS s
    FROM d2 WHERE depth = 0 AND name NOT IN ({listed(C.DROPPED_TAGS)})),
d4 AS (SELECT *, s - least(0, min(s) {_W}) AS link, sum(CASE WHEN name IN ({listed(C.BLOCK_TAGS)}) THEN 1 ELSE 0 END) {_W} AS block,
    CASE WHEN kind = 'text' THEN {collapse(_ENTITIES)} END AS piece FROM d3),
d5 AS (SELECT page_id, block, coalesce(max(name) FILTER (WHERE kind = 'start' AND name IN ({listed(C.BLOCK_TAGS)})), 'text') AS tag,
        string_agg(piece, ' ' ORDER BY pos) FILTER (WHERE piece <> '') AS text,
        coalesce(sum(length(piece)) FILTER (WHERE piece <> ''), 0)::BIGINT AS n,
        coalesce(sum(length(piece)) FILTER (WHERE piece <> '' AND link > 0), 0)::BIGINT AS link_chars
    FROM d4 GROUP BY page_id, block),
blocks AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block) - 1 AS block_index, tag, text,
        greatest(n, length(text)) AS total_chars, link_chars, tag IN ({listed(C.HEADING_TAGS)}) AS is_heading
    FROM d5 WHERE text IS NOT NULL)"""
BLOCKS = f"WITH {_BLOCKS} "

_FALLBACK = " || ".join(
    f"list_transform(regexp_extract_all(h, '(?is)<{t}[^>]*>(.*?)</{t}>', 1), lambda x: {collapse("regexp_replace(x, '<[^>]+>', ' ', 'g')")})"
    for t in C.FALLBACK_TAGS
)
REGEX_BLOCKS = f"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', '', 'g'),
    '(?is)<style[^>]*>.*?</style>', '', 'g') AS h FROM pages),
p AS (SELECT page_id, list_filter({_FALLBACK}, lambda x: x <> '') AS parts, {collapse("regexp_replace(h, '<[^>]+>', ' ', 'g')")} AS whole FROM h),
c AS (SELECT page_id, CASE WHEN len(parts) > 0 THEN parts WHEN whole <> '' THEN [whole] ELSE [] END AS parts FROM p)
SELECT page_id, generate_subscripts(parts, 1) - 1 AS block_index, unnest(parts) AS text, length(unnest(parts)) AS total_chars FROM c"""

_GENERIC, _ANY = quoted(C.GENERIC_WRAPPED), quoted(C.ANY_WRAPPED)
_HITS = " + ".join(f"(length(text) - length(replace(text, {quoted(w)}, ''))) / {len(w)}.0" for w in C.ZH_HINTS)
_FEATURES = f"""{_BLOCKS},
normal AS (SELECT page_id, block_index, tag, total_chars, link_chars, is_heading,
        regexp_matches(text, {_GENERIC}) OR regexp_matches(text, {_ANY}) AS wrapped,
        {collapse(f"regexp_replace({collapse(f"regexp_replace(regexp_replace(text, {_GENERIC}, ' ', 'g'), {_ANY}, ' \\1 ', 'g')")}, {quoted(C.TITLE_IN_PARENS)}, '《\\1》', 'g')")} AS text
    FROM blocks),
features AS (SELECT *, length(text) AS n_chars, link_chars / greatest(total_chars, 1) AS link_density,
        {count("text", C.PUNCTUATION)} / greatest(length(text), 1) AS punct_density,
        greatest(len(list_filter(regexp_extract_all(lower(text), '[A-Za-z]+'), lambda w: w IN ({listed(C.EN_STOPWORDS)}))) /
            greatest({count("lower(text)", C.EN_WORD)}, 1), ({_HITS}) / greatest(length(text), 1)) AS stopword_density,
        {noise("text")} AS noise, {matches("text", C.SENTENCE_END)} AS sentence_like, {matches("text", C.CJK)} AS cjk,
        {count("text", C.EN_WORD)} AS n_words, {heading("text")} AS heading_like, {matches("text", C.SHORT_TOC_EN, True)} AS short_toc
    FROM normal)"""
FEATURES = f"WITH {_FEATURES} "

_LEVELS = ", ".join(f"({quoted(k)}, {', '.join(f'{float(x)}::DOUBLE' for x in v)})" for k, v in C.LEVELS.items())
_CLASSIFIED = f"""{_FEATURES},
levels(strictness, {", ".join(C.LEVEL_FIELDS)}) AS (VALUES {_LEVELS}),
marked AS (SELECT *, wrapped AND text = '' AS marker, link_density > max_link_density AS many_links,
    punct_density < min_punct_density AND n_chars >= low_length AS few_marks FROM features CROSS JOIN levels),
scored AS (SELECT *, CASE WHEN marker OR noise THEN -10.0::DOUBLE ELSE
        CASE WHEN n_chars >= high_length THEN 2.0::DOUBLE WHEN n_chars >= low_length THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN many_links THEN -2.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN few_marks THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN stopword_density >= min_stopword_density THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN sentence_like THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN is_heading THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM marked),
classified AS (SELECT *, CASE WHEN marker THEN 'decorative_wrapper_marker' WHEN noise THEN 'noise_pattern' WHEN few_marks THEN 'low_punctuation_density'
        WHEN many_links THEN 'high_link_density' ELSE 'content_like' END AS reason,
    CASE WHEN marker OR noise THEN 'bad' WHEN n_chars < short_length THEN 'short' WHEN score >= good_score THEN 'good'
        WHEN score <= bad_score THEN 'bad' ELSE 'near_good' END AS classification FROM scored)"""
CLASSIFIED = f"WITH {_CLASSIFIED} "

_BW = "OVER (PARTITION BY page_id, strictness ORDER BY block_index)"
_IN = "IN ('good', 'near_good')"
_PASS = f"""CASE WHEN f.classification = 'short' THEN CASE
        WHEN f.heading_like AND NOT coalesce(p.c {_IN}, false) AND f.next_content THEN 'chapter_heading_with_content_context'
        WHEN f.is_heading AND f.next_content THEN 'heading_with_content_context'
        WHEN p.c = 'good' AND f.next_good THEN 'surrounded_by_content' WHEN f.fixed IS NOT NULL THEN f.fixed
        WHEN f.suffix AND p.c {_IN} THEN 'short_suffix_for_content'
        WHEN f.strictness = 'conservative' THEN 'conservative_short_keep' END END"""
_NEXT = f"""CASE WHEN (CASE WHEN ({_PASS}) IS NOT NULL THEN 'near_good' ELSE f.classification END) = 'near_good'
        AND coalesce(p.c {_IN}, false) AND f.next_content THEN 'good' WHEN ({_PASS}) IS NOT NULL THEN 'near_good' ELSE f.classification END"""
_REASON = f"""CASE WHEN ({_NEXT}) = 'good' AND f.classification <> 'good' THEN 'context_promoted' ELSE coalesce(({_PASS}), f.reason) END"""
_JUDGED = f"""{_CLASSIFIED},
n1 AS (SELECT *, coalesce(lead(classification) {_BW} {_IN}, false) AS next_content, coalesce(lead(classification) {_BW} = 'good', false) AS next_good,
    strictness <> 'aggressive' AND n_words >= 2 AND NOT short_toc AND coalesce(n_words + lead(n_words) {_BW} >= 6, false) AS prefix,
    strictness <> 'aggressive' AND n_words >= 2 AND NOT short_toc AND coalesce(n_words + lag(n_words) {_BW} >= 6, false) AS suffix FROM classified),
facts AS MATERIALIZED (SELECT *, CASE WHEN sentence_like AND n_chars >= 4 THEN 'short_but_sentence_like' WHEN cjk AND n_chars >= 4 AND NOT noise THEN 'short_cjk_content_like'
    WHEN strictness <> 'aggressive' AND n_words >= 4 AND stopword_density >= 0.12 AND NOT short_toc THEN 'short_en_content_like'
    WHEN prefix AND next_content THEN 'short_prefix_for_content' END AS fixed FROM n1),
fold AS (SELECT f.page_id, f.strictness, f.block_index, {_NEXT} AS c, {_REASON} AS r FROM facts f, (SELECT NULL::VARCHAR AS c) p WHERE f.block_index = 0
    UNION ALL SELECT f.page_id, f.strictness, f.block_index, {_NEXT}, {_REASON} FROM fold p JOIN facts f
        ON f.page_id = p.page_id AND f.strictness = p.strictness AND f.block_index = p.block_index + 1),
one AS (SELECT f.* EXCLUDE (classification, reason), c AS classification, r AS reason FROM facts f JOIN fold USING (page_id, strictness, block_index)),
two AS (SELECT *, classification = 'short' AND strictness <> 'aggressive' AS open, prefix AND coalesce(lead(classification) {_BW} {_IN}, false) AS leads FROM one),
three AS (SELECT *, CASE WHEN NOT open THEN (classification {_IN})::INT WHEN leads THEN 1 WHEN suffix THEN NULL ELSE 0 END AS mark FROM two),
four AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY page_id, strictness ORDER BY block_index ROWS UNBOUNDED PRECEDING), 0) = 1 AS ok FROM three),
five AS (SELECT * REPLACE (CASE WHEN open AND leads THEN 'short_prefix_for_content' WHEN open AND ok THEN 'short_suffix_for_content' ELSE reason END AS reason,
    CASE WHEN open AND ok THEN 'near_good' ELSE classification END AS classification) FROM four),
judged AS MATERIALIZED (SELECT *, classification = 'good' OR classification = 'near_good' AND NOT (strictness = 'aggressive'
    AND reason IN ('high_link_density', 'low_punctuation_density')) AS keep FROM five)"""
JUDGED = f"WITH RECURSIVE {_JUDGED} "
CLEANED = """SELECT page_id, strictness, regexp_replace(trim(regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY block_index)
    FILTER (WHERE keep AND text <> ''), ''), '[ \\t]+', ' ', 'g')), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM judged GROUP BY page_id, strictness"""
REPORT = f"""SELECT *, greatest(raw_chars - kept_chars, 0) AS removed_chars, {ratio("kept_chars", "raw_chars")} AS retention_ratio,
    {ratio("kept_blocks", "total_blocks")} AS kept_ratio FROM (SELECT page_id, strictness, count(*) AS total_blocks, count(*) FILTER (WHERE keep) AS kept_blocks,
    count(*) FILTER (WHERE NOT keep) AS removed_blocks, sum(length(text))::BIGINT AS raw_chars,
    coalesce(sum(length(text)) FILTER (WHERE keep), 0)::BIGINT AS kept_chars FROM judged GROUP BY page_id, strictness)"""
FALSE_DROP = f"""SELECT strictness, page_id, place, retention_ratio, removed_chars FROM (SELECT *, row_number() OVER (PARTITION BY strictness ORDER BY page_id) AS place
    FROM ({REPORT}) WHERE retention_ratio < {C.FALSE_DROP_RETENTION} AND removed_chars > {C.FALSE_DROP_CHARS}) WHERE place <= {C.LIST_CAP}"""


def samples(condition: str) -> str:
    return f"""SELECT page_id, strictness, place, block_index, substr(text, 1, {C.SAMPLE_CHARS}) AS text, reason, {rounded("score", 3)} AS score,
        {rounded("stopword_density", 3)} AS stopword_density FROM (SELECT *, row_number() OVER (PARTITION BY page_id, strictness ORDER BY block_index) AS place
        FROM judged WHERE {condition}) WHERE place <= {C.LIST_CAP}"""


OF_LEVEL = _OF_LEVEL = f"WHERE strictness = '{C.DEFAULT_LEVEL}'"
PLACED = _NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY page_id, strictness, keep ORDER BY block_index) AS place FROM judged {_OF_LEVEL})"
NESTED = f"""SELECT page_id, strictness, 'total' AS part, unnest(['total_blocks', 'kept_blocks', 'raw_chars', 'removed_chars']) AS item,
        unnest([total_blocks, kept_blocks, raw_chars, removed_chars])::BIGINT AS n, NULL::VARCHAR AS text FROM ({REPORT}) {_OF_LEVEL}
    UNION ALL SELECT page_id, strictness, CASE WHEN keep THEN 'kept_samples' ELSE 'removed_samples' END, reason, block_index, substr(text, 1, {C.SAMPLE_CHARS})
        FROM {_NUMBERED} WHERE place <= {C.LIST_CAP}
    UNION ALL SELECT page_id, strictness, 'removed_reason_counts', reason, count(*), NULL FROM judged {_OF_LEVEL} AND NOT keep GROUP BY ALL
    UNION ALL SELECT page_id, strictness, 'reason_counts', reason, count(*), NULL FROM judged {_OF_LEVEL} GROUP BY ALL"""

LINES = """WITH lines AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'Chapter ' || p_size WHEN 1 THEN 'Chapter ' || p_size || ' ..... ' || p_partkey
    WHEN 2 THEN '第' || p_size || '章 …… 12' WHEN 3 THEN p_size::VARCHAR WHEN 4 THEN '第三章 ' || p_name WHEN 5 THEN '======' WHEN 6 THEN 'Page ' || p_size
    ELSE p_name END AS line FROM part) """

_STRIPPED = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"
READABILITY = f"""WITH t AS (SELECT doc_id, source, {_STRIPPED} AS t FROM documents),
s AS (SELECT *, list_transform(list_filter(list_transform(regexp_extract_all(t, {quoted(C.SENTENCE)}), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
    lambda x: x <> ''), lambda x: length(x)) AS found FROM t),
l AS (SELECT *, CASE WHEN len(found) = 0 AND t <> '' THEN [length(t)] ELSE found END AS n FROM s),
c AS (SELECT *, len(n) AS sentence_count, len(list_filter(n, lambda x: x > {C.OVERLONG_SENTENCE})) AS overlong_sentence_count,
    coalesce(list_sum(list_transform(regexp_extract_all(t, {quoted(C.ABNORMAL)}), lambda x: length(x))), 0)::BIGINT AS abnormal_symbol_count,
    {count("t", C.DIGIT)} AS numeric_char_count FROM l),
readability AS (SELECT doc_id, source, length(coalesce(t, '')) AS stripped_chars,
    len(list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS paragraph_count,
    sentence_count, {rounded("coalesce(list_sum(n), 0)::DOUBLE / greatest(sentence_count, 1)", 3)} AS avg_sentence_length,
    CASE WHEN len(n) > 0 THEN list_sort(n)[least(greatest(ceil(95 * len(n) / 100.0)::INT, 1), len(n))] ELSE 0 END AS p95_sentence_length,
    coalesce(list_max(n), 0) AS max_sentence_length, overlong_sentence_count, {ratio("overlong_sentence_count", "sentence_count")} AS overlong_sentence_ratio,
    abnormal_symbol_count, {ratio("abnormal_symbol_count", "length(t)")} AS abnormal_symbol_ratio, {count("t", C.NUMERIC)} AS numeric_token_count,
    numeric_char_count, {ratio("numeric_char_count", "length(t)")} AS numeric_char_ratio FROM c) """
_CHAPTERS = """(SELECT r.*, length(coalesce(d.text, '')) AS cleaned_chars, 'text/' || (d.doc_id % 97) || '.xhtml' AS href
    FROM readability r JOIN documents d ON r.doc_id = d.doc_id)"""
_ROLLUP = f"""SELECT source AS book, count(*) AS document_count, sum(cleaned_chars)::BIGINT AS total_cleaned_chars, sum(sentence_count)::BIGINT AS total_sentence_count,
    sum(overlong_sentence_count)::BIGINT AS total_overlong_sentence_count, sum(abnormal_symbol_count)::BIGINT AS total_abnormal_symbol_count,
    sum(numeric_char_count)::BIGINT AS total_numeric_char_count, max(max_sentence_length) AS max_sentence_length,
    count(*) FILTER (WHERE cleaned_chars = 0) AS empty_chapter_count, count(*) FILTER (WHERE cleaned_chars BETWEEN 1 AND {C.ULTRA_SHORT - 1}) AS ultra_short_chapter_count,
    count(href) - count(DISTINCT href) AS duplicate_href_count, true AS order_consistent,
    sum(sentence_count * avg_sentence_length) AS sentence_chars FROM {_CHAPTERS} GROUP BY source"""
ROLLUP = f"""SELECT * EXCLUDE (sentence_chars), {rounded("sentence_chars / greatest(total_sentence_count, 1)", 3)} AS avg_sentence_length,
    {ratio("total_abnormal_symbol_count", "total_cleaned_chars")} AS abnormal_symbol_ratio FROM ({_ROLLUP})"""
INTEGRITY = f"SELECT book, document_count, empty_chapter_count, ultra_short_chapter_count, duplicate_href_count, order_consistent FROM ({_ROLLUP})"
FALSE_KEEP = f"""SELECT book, doc_id, place, abnormal_symbol_ratio, numeric_char_ratio FROM (SELECT source AS book, *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place
    FROM readability WHERE abnormal_symbol_ratio > {C.FALSE_KEEP_ABNORMAL} OR numeric_char_ratio > {C.FALSE_KEEP_NUMERIC}) WHERE place <= {C.LIST_CAP}"""

_LISTED = "SELECT book, '{part}' AS part, row_number() OVER (PARTITION BY book ORDER BY idx) AS place, idx, href, retention_ratio, removed_chars FROM chapters WHERE {test}"
_LISTS = (
    ("documents", "true"),
    ("possible_false_drop", f"retention_ratio < {C.FALSE_DROP_RETENTION} AND removed_chars > {C.FALSE_DROP_CHARS}"),
    ("possible_false_keep", f"abnormal_symbol_ratio > {C.FALSE_KEEP_ABNORMAL} OR numeric_char_ratio > {C.FALSE_KEEP_NUMERIC}"),
)
SUMMARIES = f""", chapters AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS idx, href, {ratio("cleaned_chars", "n_chars")} AS retention_ratio,
        greatest(n_chars - cleaned_chars, 0) AS removed_chars, abnormal_symbol_ratio, numeric_char_ratio
        FROM {_CHAPTERS.replace("AS cleaned_chars", "AS cleaned_chars, d.n_chars")})
    SELECT * FROM ({" UNION ALL ".join(_LISTED.format(part=k, test=t) for k, t in _LISTS)}) WHERE part = 'documents' OR place <= {C.LIST_CAP}"""

HREFS = """WITH hrefs AS (SELECT page_id % 11 AS book, page_id AS pos, CASE page_id % 3
    WHEN 0 THEN 'OEBPS/' || ['chap_1.xhtml', 'nav.xhtml', 'Text/TOC.xhtml', 'Table_of_Contents.html', '7358.xhtml', 'my-toc-2.html', 'cover.html'][page_id % 7 + 1] || '#x'
    WHEN 1 THEN ['chap_1.xhtml', 'nav.xhtml', 'Text/TOC.xhtml', 'Table_of_Contents.html', '7358.xhtml', 'my-toc-2.html', 'cover.html'][page_id % 7 + 1]
    ELSE string_split(url, '/')[-1] END AS href FROM pages) """
HREF_KEY = "lower(trim(string_split(href, '#')[1]))"
_STEM = f"replace(regexp_replace(string_split({HREF_KEY}, '/')[-1], '\\.[^.]*$', ''), '_', '-')"
NON_CONTENT = f"""({HREF_KEY} = '' OR {_STEM} IN ({listed(C.NON_CONTENT_STEMS)})
    OR list_has_any(string_split(regexp_replace({_STEM}, '[^a-z0-9]+', ' ', 'g'), ' '), [{listed(C.NON_CONTENT_TOKENS)}]))"""

PROGRESS = """SELECT conv_id, turn, chapter_index, total_chapters, chapter_index / total_chapters * 100.0::DOUBLE AS progress_pct FROM (SELECT conv_id, turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chapter_index, count(*) OVER (PARTITION BY conv_id) AS total_chapters FROM conversations)"""
TITLES = """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name || ' o''neil 1st chapter ' || p_size), '[a-z]+|[^a-z]+'),
    lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') AS title FROM part"""

_G = """CASE WHEN {v} = 0 THEN '' ELSE
    CASE WHEN {v} // 1000 > 0 THEN substr('零一二三四五六七八九', {v} // 1000 + 1, 1) || '千' ELSE '' END
    || CASE WHEN {v} // 100 % 10 > 0 THEN substr('零一二三四五六七八九', {v} // 100 % 10 + 1, 1) || '百' ELSE '' END
    || CASE WHEN {v} // 100 % 10 = 0 AND {v} // 1000 > 0 AND {v} // 10 % 10 > 0 THEN '零' ELSE '' END
    || CASE WHEN {v} // 10 % 10 = 1 AND {v} < 100 THEN '十' WHEN {v} // 10 % 10 > 0 THEN substr('零一二三四五六七八九', {v} // 10 % 10 + 1, 1) || '十' ELSE '' END
    || CASE WHEN {v} // 10 % 10 = 0 AND {v} >= 100 AND {v} % 10 > 0 THEN '零' ELSE '' END
    || CASE WHEN {v} % 10 > 0 THEN substr('零一二三四五六七八九', {v} % 10 + 1, 1) ELSE '' END END"""


def spoken(v: str) -> str:
    """A number below 10^16 in Chinese."""
    groups, units = [f"({v} // {10**k} % 10000)" for k in (12, 8, 4, 0)], ("兆", "亿", "万", "")
    parts = []
    for k, (g, unit) in enumerate(zip(groups, units, strict=True)):
        gap = f"{v} >= {10 ** (16 - 4 * k)} AND ({g} < 1000 OR {groups[k - 1]} = 0)" if k else "false"
        parts.append(f"CASE WHEN {g} > 0 THEN CASE WHEN {gap} THEN '零' ELSE '' END || {_G.format(v=g)} || '{unit}' ELSE '' END")
    return f"CASE WHEN {v} = 0 THEN '零' ELSE {' || '.join(parts)} END"


INT_TO_ZH = f"""SELECT o_orderkey, value, {spoken("value")} AS spoken FROM
    (SELECT o_orderkey, (o_orderkey * [1, 10, 1000, 10007, 99999999977][o_orderkey % 5 + 1] % 10000000000000000)::BIGINT AS value FROM orders)"""
NORMALIZED = f"""SELECT o_orderkey, '列车在' || translate(strftime(o_orderdate, '%Y'), '0123456789', '零一二三四五六七八九') || '年' || {spoken("month(o_orderdate)")} || '月'
    || {spoken("day(o_orderdate)")} || '日停运，见第' || {spoken("(o_orderkey % 100)")} || '节，票价降了百分之' || {spoken("(o_orderkey % 90)")} || '点二五。' || chr(10)
    || '船上有' || {spoken("(o_orderkey % 7)")} || '盏灯，渡口十八点五分关门。' AS text FROM orders"""

_B = "[。！？!?；;：:\\n，,、)\\]】》」』 ]"


def _hard_split(keys: str, source: str, most: int) -> str:
    """A recursive table r of keys, pos, segment from source, which has keys and rest."""
    return f"""r AS (
    SELECT {keys}, -1::BIGINT AS pos, NULL::VARCHAR AS segment, rest FROM ({source})
    UNION ALL
    SELECT {keys}, pos + 1, CASE WHEN done THEN rest WHEN glue THEN head || tail ELSE head END, CASE WHEN done OR glue THEN '' ELSE tail END FROM (
        SELECT *, NOT done AND tail <> '' AND length(head) + length(tail) <= {most} AND regexp_matches(tail, '^{_B}+$') AS glue FROM (
            SELECT {keys}, pos, rest, length(rest) <= {most} AS done,
                CASE WHEN soft = '' THEN substr(rest, 1, {most}) ELSE soft END AS head,
                regexp_replace(substr(rest, CASE WHEN soft = '' THEN {most} ELSE cut END + 1), '^\\s+', '') AS tail FROM (
                SELECT *, regexp_replace(substr(rest, 1, cut), '^\\s+|\\s+$', '', 'g') AS soft FROM (
                    SELECT *, CASE WHEN regexp_matches(rest, '(?s)^.{{0,{most - 1}}}{_B}') THEN length(regexp_extract(rest, '(?s)^(.{{0,{most - 1}}}{_B})', 1)) ELSE least({most}, length(rest)) END AS cut
                    FROM r WHERE rest <> ''))))
)"""


HARD_SPLIT = f"WITH RECURSIVE {_hard_split('doc_id', f'SELECT doc_id, {_STRIPPED} AS rest FROM documents', 200)} SELECT doc_id, pos, segment FROM r WHERE pos >= 0"

_SENTENCES = quoted("[^。！？!?.\\n]*[。！？!?.\\n]+[”’」』）)\"']*\\s*|[^。！？!?.\\n]+")
_PIECES = quoted("[，,;；：:、]\\s*|[^，,;；：:、]+")
_TIGHT = "regexp_replace(x, '([\\p{Pd}\\p{Ps}\\p{Pe}\\p{Pi}\\p{Pf}\\p{Po}]) ', '\\1', 'g')"


def packed(key: str, texts: str, most: int) -> str:
    """WITH tables up to r, which has key, i, pos and segment; texts gives key and text."""
    return f"""WITH RECURSIVE texts AS ({texts}),
sentences AS (SELECT {key}, list_transform(regexp_extract_all({_STRIPPED}, {_SENTENCES}), lambda x: {_TIGHT}) AS s FROM texts),
parts AS (SELECT {key}, flatten(list_transform(s, lambda x: CASE WHEN length(x) <= {most} THEN [x] ELSE regexp_extract_all(x, {_PIECES}) END)) AS p FROM sentences),
packs AS (SELECT {key}, p, 0 AS i, '' AS held, NULL::VARCHAR AS done FROM parts
    UNION ALL SELECT {key}, p, i + 1, CASE WHEN i >= len(p) THEN '' WHEN over THEN p[i + 1] ELSE held || p[i + 1] END, CASE WHEN i >= len(p) OR over THEN held END
    FROM (SELECT *, held <> '' AND length(held) + length(regexp_replace(p[i + 1], '\\s+$', '')) > {most} AS over FROM packs WHERE i <= len(p))),
{_hard_split(f"{key}, i", f"SELECT {key}, i, regexp_replace(done, '^\\s+|\\s+$', '', 'g') AS rest FROM packs WHERE done IS NOT NULL", most)} """


PACKED = packed("conv_id", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id", 120)

# Of the spoken forms, texts of the tables need that of percents only.
_PERCENT = "'[0-9]+(?:\\.[0-9]+)?\\s*%'"
_SAID = f"""'百分之' || {spoken("regexp_extract(m, '^[0-9]+')::BIGINT")} || CASE WHEN contains(m, '.')
    THEN '点' || translate(regexp_extract(m, '\\.([0-9]+)', 1), '0123456789', '零一二三四五六七八九') ELSE '' END"""
_SPOKEN_TEXT = f"""SELECT doc_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda k: gaps[k] || coalesce(said[k], '')), '') AS t FROM (
    SELECT doc_id, regexp_split_to_array(coalesce(text, ''), {_PERCENT}) AS gaps, list_transform(regexp_extract_all(coalesce(text, ''), {_PERCENT}), lambda m: {_SAID}) AS said FROM documents)"""
_TIDY = "array_to_string(list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))"
NARRATION = packed("doc_id", f"SELECT doc_id, regexp_replace({_TIDY}, '[ \\t]+', ' ', 'g') AS text FROM ({_SPOKEN_TEXT})", C.SEGMENT_CHARS)


def _db(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN {rounded(f'20 * log10({x})', 3)} END"


_MONO = "list_transform(range(1, len(embedding) // 2 + 1), lambda i: (embedding[2 * i - 1]::DOUBLE + embedding[2 * i]::DOUBLE) / 2)"


def metrics(samples: str) -> str:
    return f"""WITH a AS (SELECT vec_id, label, list_transform({samples}, lambda x: abs(x::DOUBLE)) AS a, len({samples}) AS sample_count FROM embeddings),
b AS (SELECT *, list_filter(list_transform(a, lambda x, i: CASE WHEN x > 0.05 THEN i - 1 END), lambda i: i IS NOT NULL) AS loud FROM a),
metrics AS (SELECT vec_id, label, sample_count, {rounded("sample_count / 16000", 3)} AS duration_seconds, {_db("list_max(a)")} AS peak_dbfs,
    {_db("sqrt(list_sum(list_transform(a, lambda x: x * x)) / greatest(sample_count, 1))")} AS rms_dbfs,
    {ratio("len(list_filter(a, lambda x: x <= 0.05))", "sample_count")} AS silence_ratio,
    {rounded("coalesce(list_min(loud), sample_count) / 16000", 3)} AS leading_silence_seconds,
    {rounded("coalesce(sample_count - list_max(loud) - 1, sample_count) / 16000", 3)} AS trailing_silence_seconds,
    len(list_filter(a, lambda x: x >= 0.25)) AS clipped_samples, {ratio("len(list_filter(a, lambda x: x >= 0.25))", "sample_count")} AS clipped_ratio FROM b) """


METRICS, STEREO_METRICS = metrics("embedding"), metrics(_MONO)
RESAMPLED = """WITH a AS (SELECT vec_id // 4 AS chapter, vec_id, embedding, CASE WHEN vec_id % 2 = 0 THEN 16000 ELSE 8000 END AS rate FROM embeddings),
b AS (SELECT *, first_value(rate) OVER (PARTITION BY chapter ORDER BY vec_id) AS wanted FROM a)
SELECT chapter, wanted AS sample_rate, sum(len(embedding) * wanted // rate)::BIGINT AS samples, round(sum(list_sum(embedding::DOUBLE[]) * wanted / rate), 2) AS total
FROM b GROUP BY chapter, wanted"""
QC_ROLLUP = f"""SELECT label, count(*) AS file_count, count(*) AS analyzed_file_count, 0::BIGINT AS failed_file_count,
    {rounded("sum(duration_seconds)", 3)} AS total_duration_seconds, {rounded("avg(rms_dbfs)", 3)} AS mean_rms_dbfs, {rounded("avg(peak_dbfs)", 3)} AS mean_peak_dbfs,
    count(*) FILTER (WHERE silence_ratio > {C.HIGH_SILENCE}) AS high_silence_file_count, count(*) FILTER (WHERE clipped_ratio > 0) AS clipped_file_count
    FROM metrics GROUP BY label"""

#: First bytes of images of some kinds, and of none.
IMAGE_HEADS = ("FFD8FFE0", "89504E470D0A1A0A", "474946383761", "474946383961", "52494646000000005745425056", "424D36", "00000000")
COVER_SUFFIXES = f"""SELECT p_partkey, [{listed((".jpg", ".png", ".gif", ".gif", ".webp", ".bmp", ".jpg"))}][p_partkey % {len(IMAGE_HEADS)} + 1] AS suffix FROM part"""

_ESCAPED = "regexp_replace({}, '([=;#\\\\\\n])', '\\\\\\1', 'g')"
MARKERS = f"""WITH t AS (SELECT conv_id AS book, turn, role || '; ' || turn AS title, (sum(ms) OVER w - ms)::BIGINT AS start_ms, (sum(ms) OVER w)::BIGINT AS end_ms FROM
        (SELECT conv_id, turn, role, floor(length(text) / 15.0 * 1000)::BIGINT AS ms FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT book, string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || chr(10) || 'END=' || end_ms || chr(10) || 'title=' || {_ESCAPED.format("title")},
        chr(10) ORDER BY turn) AS body FROM t GROUP BY book),
    n AS (SELECT conv_id AS book, 'Talk=' || count(*) AS title, max(role) AS creator FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id)
    SELECT b.book, ';FFMETADATA1' || coalesce(chr(10) || 'title=' || {_ESCAPED.format("n.title")}, '') || coalesce(chr(10) || 'artist=' || {_ESCAPED.format("n.creator")}, '')
        || chr(10) || body || chr(10) AS markers FROM b LEFT JOIN n USING (book)"""

_DB = rounded("20 * log10({})", 3)
LONG_METRICS = f"""WITH v AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
    a AS (SELECT label, abs(x) AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id, k) - 1 AS i FROM v),
    m AS (SELECT label, count(*) AS n, max(x) AS peak, sqrt(sum(x * x) / count(*)) AS rms, count(*) FILTER (WHERE x >= 0.25) AS clipped, count(*) FILTER (WHERE x <= 0.05) AS quiet,
        min(i) FILTER (WHERE x > 0.05) AS first, max(i) FILTER (WHERE x > 0.05) AS last FROM a GROUP BY label)
    SELECT label, n AS sample_count, {rounded("n / 16000.0::DOUBLE", 3)} AS duration_seconds, CASE WHEN peak > 0 THEN {_DB.format("peak")} END AS peak_dbfs,
        CASE WHEN rms > 0 THEN {_DB.format("rms")} END AS rms_dbfs, {ratio("quiet", "n")} AS silence_ratio,
        {rounded("coalesce(first, n) / 16000.0::DOUBLE", 3)} AS leading_silence_seconds, {rounded("coalesce(n - last - 1, n) / 16000.0::DOUBLE", 3)} AS trailing_silence_seconds,
        clipped AS clipped_samples, {ratio("clipped", "n")} AS clipped_ratio FROM m"""
