"""The queries of this subpackage as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import decontam, mixing, pii, quality, spelling, url_filter

#: Words of a text, and the ASCII white space between them.
WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_WORDS_IN = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)


def _verdict() -> str:
    tests = [f"{name} {op} {value!r}" for name, least, most in quality.RULES for op, value in ((">=", least), ("<=", most)) if value is not None]
    return " AND ".join(tests)


QUALITY = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
    l AS (SELECT *, len(w) AS n_words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    windows AS (SELECT r, i, array_to_string(w[i:i + {quality.WINDOW - 1}], chr(31)) AS v
        FROM (SELECT r, w, unnest(range(1, n_words - {quality.WINDOW - 2})) AS i FROM l)),
    again AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM
        (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT r, sum(least({quality.WINDOW}, coalesce(next - i, {quality.WINDOW}))) AS n FROM again GROUP BY r),
    m AS (SELECT l.*, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({_WORDS_IN}))) AS stop,
        length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS letters,
        len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS echo,
        len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\t]*[-*•]'))) AS bullet,
        len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\t\r]*$'))) AS dots
        FROM l LEFT JOIN covered USING (r)),
    q AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_length, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
        coalesce(stop / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(letters / nullif(word_chars, 0), 0) AS letter_ratio,
        coalesce(echo / nullif(n_words, 0), 0) AS adjacent_repeat_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS duplicate_line_ratio,
        coalesce(bullet / nullif(n_lines, 0), 0) AS bullet_line_ratio, coalesce(dots / nullif(n_lines, 0), 0) AS ellipsis_line_ratio FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
        n_repeat_words, base_failed, NOT base_failed AND {_verdict()} AS kept, {", ".join(n for n, _, _ in quality.RULES if n != "n_words")} FROM q"""

_RULES = ", ".join(f"('{r.name[: r.name.index('/')]}', '{r.name[r.name.index('/') :]}', '{r.verdict}')" for r in url_filter.RULES if r.rank)
_HOST_WORDS = ", ".join(f"'{r.name}'" for r in url_filter.RULES if not r.rank)

URLS = rf"""
    WITH rules(h, p, v) AS (VALUES {_RULES}), bad AS (SELECT unnest([{_HOST_WORDS}]) AS word),
    u AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    fit AS (SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS said FROM u JOIN rules
        ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
    word AS (SELECT DISTINCT r FROM u JOIN bad ON regexp_matches(host, '(^|[.-])' || word || '([.-]|$)'))
    SELECT page_id, host, path, rule, coalesce(said, CASE WHEN word.r IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
    FROM u LEFT JOIN fit USING (r) LEFT JOIN word USING (r)"""

#: Exact pairs by common shingles, then all that links reach. Rows are numbered, since doc_id may repeat.
NGRAM = rf"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
        list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM d),
    c AS (SELECT md5(array_to_string(s, chr(10))) AS cls, any_value(s) AS s, any_value(len(s)) AS n, min(doc_id) AS class_id FROM s WHERE len(s) > 0 GROUP BY ALL),
    classes AS (SELECT cls, any_value(s) AS s, any_value(n) AS n, min(class_id) AS class_id FROM c GROUP BY cls),
    every AS (SELECT cls, n, md5_number(x) AS x FROM (SELECT cls, n, unnest(s) AS x FROM classes)),
    t AS (SELECT * FROM every SEMI JOIN (SELECT x FROM every GROUP BY x HAVING count(*) > 1) USING (x)),
    links AS (SELECT a.cls AS a, b.cls AS b FROM t a JOIN t b ON a.x = b.x AND a.cls <> b.cls GROUP BY a.cls, b.cls, a.n, b.n
        HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    reach AS (SELECT cls AS a, cls AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    comp AS (SELECT reach.a AS cls, min(class_id) AS component_id FROM reach JOIN classes ON reach.b = classes.cls GROUP BY reach.a),
    degree AS (SELECT a AS cls, count(*) AS n_links FROM links GROUP BY a)
    SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE component_id END AS component_id,
        CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE class_id END AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
    FROM s LEFT JOIN classes ON md5(array_to_string(s.s, chr(10))) = classes.cls AND len(s.s) > 0
        LEFT JOIN comp USING (cls) LEFT JOIN degree USING (cls)"""


def seeded_hash(seed: int, *columns: str) -> str:
    """common.seeded_hash of columns."""
    parts = ", ".join(f"coalesce({c}::VARCHAR, 'null')" for c in columns)
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 15))::BIGINT"


def _due(knots, share: str) -> str:
    """mixing.due for one schedule."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:], strict=True):
        pieces.append((t0, w0, t1, w1, total))
        total += (w0 + w1) / 2 * (t1 - t0)
    f = lambda x: f"{float(x)!r}::DOUBLE"
    cases = ""
    for t0, w0, t1, w1, before in pieces:
        need, slope = f"({share} * {f(total)} - {f(before)})", (w1 - w0) / (t1 - t0)
        x = f"2::DOUBLE * {need} / ({f(w0)} + sqrt(greatest({f(w0 * w0)} + {f(2 * slope)} * {need}, 0::DOUBLE)))"
        cases += f" WHEN {share} * {f(total)} <= {f(before + (w0 + w1) / 2 * (t1 - t0))} THEN least({f(t0)} + {x}, {f(t1)})"
    return f"greatest(CASE{cases} ELSE 1::DOUBLE END, 0::DOUBLE)"


def _mix() -> str:
    k = len(mixing.WEIGHTS)
    weights = "[" + ", ".join(f"{float(w)!r}::DOUBLE" for w in mixing.WEIGHTS) + "]"
    start = lambda e: f"(start + {e} * source_size)"
    taken = lambda e: f"greatest(least(round(target)::BIGINT - {start(e)}, size), 0)"
    whole = lambda e: f"CASE WHEN size > 0 AND 2 * {start(e)} + size <= 2 * round(target)::BIGINT THEN size ELSE 0 END"
    share = lambda e: f"least(({start(e)} + size / 2::DOUBLE) / greatest(target, 1::DOUBLE), 1::DOUBLE)"
    due = lambda e: "CASE number % {} {} END".format(len(mixing.SCHEDULES), " ".join(f"WHEN {i} THEN {_due(s, share(e))}" for i, s in enumerate(mixing.SCHEDULES)))
    return rf"""
    WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
    sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    numbered AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM sizes),
    weighed AS (SELECT *, {weights}[number % {k} + 1] AS weight, source_size * {float(mixing.MOST)!r}::DOUBLE AS most FROM numbered),
    levels AS (SELECT *, most / weight AS at_limit, row_number() OVER (ORDER BY most / weight, number) AS place,
        ({mixing.SHARE!r}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
        FROM weighed WINDOW before AS (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT min_by(level, place) AS level FROM levels WHERE level <= at_limit),
    targets AS (SELECT source, source_size, number, least(most, weight * coalesce((SELECT level FROM level), 'inf'::DOUBLE)) AS target FROM levels),
    placed AS (SELECT d.*, source_size, number, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY hash, doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
        FROM (SELECT *, {seeded_hash(23, "doc_id", "source", "size")} AS hash FROM d) d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source)
    SELECT doc_id, source, size, source_size, target, ({taken(0)} + {taken(1)})::BIGINT AS taken,
        CASE WHEN {taken(0)} > 0 THEN {due(0)} END AS position, CASE WHEN {taken(1)} > 0 THEN {due(1)} END AS second_position,
        ({whole(0)} + {whole(1)})::BIGINT AS whole_words FROM placed"""


MIX = _mix()

#: The table of CRC-32 made from its polynomial, and the checksum of a text byte by byte.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"

SHARDS = rf"""
    WITH crc AS (SELECT {_CRC_TABLE} AS crc_table),
    digits AS (SELECT doc_id, source, string_split(hex(encode(coalesce(text, ''))), '') AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    bytes AS (SELECT doc_id, source, n, CASE WHEN n = 0 THEN [] ELSE list_transform(range(n), lambda i: ('0x' || h[2 * i + 1] || h[2 * i + 2])::BIGINT) END AS b FROM digits),
    d AS (SELECT doc_id, source, n + 1 AS size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
        FROM bytes, crc),
    ranked AS (SELECT *, {seeded_hash(17, "doc_id", "source", "text_crc32")} AS hash FROM d),
    interleaved AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY hash, doc_id, text_crc32) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction FROM ranked),
    placed AS (SELECT *, row_number() OVER (ORDER BY fraction, hash, doc_id, text_crc32) - 1 AS place, count(*) OVER () AS total FROM interleaved)
    SELECT doc_id, source, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * 16 // total)::INTEGER AS shard,
        (place - (total * (place * 16 // total) + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM placed"""

_LOWER = rf"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Every window of every document that has a shingle of an item; without fingerprints.
LEAKS = rf"""
    WITH i AS (SELECT row_number() OVER () AS item, item_id, {_LOWER} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
    items AS (SELECT item, item_id, w, least(len(w), 5) AS k, greatest(len(w) - 4, 1) AS n FROM i WHERE len(w) > 0),
    bag AS (SELECT item, k, x, count(*) AS c FROM (SELECT item, k, unnest(list_transform(range(1, n + 1), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS x FROM items) GROUP BY ALL),
    d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS w FROM documents),
    runs AS (SELECT r, k, len(w) - k + 1 AS total, unnest(range(len(w) - k + 1)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS x
        FROM d, (SELECT DISTINCT k FROM items) WHERE len(w) >= k),
    hits AS (SELECT r, bag.item, runs.x, c, p, total, n, least(n, total) AS size FROM runs JOIN bag ON runs.x = bag.x AND runs.k = bag.k JOIN items ON bag.item = items.item
        WHERE total >= {decontam.SIMILARITY} * n),
    starts AS (SELECT DISTINCT r, item, size, n, unnest(range(greatest(p - size + 1, 0), least(p, total - size) + 1)) AS s FROM hits),
    common_part AS (SELECT r, item, s, n, size, x, least(count(*), any_value(c)) AS m FROM starts JOIN hits USING (r, item, n, size) WHERE p >= s AND p < s + size GROUP BY r, item, s, n, size, x),
    scored AS (SELECT r, item, s, sum(m)::DOUBLE / (n + size - sum(m))::DOUBLE AS similarity FROM common_part GROUP BY r, item, s, n, size),
    best AS (SELECT r, item, max(similarity) AS similarity, min(s) FILTER (similarity = top) AS start_word
        FROM (SELECT *, max(similarity) OVER (PARTITION BY r, item) AS top FROM scored) WHERE similarity >= {decontam.SIMILARITY} GROUP BY r, item)
    SELECT doc_id, item_id, similarity, start_word::BIGINT AS start_word FROM best JOIN d USING (r) JOIN items USING (item)"""

_SSN = r"(?:00[1-9]|0[1-9][0-9]|[1-578][0-9][0-9]|66[0-57-9]|6[0-57-9][0-9])-(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9][0-9]|[1-9][0-9][0-9][0-9])"
#: Pattern, character class that must not stand on either side, where \\b doesn't say it, and test of a match.
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 0 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][c::INT + 1] ELSE c::INT END)) % 10 = 0"
_BARE = "upper(replace(m, ' ', ''))"
_MOD97 = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr({_BARE}, 5) || substr({_BARE}, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE c::BIGINT END)), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1"
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", None, "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", None, "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) < 4 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))"),
    "card": (r"[0-9](?:[ -]?[0-9])+", None, f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", None, f"length({_DIGITS}) BETWEEN 10 AND 15"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", None, _MOD97),
    "ssn": (_SSN, ("0-9-", "0-9-"), "true"),
    "local_phone": (r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", ("0-9+(.-", "0-9-"), "true"),
}


def _pii() -> str:
    tables = [r"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"]
    for rank, kind in enumerate(pii.KINDS):
        core, sides, valid = _PII[kind.name]
        whole = f"(?:^|[^{sides[0]}]){core}" if sides else core
        found = f"regexp_extract(m, '(?:{core})$')" if sides else "m"
        right = f"NOT regexp_matches(substr(t, (s + length(m) + 1)::INT, 1), '^[{sides[1]}]')" if sides else "true"
        n = kind.name
        score = f"least({kind.prior}::DOUBLE + CASE WHEN near THEN {kind.bonus}::DOUBLE ELSE 0::DOUBLE END, 1::DOUBLE)"
        tables += [
            f"{n}_raw AS (SELECT r, t, regexp_extract_all(t, '{whole}') AS m, list_transform(regexp_split_to_array(t, '{whole}'), lambda x: length(x)) AS g FROM d WHERE regexp_matches(t, '{whole}'))",
            f"{n}_at AS (SELECT r, t, unnest(m) AS whole, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(g[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS begins FROM {n}_raw)",
            f"{n}_core AS (SELECT r, t, m, (begins + length(whole) - length(m))::BIGINT AS s FROM (SELECT *, {found.replace('(m,', '(whole,') if sides else 'whole'} AS m FROM {n}_at))",
            f"{n}_fit AS (SELECT *, s + length(m) AS e FROM {n}_core WHERE {right})",
            f"{n}_near AS (SELECT *, lag(e, 1, 0) OVER w AS before, lead(s, 1, length(t)) OVER w AS after FROM {n}_fit WINDOW w AS (PARTITION BY r ORDER BY s))",
            f"""{n}_scored AS (SELECT r, m, s, e, regexp_matches(substr(t, greatest(before, s - {pii.CONTEXT}) + 1, s - greatest(before, s - {pii.CONTEXT})), '{kind.context}')
                OR regexp_matches(substr(t, e + 1, least(after, e + {pii.CONTEXT}) - e), '{kind.context}') AS near FROM {n}_near)""",
            f"{n}_spans AS (SELECT r, s, {rank} AS rank, '{n}' AS kind, e, {score} AS score FROM {n}_scored WHERE {valid} AND {'true' if kind.base else f'{score} >= {pii.THRESHOLD}'})",
        ]
    spans = " UNION ALL ".join(f"SELECT * FROM {k.name}_spans" for k in pii.KINDS)
    base = sum(k.base for k in pii.KINDS)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    counts = ", ".join(f"count(s) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS)
    return f"""WITH {", ".join(tables)}, spans AS ({spans})
    SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce({joined} FILTER (WHERE rank < {base}), '')) AS base_sha256,
        coalesce({joined} FILTER (WHERE s IS NOT NULL), '') AS spans, coalesce(max(score), 0::DOUBLE) AS top_score FROM d LEFT JOIN spans USING (r) GROUP BY r"""


PII = _pii()

#: Every document's failures, then counts by part, failures and label against all orders.
AUDIT = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS w,
            doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS later FROM documents),
    good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
    f AS (SELECT part, d.doc_id IN (SELECT doc_id FROM good WHERE doc_id IS NOT NULL) AND d.doc_id IS NOT NULL AS is_good,
            d.doc_id IN (SELECT doc_id FROM toxic WHERE doc_id IS NOT NULL) AND d.doc_id IS NOT NULL AS is_toxic,
            CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
            CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END ||
            CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(later, false) THEN 'E' ELSE '' END AS fails FROM d),
    cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE is_good) AS good, count(*) FILTER (WHERE is_toxic) AS toxic FROM f GROUP BY ALL),
    orders AS (SELECT '' AS o UNION ALL SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(o) < 5 AND NOT contains(o, x)),
    steps AS (SELECT o, step, o[step] AS x, o[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step) WHERE length(o) = 5),
    seen AS (SELECT part, o, step, x, fails, n, good, toxic, contains(fails, x) AS hit,
            length(before) > length(translate(before, fails, '')) AS gone FROM cells, steps),
    sums AS (SELECT part, o AS filter_order, step::INTEGER AS step, x,
        coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (WHERE gone AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = x), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS toxic_lost
        FROM seen GROUP BY ALL)
    SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM sums"""

#: Words near each other by common strings with one character left out.
SPELLING = rf"""
    WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS crc_table),
    runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
    hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(hex) // 2 + 1), lambda i: ('0x' || hex[2 * i - 1:2 * i])::BIGINT)),
            lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])), 4294967295) AS h
        FROM (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hex FROM runs), crc),
    slipped AS (SELECT n, CASE WHEN h % {spelling.SLIP} = 0 THEN run[1:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word FROM hashed),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
    cut AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
    near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word),
    formed AS (SELECT best.word, min(near) AS form, any_value(most) AS form_n FROM best JOIN w ON best.word = w.word AND most >= {spelling.FACTOR} * n
        JOIN near ON near.word = best.word AND near_n = most GROUP BY best.word),
    reach AS (SELECT word, form AS root FROM formed UNION ALL SELECT reach.word, form FROM reach JOIN formed ON reach.root = formed.word)
    SELECT w.word, form, coalesce(last.root, w.word) AS root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n FROM w
        LEFT JOIN best ON w.word = best.word LEFT JOIN formed ON w.word = formed.word
        LEFT JOIN (SELECT * FROM reach WHERE root NOT IN (SELECT word FROM formed)) last ON w.word = last.word"""

#: Every window of 200 bytes by its MD5 sum; texts are cut into parts of 1000 windows, as a place in a long text takes time to find.
REPEATS = """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    n AS (SELECT r, doc_id, h, (length(h) // 2)::BIGINT AS n FROM d),
    parts AS (SELECT r, p * 1000 AS base, substr(h, 2000 * p + 1, 2 * 1199) AS h FROM (SELECT r, h, unnest(range(0, n // 1000 + 1)) AS p FROM n WHERE n >= 200)),
    w AS (SELECT r, base + i AS i, md5_number(substr(h, 2 * i + 1, 400)) AS x FROM (SELECT r, base, h, unnest(range(0, least(1000, length(h) // 2 - 199))) AS i FROM parts WHERE length(h) >= 400)),
    c AS (SELECT r, i FROM w SEMI JOIN (SELECT x FROM w GROUP BY x HAVING count(*) > 1) USING (x)),
    runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM
        (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM c)) GROUP BY r, g),
    gaps AS (SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
        sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(a) + 2),
            lambda k: substr(h, 2 * coalesce(CASE WHEN k > 1 THEN b[k - 1] END, 0) + 1, 2 * (coalesce(CASE WHEN k <= len(a) THEN a[k] END, n) - coalesce(CASE WHEN k > 1 THEN b[k - 1] END, 0)))), '') END)) AS kept_sha256
    FROM n LEFT JOIN gaps USING (r)"""
