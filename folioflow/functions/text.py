"""Text expressions of the cleaning rules. All take and give Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """True if pattern, with its own anchors, is found; \\s, \\d and case are those of Unicode."""
    return text.rlike(f"(?{'iu' if ignore_case else ''}dU){pattern}")


def replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, f"(?dU){pattern}", by)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(C.WHITE_SPACE))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ratio(part: Column, whole: Column, digits: int | None = 6) -> Column:
    """part / max(whole, 1), rounded to digits."""
    value = part / F.greatest(whole, F.lit(1))
    return rounded(value, digits) if digits else value


#: 2^27 + 1, which splits a double into two halves whose products are exact.
SPLITTER = 134217729.0


def rounded(value: Column, digits: int) -> Column:
    """value rounded to digits, ties of its exact binary value to even; up to 7 digits.

    The product with the power of ten is rounded itself, so where it looks like a
    tie, what it has lost decides.
    """
    scale = float(10**digits)

    def half_even(x: Column) -> Column:
        high = x * SPLITTER - (x * SPLITTER - x)
        product = x * scale
        lost = (high * scale - product) + (x - high) * scale
        low = F.floor(product)
        gap = product - low
        up = F.when(gap > 0.5, 1).when(gap < 0.5, 0).when(lost > 0, 1).when(lost < 0, 0).otherwise(F.abs(low) % 2)
        return (low + up).cast("double") / scale

    return let(value.cast("double"), half_even)


def is_noise(text: Column) -> Column:
    """Contents headers and entries, decoration, page numbers and blank lines."""
    line = collapse(text)
    return (
        (line == "")
        | matches(line, C.TOC_HEADER, True)
        | matches(line, C.DECORATION)
        | matches(line, C.PAGE_NUMBER, True)
        | is_toc_entry(line)
    )


def is_toc_entry(line: Column) -> Column:
    return matches(line, C.TOC_LEADER) | matches(line, C.TOC_ENTRY_ZH) | matches(line, C.TOC_ENTRY_EN, True)


def is_standalone_heading(text: Column) -> Column:
    line = collapse(text)
    shape = matches(line, C.HEADING_EN, True) | matches(line, C.HEADING_ZH)
    return (line != "") & (F.length(line) <= 120) & ~matches(line, C.SENTENCE_END) & ~is_toc_entry(line) & shape


def english_words(text: Column) -> Column:
    return count(text, C.EN_WORD)


def stopword_density(text: Column) -> Column:
    """The greater of stop words among English words and of hint words by characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(C.EN_WORD), 0)
    english = F.size(F.filter(words, lambda w: w.isin(*C.EN_STOPWORDS))) / F.greatest(F.size(words), F.lit(1))
    hits = sum(
        ((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) for w in C.ZH_HINTS), F.lit(0.0)
    )
    return F.greatest(english, hits / F.greatest(F.length(text), F.lit(1)))


def unwrap(text: Column) -> Column:
    """Drop wrapper decoration: ==正文== goes, ==x== becomes x."""
    return collapse(replace(replace(text, C.GENERIC_WRAPPED, " "), C.ANY_WRAPPED, " $1 "))


def was_wrapped(text: Column) -> Column:
    return matches(text, C.GENERIC_WRAPPED) | matches(text, C.ANY_WRAPPED)


def unparenthesise(text: Column) -> Column:
    """（《x》） as 《x》."""
    return collapse(replace(text, C.TITLE_IN_PARENS, "《$1》"))


def file_stem(href: Column) -> Column:
    """Lower-case file name of a reference without fragment, folder and last suffix."""
    name = F.substring_index(F.lower(strip(F.substring_index(href, "#", 1))), "/", -1)
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def is_non_content_href(href: Column, nav_file: Column | None = None) -> Column:
    """True for blank references, the navigation file itself and contents, cover and copyright pages."""
    whole = F.lower(strip(F.substring_index(href, "#", 1)))
    stem = F.replace(file_stem(href), F.lit("_"), F.lit("-"))
    tokens = F.split(F.regexp_replace(stem, "[^a-z0-9]+", " "), " ")
    out = (whole == "") | stem.isin(*C.NON_CONTENT_STEMS)
    out = out | F.arrays_overlap(tokens, F.array(*map(F.lit, C.NON_CONTENT_TOKENS)))
    if nav_file is not None:
        out = out | ((nav_file != "") & (whole == F.lower(nav_file)))
    return out


def href_key(href: Column) -> Column:
    return F.lower(strip(F.substring_index(href, "#", 1)))


def title_from_filename(href: Column) -> Column:
    """Words of the file name with capitals, chapter12 as Chapter 12."""
    stem = F.regexp_replace(F.substring_index(href, "/", -1), r"(.)\.[^.]*\z", "$1")
    spaced = F.translate(stem, "_-", "  ")
    part = r"(?i)\b(chapter|section|part|page)\s*(\d+)\b"
    spaced = F.regexp_replace(F.regexp_replace(spaced, part, "$1 $2"), r"(?i)\b(\d+)\s*(chapter|section|part|page)\b", "$2 $1")
    return title_case(spaced)


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first and small ones after it, also behind a digit or an apostrophe."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), 0)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20)))), "")


def sanitized(title: Column) -> Column:
    """A title as part of a file name: reserved characters as _, 50 characters at most."""
    return F.substring(F.regexp_replace(title, r'[<>:"/|?*]', "_"), 1, C.TITLE_CHARS)


def chapter_file(index: Column, title: Column) -> Column:
    return F.concat(F.lit("chapter_"), F.lpad(index.cast("string"), 3, "0"), F.lit("_"), sanitized(title))


def image_suffix(content: Column) -> Column:
    """File suffix by an image's first bytes; .jpg where they say nothing."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), ".jpg")
        .when(head.startswith("89504E470D0A1A0A"), ".png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), ".gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), ".webp")
        .when(head.startswith("424D"), ".bmp")
        .otherwise(".jpg")
    )


def from_first(text: Column, *paths: str) -> Column:
    """The first of several JSON paths of a reply that has a value."""
    return F.coalesce(*[F.get_json_object(text, p) for p in paths])


def dbfs(value: Column) -> Column:
    """Amplitude in decibels of full scale; null where there is none."""
    return F.when(value > 0, rounded(20 * F.log10(value), 3))
