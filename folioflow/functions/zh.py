"""Numbers, dates and times as spoken Chinese, as expressions without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .text import let, strip

LEVELS = ("off", "basic")
#: Pattern with look-around, the same without, and the rewriting of a match.
_DATE, _DATE_PARTS = r"(?<!\d)\d{4}[/-]\d{1,2}[/-]\d{1,2}(?!\d)", r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
_PERCENT, _PERCENT_PARTS = r"(?<!\d)\d+(?:\.\d+)?\s*%", r"(\d+(?:\.\d+)?)"
_CHAPTER, _CHAPTER_PARTS = r"第\s*\d+\s*[章节卷部篇回集]", r"(\d+)\s*([章节卷部篇回集])"
_TIME, _TIME_PARTS = r"(?<!\d)\d{1,2}:\d{2}(?!\d)", r"(\d{1,2}):(\d{2})"
_BETWEEN = rf"(?<={C.CJK})\d+(?:\.\d+)?(?={C.CJK})"


def digits_to_zh(text: Column) -> Column:
    """Digit by digit, as years are read."""
    return F.translate(text, "0123456789", C.ZH_DIGITS)


def _digit(value: Column) -> Column:
    return F.substring(F.lit(C.ZH_DIGITS), (value + 1).cast("int"), F.lit(1))


def group_to_zh(value: Column) -> Column:
    """A number from 0 to 9999; 0 is nothing. A leading 一十 is 十, and a gap between digits is one 零."""
    d3, d2, d1, d0 = (F.floor(value / k).cast("long") % 10 for k in (1000, 100, 10, 1))
    text = lambda x: F.coalesce(x, F.lit(""))
    high = (d3 > 0) | (d2 > 0)
    return F.concat(
        text(F.when(d3 > 0, F.concat(_digit(d3), F.lit("千")))),
        text(F.when(d2 > 0, F.concat(_digit(d2), F.lit("百")))),
        text(F.when((d2 == 0) & (d3 > 0) & (d1 > 0), F.lit("零"))),
        text(F.when((d1 == 1) & ~high, F.lit("十")).when(d1 > 0, F.concat(_digit(d1), F.lit("十")))),
        text(F.when((d1 == 0) & high & (d0 > 0), F.lit("零"))),
        text(F.when(d0 > 0, _digit(d0))),
    )


def int_to_zh(value: Column) -> Column:
    """A whole number from 0 up to below 10^16; null beyond."""
    powers = F.array(*[F.lit(10 ** (4 * k)) for k in (3, 2, 1, 0)])

    def said(v: Column) -> Column:
        groups = F.transform(powers, lambda p: F.call_function("div", v, p) % 10000)
        spoken = F.array_join(let(groups, _groups_to_zh), "")
        return F.when(v == 0, "零").when((v > 0) & (v < 10000), group_to_zh(v)).when((v > 0) & (v < 10**16), spoken)

    return let(value, said)


def _groups_to_zh(groups: Column) -> Column:
    """The parts of a number whose groups of four digits stand in order, the largest first."""
    units = F.array(*[F.lit(x) for x in reversed(C.ZH_GROUPS)])

    def part(x: Column, i: Column) -> Column:
        above = F.aggregate(F.slice(groups, F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y) > 0
        gap = above & ((x < 1000) | F.coalesce(F.get(groups, i - 1) == 0, F.lit(False)))
        return F.when(x > 0, F.concat(F.when(gap, "零").otherwise(""), group_to_zh(x), F.get(units, i))).otherwise("")

    return F.transform(groups, part)


def number_to_zh(token: Column) -> Column:
    """A number as it stands in a text: blank, negative, decimal or whole. Too long whole parts stay as they are."""
    # Each part is bound once: written out, a token would be cut from its text again for every digit.
    sign = lambda bare: F.when(bare.startswith("-"), "负").otherwise("")
    any_ = lambda bare: F.when(bare == "", bare).otherwise(F.concat(sign(bare), let(F.regexp_replace(bare, "^-", ""), _unsigned_to_zh)))
    short = lambda v: F.when(v == 0, "零").otherwise(group_to_zh(v))
    return let(token, lambda t: F.when(t.rlike(r"\A[0-9]{1,4}\z"), let(t.cast("long"), short)).otherwise(let(strip(t), any_)))


def _unsigned_to_zh(body: Column) -> Column:
    number = lambda whole: F.when(whole == "", F.lit(0).cast("long")).otherwise(whole.try_cast("long"))
    spoken = let(F.substring_index(body, ".", 1), lambda whole: F.coalesce(int_to_zh(number(whole)), whole))
    fraction = F.regexp_replace(F.regexp_extract(body, r"\.(.*)\z", 1), "[^0-9]", "")
    return F.concat(spoken, let(fraction, lambda f: F.when(f != "", F.concat(F.lit("点"), digits_to_zh(f))).otherwise("")))


def rewrite(text: Column, pattern: str, spoken: Callable[[Column], Column]) -> Column:
    """text with every match of pattern replaced by spoken(match): gaps and matches, put together again."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    joined = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.when(m.isNotNull(), spoken(m)).otherwise("")))
    return F.when(text.rlike(pattern), F.array_join(joined, "")).otherwise(text)


def _part(match: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(match, pattern, k)


def say_dates(text: Column) -> Column:
    p = lambda m, k: _part(m, _DATE_PARTS, k)
    return rewrite(text, _DATE, lambda m: F.concat(digits_to_zh(p(m, 1)), F.lit("年"), number_to_zh(p(m, 2)), F.lit("月"), number_to_zh(p(m, 3)), F.lit("日")))


def say_percents(text: Column) -> Column:
    return rewrite(text, _PERCENT, lambda m: F.concat(F.lit("百分之"), number_to_zh(_part(m, _PERCENT_PARTS, 1))))


def say_chapters(text: Column) -> Column:
    return rewrite(text, _CHAPTER, lambda m: F.concat(F.lit("第"), number_to_zh(_part(m, _CHAPTER_PARTS, 1)), _part(m, _CHAPTER_PARTS, 2)))


def say_times(text: Column) -> Column:
    p = lambda m, k: number_to_zh(_part(m, _TIME_PARTS, k))
    return rewrite(text, _TIME, lambda m: F.concat(p(m, 1), F.lit("点"), p(m, 2), F.lit("分")))


def say_numbers_between(text: Column) -> Column:
    return rewrite(text, _BETWEEN, number_to_zh)


def tidy_lines(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\R"), strip), lambda x: x != "")
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "[ \t]+", " "))


def normalize(docs: DataFrame, level: str = "basic", text: str = "text") -> DataFrame:
    """Rewrite dates, percents, chapter numbers, times and numbers between Chinese characters, in this order."""
    if level not in LEVELS:
        raise ValueError(f"unknown normalisation level {level!r}; use one of {', '.join(LEVELS)}")
    if level == "off":
        return docs
    for step in (say_dates, say_percents, say_chapters, say_times, say_numbers_between, tidy_lines):
        docs = docs.withColumn(text, step(F.col(text)))  # a column of its own each, so that none is computed twice
    return docs
