"""Readability of texts, by array functions inside each row: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import ratio, rounded, strip


def percentile(lengths: Column, percent: int) -> Column:
    """Nearest-rank percentile of an array of numbers; 0 if it is empty."""
    ordered = F.sort_array(lengths)
    rank = F.greatest(F.ceil(F.lit(percent) * F.size(lengths) / F.lit(100.0)).cast("int"), F.lit(1))
    return F.when(F.size(lengths) > 0, F.element_at(ordered, F.least(rank, F.size(lengths)))).otherwise(0)


#: Stands for any end mark while lengths are taken; a character that no text should hold.
_MARK = "\ufdd0"


def split_lines(text: Column) -> Column:
    """Lines as str.splitlines has them, blank ones included; splitting at one character is faster than by a pattern."""
    return F.split(F.translate(text, C.LINE_ENDS, "\n" * len(C.LINE_ENDS)), "\n")


def sentence_lengths(text: Column) -> Column:
    """Lengths of the stripped sentences: runs without end marks, each with the mark behind it; of the whole text if there is none."""
    marked = F.translate(text, _MARK + C.SENTENCE_MARKS, "x" + _MARK * len(C.SENTENCE_MARKS))
    pieces = F.split(F.replace(marked, F.lit(_MARK), F.lit(_MARK + "\n")), "\n")
    lengths = F.filter(F.transform(pieces, lambda s: F.when(s != _MARK, F.length(strip(s)))), lambda n: n > 0)
    return F.when((F.size(lengths) == 0) & (text != ""), F.array(F.length(text))).otherwise(lengths)


def readability(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the thirteen readability columns. Null texts count as empty ones."""
    out = docs.withColumn("_text", strip(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("_lengths", sentence_lengths(F.col("_text")))
    size = F.length("_text").cast("long")
    lines = F.filter(split_lines(F.col("_text")), lambda x: strip(x) != "")
    odd = F.aggregate(F.regexp_extract_all("_text", F.lit(C.ABNORMAL), 0), F.lit(0), lambda a, x: a + F.length(x))
    total = F.aggregate("_lengths", F.lit(0), lambda a, x: a + x)
    many = F.size(F.filter("_lengths", lambda x: x > C.OVERLONG_SENTENCE)).cast("long")
    # The class of all digits is slow, so only what is not ASCII is held against it.
    ascii_only = F.octet_length("_text") == F.length("_text")
    others = F.when(ascii_only, 0).otherwise(F.regexp_count(F.regexp_replace("_text", r"[\x00-\x7f]+", ""), F.lit(C.DIGIT)))
    numbers = F.regexp_count("_text", F.lit("[0-9]")) + others
    sentences = F.size("_lengths").cast("long")
    out = out.withColumns(
        {
            "paragraph_count": F.size(lines).cast("long"),
            "sentence_count": sentences,
            "avg_sentence_length": rounded(total / F.greatest(sentences, F.lit(1)), 3),
            "p95_sentence_length": percentile(F.col("_lengths"), 95).cast("long"),
            "max_sentence_length": F.coalesce(F.array_max("_lengths"), F.lit(0)).cast("long"),
            "overlong_threshold": F.lit(C.OVERLONG_SENTENCE),
            "overlong_sentence_count": many,
            "overlong_sentence_ratio": ratio(many, sentences),
            "abnormal_symbol_count": odd.cast("long"),
            "abnormal_symbol_ratio": ratio(odd, size),
            "numeric_token_count": F.regexp_count("_text", F.lit(C.NUMERIC)).cast("long"),
            "numeric_char_count": numbers.cast("long"),
            "numeric_char_ratio": ratio(numbers, size),
        }
    )
    return out.drop("_text", "_lengths")
