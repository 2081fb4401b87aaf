"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a DataFrame expression over the text's words and lines; a rule
is a row of RULES, and the verdict is the conjunction of all rows, evaluated in
one pass without a shuffle and without user functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Words in a window of which a repetition counts; a power of two, see measure.
WINDOW = 8
#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in a is that it for was on with as be by at from this are "
    "le la les de des et un une en est que dans du pour qui au pas sur avec "
    "el los las y del se por con una su para es lo como "
    "der die das und den von zu mit im auf ist des dem nicht ein eine als auch für sich"
).split()
#: Measure, least and greatest value (None: no bound), for texts that pass the two base rules.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("mean_word_length", 2.0, 15.0),
    ("symbol_ratio", None, 0.3),
    ("stop_word_ratio", 0.04, None),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
    ("duplicate_line_ratio", None, 0.5),
    ("letter_ratio", 0.6, None),
    ("adjacent_repeat_ratio", None, 0.3),
)


#: Columns that measure adds.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "mean_word_length", "symbol_ratio", "stop_word_ratio",
    "letter_ratio", "adjacent_repeat_ratio", "duplicate_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio",
)


def _repeated_starts(order: str) -> Column:
    """Starts of the windows whose hash is found twice or more; order names the sorted (hash, start) array."""
    here = lambda j: F.get(F.col(order), j)
    twice = F.filter(
        F.col(order),
        lambda x, j: (x["v"] == here(j - 1)["v"]) | (x["v"] == here(j + 1)["v"]),
    )
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _joined(source: str, half: int) -> Column:
    """For each place, one hash of the entries there and half places further on."""
    rest = F.slice(source, F.lit(half + 1), F.greatest(F.size(source), F.lit(1)))
    return F.zip_with(source, rest, lambda a, b: F.xxhash64(a, b))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measure(docs: DataFrame) -> DataFrame:
    """Add to docs (of which text is used) the measures that rules refer to.

    Null texts are empty texts; a text without words has ratios 0. Each row is
    measured by itself, so ties and repeated rows need no care, and an empty
    table gives no rows. A column of docs that bears a measure's name, in any
    case, is replaced; all others stay, whatever their names.
    """
    carried = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in MEASURES]
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.struct(*carried).alias("_row"), text.alias("_t"), words(F.col("text")).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumns(
        {
            "_l": lines,
        }
    )
    # Hashes of two words, of four and of eight: each from two hashes of half the length.
    for source, half in (("_w", 1), ("_h", 2), ("_h", 4)):
        base = base.withColumn("_h", _joined(source, half))
    base = base.withColumn("_h", F.slice("_h", F.lit(1), F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0))))
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    base = base.withColumn(
        "_o",
        F.when(again, F.sort_array(F.transform("_h", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))),
    )
    base = base.withColumn("_s", F.when(F.col("_o").isNotNull(), _repeated_starts("_o")))
    reach = F.transform(
        F.col("_s"),
        lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_s"), j + 1), p + WINDOW) - p),
    )
    n = F.size("_w").cast("long")
    counted = {
        "n_words": n,
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        "_stop": F.size(F.filter("_w", lambda x: F.lower(x).isin(*STOP_WORDS))),
        "_letters": F.length(F.regexp_replace("_t", r"\P{L}+", "")),
        "_echo": F.size(F.filter("_w", lambda x, j: x == F.get(F.col("_w"), j - 1))),
        "_bullet": F.size(F.filter("_l", lambda x: x.rlike(r"^[\x20\t]*[-*•]"))),
        "_dots": F.size(F.filter("_l", lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\t\r]*$"))),
    }
    base = base.withColumns(counted)
    n, lines_ = F.col("n_words"), F.col("n_lines")
    ratios = {
        "mean_word_length": _ratio(F.col("word_chars"), n),
        "symbol_ratio": _ratio(F.col("n_symbols"), n),
        "stop_word_ratio": _ratio(F.col("_stop"), n),
        "letter_ratio": _ratio(F.col("_letters"), F.col("word_chars")),
        "adjacent_repeat_ratio": _ratio(F.col("_echo"), n),
        "duplicate_line_ratio": _ratio(F.col("n_dup_lines"), lines_),
        "bullet_line_ratio": _ratio(F.col("_bullet"), lines_),
        "ellipsis_line_ratio": _ratio(F.col("_dots"), lines_),
    }
    return base.withColumns(ratios).select("_row.*", *MEASURES)


def verdict(rules=RULES) -> Column:
    """True where every rule of the table holds."""
    ok = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            ok = ok & (F.col(name) >= F.lit(least))
        if most is not None:
            ok = ok & (F.col(name) <= F.lit(most))
    return ok


def judge_quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """Add the measures, base_failed and kept to docs; see measure for odd inputs.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated
    windows of eight. kept: not base_failed, and every rule of the table holds.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = measure(docs).withColumn("base_failed", failed)
    # A row number is never negative, but Spark doesn't know: it won't push a later filter below the measures, where it
    # would write out every measure's whole expression for each of its uses.
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules) & (F.monotonically_increasing_id() >= 0))


def kept_documents(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that judge_quality keeps, with all their columns, whatever their names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return judge_quality(docs.select(whole, "text"), rules).filter("kept").select("_row.*")
