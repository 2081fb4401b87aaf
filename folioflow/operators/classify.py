"""Block classification: features, score and class, then two passes over neighbours, then the verdict."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T

#: What a block's class means for the next block, by digit; any other class is 0.
STATES = {"near_good": "1", "good": "2"}
#: Blocks that are folded at once.
FOLD = 512


def with_levels(blocks: DataFrame, levels: Sequence[str] = (C.DEFAULT_LEVEL,)) -> DataFrame:
    """Every block once per strictness level, with the level's thresholds as columns."""
    for level in levels:
        C.check_level(level)
    rows = [
        F.struct(F.lit(level).alias("strictness"), *[F.lit(float(v)).alias(n) for n, v in zip(C.LEVEL_FIELDS, C.LEVELS[level], strict=True)])
        for level in levels
    ]
    return blocks.withColumn("_level", F.explode(F.array(*rows))).select(*blocks.columns, "_level.*")


def features(blocks: DataFrame) -> DataFrame:
    """Normalise text and add wrapped, link_density, punct_density, stopword_density, noise, n_words and others.

    These don't depend on a level, so they are computed once for all levels.
    """
    out = blocks.withColumn("wrapped", T.was_wrapped(F.col("text")))
    out = out.withColumn("text", T.unparenthesise(T.unwrap(F.col("text"))))
    text = F.col("text")
    return out.withColumns(
        {
            "n_chars": F.length(text).cast("long"),
            "link_density": T.ratio(F.col("link_chars"), F.col("total_chars"), None),
            "punct_density": T.ratio(T.count(text, C.PUNCTUATION), F.length(text), None),
            "stopword_density": T.stopword_density(text),
            "noise": T.is_noise(text),
            "sentence_like": text.rlike(C.SENTENCE_END),
            "cjk": text.rlike(C.CJK),
            "n_words": T.english_words(text).cast("long"),
            "heading_like": T.is_standalone_heading(text),
            "short_toc": T.matches(text, C.SHORT_TOC_EN, True),
        }
    )


def classify(featured: DataFrame) -> DataFrame:
    """Add score, classification and reason by the thresholds that with_levels added."""
    n, marker = F.col("n_chars"), F.col("wrapped") & (F.col("text") == "")
    many_links = F.col("link_density") > F.col("max_link_density")
    few_marks = (F.col("punct_density") < F.col("min_punct_density")) & (n >= F.col("low_length"))
    score = (
        F.when(n >= F.col("high_length"), 2.0).when(n >= F.col("low_length"), 1.0).otherwise(0.0)
        + F.when(many_links, -2.0).otherwise(0.0)
        + F.when(few_marks, -1.0).otherwise(0.0)
        + F.when(F.col("stopword_density") >= F.col("min_stopword_density"), 0.5).otherwise(0.0)
        + F.when(F.col("sentence_like"), 0.5).otherwise(0.0)
        + F.when(F.col("is_heading"), 0.3).otherwise(0.0)
    )
    out = featured.withColumn("score", F.when(marker | F.col("noise"), -10.0).otherwise(score))
    for name in ("link_density", "punct_density", "stopword_density"):
        out = out.withColumn(name, F.when(marker, 0.0).otherwise(F.col(name)))
    reason = (
        F.when(marker, "decorative_wrapper_marker")
        .when(F.col("noise"), "noise_pattern")
        .when(few_marks, "low_punctuation_density")
        .when(many_links, "high_link_density")
        .otherwise("content_like")
    )
    kind = (
        F.when(marker | F.col("noise"), "bad")
        .when(n < F.col("short_length"), "short")
        .when(F.col("score") >= F.col("good_score"), "good")
        .when(F.col("score") <= F.col("bad_score"), "bad")
        .otherwise("near_good")
    )
    return out.withColumn("classification", kind).withColumn("reason", reason)


def _content(kind: Column) -> Column:
    return F.coalesce(kind.isin("good", "near_good"), F.lit(False))


def _pass_one(name: Callable[[str], Column], before: Column) -> Column:
    """New (classification, reason) of a block whose facts name gives, given the new class of the block before it."""
    x = {k: name(k) for k in ("next_good", "heading_like", "next_content", "is_heading", "fixed", "suffix", "lenient", "classification", "reason")}
    after_content = _content(before)
    surrounded = F.coalesce(before == "good", F.lit(False)) & x["next_good"]
    reason = (
        F.when(x["heading_like"] & ~after_content & x["next_content"], "chapter_heading_with_content_context")
        .when(x["is_heading"] & x["next_content"], "heading_with_content_context")
        .when(surrounded, "surrounded_by_content")
        .when(x["fixed"].isNotNull(), x["fixed"])
        .when(x["suffix"] & after_content, "short_suffix_for_content")
        .when(x["lenient"], "conservative_short_keep")
    )
    rescued = (x["classification"] == "short") & reason.isNotNull()
    kind = F.when(rescued, "near_good").otherwise(x["classification"])
    promoted = (kind == "near_good") & after_content & x["next_content"]
    return F.struct(
        F.when(promoted, "good").otherwise(kind).alias("classification"),
        F.when(promoted, "context_promoted").when(rescued, reason).otherwise(x["reason"]).alias("reason"),
    )


def _states(maps: Column) -> Column:
    """For each block its before state, from what each block makes of the three states; one string.

    The blocks are folded in runs, each from every state, and then the runs; so
    the work grows with the number of blocks.
    """

    def fold(run: Column, start: Column) -> Column:
        step = lambda a, m: F.struct(
            F.substring(m, a["at"].cast("int") + 1, F.lit(1)).alias("at"), F.concat(a["seen"], a["at"]).alias("seen")
        )
        return F.aggregate(run, F.struct(start.alias("at"), F.lit("").alias("seen")), step)

    firsts = F.sequence(F.lit(1), F.size(maps), F.lit(FOLD))
    runs = F.transform(firsts, lambda k: F.transform(F.array(*map(F.lit, "012")), lambda s: fold(F.slice(maps, k, F.lit(FOLD)), s)))
    begin = F.struct(F.lit("0").alias("at"), F.lit("").alias("seen"))
    follow = lambda a, r: T.let(
        F.get(r, a["at"].cast("int")), lambda v: F.struct(v["at"].alias("at"), F.concat(a["seen"], v["seen"]).alias("seen"))
    )
    return F.when(F.size(maps) <= FOLD, fold(maps, F.lit("0"))["seen"]).otherwise(F.aggregate(runs, begin, follow)["seen"])


def first_pass(classified: DataFrame, key: str = "page_id") -> DataFrame:
    """The first pass over neighbours, for each key and strictness; adds prefix, suffix and other facts.

    It depends on the rewritten block before, of which only three states matter:
    each block's outcome for all three is computed as columns, and a fold over
    these digits tells which holds.
    """
    by = [key, "strictness"]
    w = Window.partitionBy(*by).orderBy("block_index")
    text_ok, strict = ~F.col("short_toc"), F.col("strictness") == "aggressive"
    next_content = _content(F.lead("classification").over(w))
    pair_next = F.coalesce(F.col("n_words") + F.lead("n_words").over(w) >= 6, F.lit(False))
    pair_before = F.coalesce(F.col("n_words") + F.lag("n_words").over(w) >= 6, F.lit(False))
    prefix = ~strict & (F.col("n_words") >= 2) & pair_next & text_ok
    fixed = (
        F.when(F.col("sentence_like") & (F.col("n_chars") >= 4), "short_but_sentence_like")
        .when(F.col("cjk") & (F.col("n_chars") >= 4) & ~F.col("noise"), "short_cjk_content_like")
        .when(~strict & (F.col("n_words") >= 4) & (F.col("stopword_density") >= 0.12) & text_ok, "short_en_content_like")
        .when(prefix & next_content, "short_prefix_for_content")
    )
    facts = classified.withColumns(
        {
            "next_content": next_content,
            "next_good": F.coalesce(F.lead("classification").over(w) == "good", F.lit(False)),
            "fixed": fixed,
            "prefix": prefix,
            "suffix": ~strict & (F.col("n_words") >= 2) & pair_before & text_ok,
            "lenient": F.col("strictness") == "conservative",
        }
    )
    digit = lambda kind: F.when(kind == "good", "2").when(kind == "near_good", "1").otherwise("0")
    befores = [F.lit(None).cast("string"), F.lit("near_good"), F.lit("good")]
    facts = facts.withColumn("_map", F.concat(*[digit(_pass_one(F.col, x)["classification"]) for x in befores]))
    others = [c for c in facts.columns if c not in (*by, "block_index")]
    rows = F.sort_array(F.collect_list(F.struct("block_index", *others)))
    folded = facts.groupBy(*by).agg(rows.alias("_rows")).withColumn("_maps", F.transform("_rows", lambda r: r["_map"]))
    folded = folded.withColumn("_before", F.split(_states(F.col("_maps")), ""))
    out = folded.select(*by, F.explode(F.arrays_zip("_rows", "_before")).alias("_z")).select(*by, "_z._rows.*", "_z._before").drop("_map")
    before = F.when(F.col("_before") == "2", "good").when(F.col("_before") == "1", "near_good")
    out = out.withColumn("_new", _pass_one(F.col, before)).drop("_before")
    out = out.withColumn("classification", F.col("_new.classification")).withColumn("reason", F.col("_new.reason")).drop("_new")
    return out


def second_pass(out: DataFrame, key: str = "page_id") -> DataFrame:
    """The second pass, over blocks that the first one left short; adds _open, which tells these.

    A run of blocks that can follow content inherits the verdict on what stands
    before the run, by a window.
    """
    w, strict = Window.partitionBy(key, "strictness").orderBy("block_index"), F.col("strictness") == "aggressive"
    short = (F.col("classification") == "short") & ~strict
    leads = F.col("prefix") & _content(F.lead("classification").over(w))
    mark = (
        F.when(~short, _content(F.col("classification")).cast("int"))
        .when(leads, 1)
        .when(F.col("suffix"), F.lit(None))
        .otherwise(0)
    )
    out = out.withColumns({"_open": short, "_leads": short & leads, "_mark": mark})
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    verdict = F.coalesce(F.last("_mark", ignorenulls=True).over(running), F.lit(0)) == 1
    out = out.withColumn("_verdict", verdict & F.col("_open"))
    reason = F.when(F.col("_leads"), "short_prefix_for_content").when(F.col("_verdict"), "short_suffix_for_content")
    out = out.withColumn("reason", F.coalesce(reason, "reason"))
    return out.withColumn("classification", F.when(F.col("_verdict"), "near_good").otherwise(F.col("classification"))).drop("_leads", "_mark", "_verdict")


def reclassify(classified: DataFrame, key: str = "page_id") -> DataFrame:
    """Both passes over neighbours, for each key and strictness."""
    out = second_pass(first_pass(classified, key), key)
    return out.drop("_open", "next_content", "next_good", "fixed", "prefix", "suffix", "lenient")


def decide(reclassified: DataFrame) -> DataFrame:
    """Add keep."""
    doubtful = (F.col("strictness") == "aggressive") & F.col("reason").isin("high_link_density", "low_punctuation_density")
    keep = (F.col("classification") == "good") | ((F.col("classification") == "near_good") & ~doubtful)
    return reclassified.withColumn("keep", keep)


def judged_blocks(blocks: DataFrame, levels: Sequence[str] = (C.DEFAULT_LEVEL,), key: str = "page_id") -> DataFrame:
    """Blocks with features, class, reason and keep at each of levels."""
    return decide(reclassify(classify(with_levels(features(together(blocks, key)), levels)), key))


def together(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Blocks with those of a key in one partition, in which all passes over neighbours then find them.

    The one shuffle comes before features and levels, which make rows wider and more.
    """
    return blocks.repartition(key)
