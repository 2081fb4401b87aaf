"""URL filters: pattern rules that are found by their rarest literal token.

A rule is a regular expression with the literal tokens that any matching URL
must have. Each rule is indexed by the one of its tokens that is rarest among
the URLs; a URL's tokens then fetch the few rules that may match, and only those
run their regular expressions.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tasks import released

#: Rules that a task holds at once; more are applied in several passes over the rows.
MOST_RULES = 500_000
TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """A pattern over host + path (the host in lower case), and what it says: block or allow.

    tokens are the whole tokens that every matching URL has. rank decides among
    the rules that match: the greatest wins, then the longest name.
    """

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    rank: int = 0


def domain_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host and all its subdomains, for the paths that start with path; all paths if it is empty."""
    if path and path[0] != "/":
        raise ValueError(f"the path {path!r} does not start with /")
    whole = re.sub(r"[A-Za-z0-9]+\Z", "", path)  # a URL may go on with the last token
    tokens = tuple(TOKEN.findall(f"{host} {whole}".lower()))
    return Rule(host + path, rf"\A(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path) if path else r'(?=/|\Z)'}", verdict, tokens, rank=1)


def host_word_rule(word: str, verdict: str = "block") -> Rule:
    """A rule for hosts that have word as a label or as a part of one between hyphens."""
    return Rule(word, rf"\A(?:[^/?#]*[.-])?{re.escape(word)}(?:[.-][^/?#]*)?(?:/|\Z)", verdict, tuple(TOKEN.findall(word)))


#: The domain rules decide before the word rules, which block advertising and spam hosts.
RULES: tuple[Rule, ...] = (
    domain_rule("com", "/en/", "block"),
    domain_rule("example.com", "/en/7", "allow"),
    domain_rule("net", "/de/", "allow"),
    domain_rule("example.net", "/de/8", "block"),
    domain_rule("org", "/es/", "block"),
    *(host_word_rule(x) for x in ("ads-track", "spam-farm", "doubleclick", "adserver", "clickbait", "malware", "phishing")),
)


def read_rules(table: DataFrame) -> list[Rule]:
    """Rules of a table with kind (domain or word), host (or the word), path and verdict, in a defined order.

    They come to the driver, as the index is built there; a null path is empty.
    """
    rows = table.select("kind", "host", F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    make = {"domain": lambda r: domain_rule(r["host"], r["path"], r["verdict"]), "word": lambda r: host_word_rule(r["host"], r["verdict"])}
    return [make[r["kind"]](r) for r in rows.orderBy("kind", "host", "path", "verdict").collect()]


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z in lower case; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def token_counts(pages: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """How many URLs have each token that the rules use; at most one row per such token comes back."""
    used = sorted({t for r in rules for t in r.tokens})
    if not used:
        return {}
    spark = pages.sparkSession
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), 0))
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in used], "token string"))
    counted = pages.select(F.explode(tokens).alias("token")).join(wanted, "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}


def _order(rank: int, name: str, verdict: str) -> tuple[int, int, str, str]:
    """Of the rules that match, the one that is greatest by this decides."""
    return rank, len(name), name, verdict


#: What a pass hands on: the best rule so far by rank, length of its name and name.
_JUDGED = "page_id long, host string, path string, rank int, name string, said string, candidates int"


def _pass(rows: DataFrame, rules: Sequence[Rule], counts: dict[str, int]) -> DataFrame:
    """rows with the best of their own rule and rules."""
    index: dict[str, list[Rule]] = defaultdict(list)
    for r in rules:
        index[min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(r)
    shared = rows.sparkSession.sparkContext.broadcast(dict(index))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        run: dict[Rule, re.Pattern] = {}
        names = [x.split()[0] for x in _JUDGED.split(", ")]
        for b in batches:
            out: list[list] = [[], [], [], []]
            for host, path, *best, tried in zip(*(b.column(c).to_pylist() for c in names[1:]), strict=True):
                where = host + path
                found = [r for t in {"", *TOKEN.findall(where.lower())} for r in index.get(t, ())]
                for r in found:
                    if r not in run:
                        run[r] = re.compile(r.pattern)
                    if run[r].search(where) and (best[0] is None or _order(r.rank, r.name, r.verdict) > _order(*best)):
                        best = [r.rank, r.name, r.verdict]
                for column, value in zip(out, (*best, tried + len(found)), strict=True):
                    column.append(value)
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int32())
            columns = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:3]), *columns], names)

    return rows.mapInArrow(released(judge), _JUDGED)


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, candidates.

    host is the URL's part after the first :// up to /, ?, # or the end, with
    A-Z in lower case; path goes on to ?, # or the end. A null URL or one without
    :// has both empty. rule: the domain rule that decided, else null; verdict:
    its verdict, else that of the word rules, else default. candidates: rules
    that the URL's tokens fetched. Rows are judged one by one, so ties and
    repeated rows need no care; an empty table gives no rows; other columns of
    pages, whatever their names, are left out.
    """
    counts = token_counts(pages, rules)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url_host(F.col("url").cast("string")).alias("host"), url_path(F.col("url").cast("string")).alias("path"),
        F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("said"), F.lit(0).alias("candidates"),
    )
    for k in range(0, max(len(rules), 1), MOST_RULES):
        rows = _pass(rows, rules[k : k + MOST_RULES], counts)
    decided = F.when(F.col("rank") > 0, F.col("name"))
    return rows.select("page_id", "host", "path", decided.alias("rule"), F.coalesce("said", F.lit(default)).alias("verdict"), "candidates")
