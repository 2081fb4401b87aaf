"""HTML to text blocks: tokens by one pattern, folded into blocks inside the row.

A page costs no shuffle, so pages may be a stream. Rules: text pieces are collapsed and joined with one space; every block tag,
start or end, closes the open block; text after an end tag or at the start of a
document makes a block with the tag ``text``; whatever is inside a dropped tag
goes, and a dropped tag that is never closed takes the rest of its document.
"""

from __future__ import annotations

import html as html_entities
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import collapse
from ..session import ship_package

_S = "[" + "".join(f"\\u{ord(c):04x}" for c in C.WHITE_SPACE) + "]"
_NOT_S = "[^" + _S[1:-1]
_AFTER_NAME = r"[\t\n\r\f\x20/>]"
_VALUE = rf"{_S}*+=+{_S}*(?:'[^']*+'|\"[^\"]*+\"|(?!['\"]){_NOT_S}>]*+)"
_ATTRIBUTE = rf"(?<=['\"/{_S[1:-1]}]){_NOT_S}/>]{_NOT_S}/=>]*+"
_GAP = rf"(?:{_S}|/(?!>))*+"
_OPEN = r"<[a-z][^\t\n\r\f\x20/>\x00]*+"
#: A start tag up to its end, as the event parser finds it: a value in quotes may hold >, one without them ends at white space or >.
_TAG = rf"{_OPEN}[/{_S[1:-1]}]*+(?:{_ATTRIBUTE}(?:{_VALUE}{_S}*+)?+{_GAP})*+{_S}*+"
#: One that closes itself; in <a href=x/> the slash is part of the value.
_SELF = rf"{_OPEN}{_GAP}(?:{_ATTRIBUTE}(?:{_VALUE})?+{_GAP})*+/>"
_RAW = "(?:script|style)"
_SECTION = r"\[(?:temp|cdata|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9])"
#: Text at the end of a page that may stop inside a reference.
_CUT_REFERENCE = rf"&[^;&<{_S[1:-1]}]{{0,33}}\z"
#: Whatever is complete: comments, marked sections, declarations, raw elements, tags, end tags, text, and a lone < as text.
_COMPLETE = "|".join(
    (
        rf"<!--.*?--{_S}*>",
        rf"<!\[(?:temp|cdata|ignore|include|rcdata)(?![-_.a-z0-9]).*?\]{_S}*\]{_S}*>",
        rf"<!\[(?:if|else|endif)(?![-_.a-z0-9]).*?\]{_S}*>",
        rf"<!(?!--|{_SECTION})[^>]*+>",
        r"<\?[^>]*+>",
        *(rf"(?=<{name}{_AFTER_NAME})(?!{_SELF}){_TAG}/?>.*?</{_S}*{name}{_S}*>" for name in ("script", "style")),
        rf"(?:(?!<{_RAW}{_AFTER_NAME})|(?={_SELF})){_TAG}(?:/?>|(?=\x00))",
        r"</[^>]*+>",
        rf"(?![^<]*+(?<={_CUT_REFERENCE}))[^<]++",
        r"<(?![!?/a-z]|\z)",
    )
)
#: Group 1 is a complete token; anything else reaches to the end of the page and is held back.
_JAVA_TOKENS = rf"(?is)({_COMPLETE})|.+"
#: Much the same without looking around, for the SQL; what is held back is the last token, if it matches UNFINISHED.
TOKENS = (
    r"(?is)<!--.*?--\s*>|<!\[(?:temp|cdata|ignore|include|rcdata).*?\]\s*\]\s*>|<script\b[^>]*>.*?</\s*script\s*>|<style\b[^>]*>.*?</\s*style\s*>"
    r"|<[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</[^>]*>|<[!?][^>]*>|[^<]+|<[!?/a-z].*|<"
)
UNFINISHED = r"(?is)^(?:<[!?/a-z].*[^>]|<[!?/]?|<!--(?:[^-]|-[^-]|--[^>])*|[^<]*&[^\s;&<]{0,33})$"
_NAME = r"^<([A-Za-z][^\t\n\r\f\x20/>\x00]*)"
#: The name of an end tag, which may follow white space if nothing else does.
_END_NAMES = (rf"^</{_S}*([A-Za-z][-.A-Za-z0-9:_]*){_S}*>\z", r"^</([A-Za-z][^\t\n\r\f\x20/>\x00]*)")


def decode_entities(text: Column) -> Column:
    """Character references by the standard table, in Arrow batches; texts without & go there as nulls."""

    @F.pandas_udf("string")
    def unescape(s: pd.Series) -> pd.Series:
        return s.map(html_entities.unescape, na_action="ignore")

    # Not deterministic for Spark, so that filters on the result don't run it a second time.
    decoded = unescape.asNondeterministic()(F.when(text.contains("&"), text))
    return F.coalesce(decoded, text)


def _tokens(html: str) -> Column:
    """token, kind and name of every complete token of a page, as an array."""
    found = F.filter(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_JAVA_TOKENS), 1), lambda t: t != "")

    def described(token: Column) -> Column:
        text = ~token.startswith("<") | ~token.endswith(">")
        raw = token.rlike(rf"(?is)^<{_RAW}{_AFTER_NAME}.*</{_S}*{_RAW}{_S}*>\z")
        plain, loose = (F.regexp_extract(token, x, 1) for x in _END_NAMES)
        closing = F.when(plain != "", plain).otherwise(loose)
        name = F.lower(F.when(text | raw, "").when(token.startswith("</"), closing).otherwise(F.regexp_extract(token, _NAME, 1)))
        closed = token.endswith("/>") & token.rlike(rf"(?is)^{_SELF}\z")
        kind = F.when(text, "text").when(token.startswith("</"), "end").when(closed, "self").otherwise("start")
        return F.struct(token.alias("token"), kind.alias("kind"), name.alias("name"))

    # A tag without a name is a comment, a declaration or a raw element.
    named = F.transform(found, described)
    return F.transform(named, lambda t: t.withField("kind", F.when((t["name"] == "") & (t["kind"] != "text"), "other").otherwise(t["kind"])))


def html_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, token, kind (text, start, end, self, other) and name of every token.

    A tag, comment, declaration, raw element or reference that the end of the page
    cuts off is no token, nor is what follows it: an event parser that is fed a page
    waits for the rest.
    """
    out = pages.select(F.col(key), F.posexplode(_tokens(html)).alias("pos", "_token"))
    return out.select(key, "pos", "_token.token", "_token.kind", "_token.name")


def _fold(tokens: Iterable[tuple[str, str, str]]) -> list[dict]:
    """The blocks of a page's tokens (token, kind, name), in one pass."""
    out: list[dict] = []
    dropped = links = 0
    open_: dict | None = None
    for token, kind, name in tokens:
        if name in _DROPPED:
            dropped = max(dropped + _STEP.get(kind, 0), 0)
        elif dropped or kind == "other":
            continue
        elif kind == "text":
            piece = " ".join((html_entities.unescape(token) if "&" in token else token).split())
            if piece:
                if open_ is None:
                    open_ = {"tag": "text", "pieces": [], "total_chars": 0, "link_chars": 0}
                    out.append(open_)
                open_["pieces"].append(piece)
                open_["total_chars"] += len(piece)
                open_["link_chars"] += len(piece) * (links > 0)
        elif name == "a":
            links = max(links + _STEP.get(kind, 0), 0)
        elif name in _EDGES:
            open_ = None
            if kind == "start":
                open_ = {"tag": name, "pieces": [], "total_chars": 0, "link_chars": 0}
                out.append(open_)
    blocks = []
    for x in out:
        text = " ".join(x.pop("pieces"))
        if text:
            blocks.append(x | {"text": text, "total_chars": max(x["total_chars"], len(text))})
    return blocks


_STEP = {"start": 1, "end": -1}
_DROPPED, _EDGES = frozenset(C.DROPPED_TAGS), frozenset(C.BLOCK_TAGS)
_BLOCK = pa.struct([("tag", pa.string()), ("text", pa.string()), ("total_chars", pa.int64()), ("link_chars", pa.int64())])


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, block_index (from 0), tag, text, total_chars, link_chars, is_heading of every block with text.

    Null and blank documents have no blocks. Each row is a document of its own, even
    if its key repeats. Works on streams; the only Python is the fold over a row's
    tokens, in Arrow batches, where character references are decoded too.
    """

    @F.arrow_udf("array<struct<tag:string,text:string,total_chars:bigint,link_chars:bigint>>")
    def fold(tokens: pa.Array) -> pa.Array:
        flat = tokens.flatten()
        columns = [flat.field(c) for c in ("token", "kind", "name")]
        at, out = 0, []
        for n in tokens.value_lengths().fill_null(0).to_pylist():
            # Python objects of one page at a time.
            out.append(_fold(zip(*(c.slice(at, n).to_pylist() for c in columns), strict=True)))
            at += n
        return pa.array(out, pa.list_(_BLOCK))

    ship_package(pages.sparkSession)
    # Not deterministic for Spark, so that filters on the result don't run it a second time.
    folded = pages.select(F.col(key), fold.asNondeterministic()(_tokens(html)).alias("_blocks"))
    out = folded.select(key, F.posexplode("_blocks").alias("block_index", "_block"))
    return out.select(
        key,
        "block_index",
        "_block.tag",
        "_block.text",
        "_block.total_chars",
        "_block.link_chars",
        F.col("_block.tag").isin(*C.HEADING_TAGS).alias("is_heading"),
    )


def regex_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Blocks of the fallback scan: the contents of each of a few tags, tag by tag, else all of the text."""
    text = F.coalesce(F.col(html), F.lit(""))
    for raw in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{raw}[^>]*>.*?</{raw}>", "")
    bare = lambda x: collapse(F.regexp_replace(x, "<[^>]+>", " "))
    found = [
        F.transform(F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), 1), bare)
        for tag in C.FALLBACK_TAGS
    ]
    parts = F.filter(F.concat(*found), lambda x: x != "")
    whole = F.filter(F.array(bare(text)), lambda x: x != "")
    out = pages.select(F.col(key), parts.alias("_parts"), whole.alias("_whole"))
    chosen = F.when(F.size("_parts") > 0, F.col("_parts")).otherwise(F.col("_whole"))
    return out.select(key, F.posexplode(chosen).alias("block_index", "text")).select(
        key,
        "block_index",
        F.lit("regex").alias("tag"),
        "text",
        F.length("text").cast("long").alias("total_chars"),
        F.lit(0).cast("long").alias("link_chars"),
        F.lit(False).alias("is_heading"),
    )


def html_preview(pages: DataFrame, max_chars: int = 1000, key: str = "page_id", html: str = "html") -> DataFrame:
    """Length and first characters of each document, for a look at odd input."""
    text = F.coalesce(F.col(html), F.lit(""))
    size = F.length(text)
    return pages.select(key, size.alias("chars"), F.substring(text, 1, max_chars).alias("head"), (size > max_chars).alias("cut"))

