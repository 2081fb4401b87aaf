"""Thresholds, word lists and patterns of the cleaning rules.

Patterns are written so that Java and RE2 read them alike; Spark adds (?U).
"""

from __future__ import annotations

# Strictness levels.
LEVEL_FIELDS = (
    "short_length", "low_length", "high_length", "max_link_density", "min_punct_density",
    "min_stopword_density", "good_score", "bad_score",
)
LEVELS: dict[str, tuple[float, ...]] = {
    "conservative": (18, 60, 180, 0.55, 0.003, 0.005, 0.5, -2.5),
    "balanced": (25, 70, 200, 0.35, 0.004, 0.008, 1.0, -2.0),
    "aggressive": (35, 80, 220, 0.25, 0.005, 0.01, 1.2, -1.5),
}
DEFAULT_LEVEL = "balanced"

# Tags.
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCK_TAGS = ("p", "div", *HEADING_TAGS, "li", "br", "hr")
DROPPED_TAGS = (
    "script", "style", "noscript", "iframe", "object", "embed", "param", "source", "track", "canvas", "svg",
    "math", "template", "slot",
)
FALLBACK_TAGS = ("title", "p", "h1", "h2", "h3", "h4", "li", "div")

# Words.
ZH_HINTS = tuple("的 了 是 在 和 与 及 并 而 但 如果 因为 所以 我们 他们 你们 这 那".split())
EN_STOPWORDS = tuple(
    "the a an and or but if then than to of for on in at by with is are was were be been it this that these those "
    "as from we you they he she".split()
)
WRAPPER_MARKERS = ("正文", "简介", "内容简介", "正文开始")
NON_CONTENT_STEMS = tuple(
    "nav toc table-of-contents contents landmarks page-list pagelist cover copyright titlepage imprint".split()
)
NON_CONTENT_TOKENS = tuple("nav toc contents landmarks pagelist page-list tableofcontents table-of-contents".split())

# The characters that str.strip takes away.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

#: Line ends besides the line feed.
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# Patterns.
_LEADER = r"(?:\.{2,}|_{2,}|-{2,}|…{2,}|·{2,}|⋯{2,})\s*\d{1,4}"
_ZH_NUMBER = "[0-9一二三四五六七八九十百千万零〇两]+"
_ZH_UNIT = "[章节卷部篇回]"
TOC_HEADER = r"^(?:目录|目次|contents?|table of contents)\z"
DECORATION = r"^[_\-=~*#·.•⋯…]{3,}\z"
PAGE_NUMBER = r"^(?:page\s*)?\d{1,4}\z"
TOC_LEADER = rf"^.{{1,120}}{_LEADER}\z"
TOC_ENTRY_ZH = rf"^第?{_ZH_NUMBER}{_ZH_UNIT}\s*.*{_LEADER}\z"
TOC_ENTRY_EN = rf"^(?:chapter|section|part|book|appendix)\b.*{_LEADER}\z"
SHORT_TOC_EN = r"^(?:chapter|section|part|book)\s+(?:[ivxlcdm]+|\d+)\b"
HEADING_EN = r"^(?:chapter|section|part|book|appendix)\s+(?:[ivxlcdm]+|\d+)\b(?:\s+[^\n]{1,80})?\z"
HEADING_ZH = rf"^第?{_ZH_NUMBER}{_ZH_UNIT}(?:\s+[^\n]{{1,40}})?\z"
_SIDE = r"[-_=~*#]{2,}"
GENERIC_WRAPPED = rf"{_SIDE}\s*(?:{'|'.join(WRAPPER_MARKERS)})\s*{_SIDE}"
ANY_WRAPPED = rf"{_SIDE}\s*([^\n]{{1,80}}?)\s*{_SIDE}"
TITLE_IN_PARENS = r"[（(]\s*《([^》]{1,120})》\s*[）)]"
PUNCTUATION = "[。！？!?;；:,，.]"
SENTENCE_END = "[。！？!?]"
EN_WORD = "[A-Za-z]+"
CJK = r"[\x{4e00}-\x{9fff}]"
SENTENCE_MARKS = "。！？!?；;"
SENTENCE = rf"[^\n{SENTENCE_MARKS}]+[{SENTENCE_MARKS}]?"
ABNORMAL = r"[*#=_~]{3,}|\x{fffd}"
#: Decimal digits, and the superscript, subscript, circled and other digits of Unicode beside them.
DIGIT = (
    r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}"
    r"\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}"
    r"\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]"
)
NUMERIC = r"\d[\d,.:/\-]*"
BREAKS = "。！？!?；;：:\n，,、)]】》」』 "

# Limits of the reports.
OVERLONG_SENTENCE, ULTRA_SHORT, LIST_CAP, SAMPLE_CHARS, TITLE_CHARS = 120, 120, 20, 200, 50
FALSE_DROP_RETENTION, FALSE_DROP_CHARS = 0.6, 120
FALSE_KEEP_ABNORMAL, FALSE_KEEP_NUMERIC = 0.003, 0.05
SEGMENT_CHARS = 500
CLIP_LEVEL, SILENCE_LEVEL, HIGH_SILENCE = 0.999, 0.001, 0.2
AUDIO_SUFFIXES = (".wav", ".flac", ".aiff", ".aif", ".ogg", ".opus", ".mp3", ".m4a", ".aac")

# Chinese numerals.
ZH_DIGITS = "零一二三四五六七八九"
ZH_GROUPS = ("", "万", "亿", "兆")


def check_level(level: str) -> None:
    if level not in LEVELS:
        raise ValueError(f"unknown strictness {level!r}; use one of {', '.join(LEVELS)}")
