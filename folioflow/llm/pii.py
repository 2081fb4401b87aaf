"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is a DataFrame expression. A pattern's matches and the gaps between
them come from the same regular expression (extract and split), so adding up
their lengths gives each match's place in code points. Patterns use possessive
repeats and start only at the edge of a run or at the end of the match before,
which finds the same leftmost matches in linear time on very long runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters on either side of a span in which context words are looked for.
CONTEXT = 48
#: A proposed span of a kind that is not a base kind is kept from this score on.
THRESHOLD = 0.7


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    pattern proposes spans; gate is a cheap test that any text with a match
    passes; check confirms a match (a failing match is dropped and not tried
    again); base kinds stay whatever their score; prior is the score before
    context, and context a pattern of words that add bonus to it.
    """

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    check: Callable[[Column], Column]
    base: bool
    prior: float
    context: str
    bonus: float = 0.4


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes the Luhn test: every second digit from the right counts twice."""
    back = F.split(F.reverse(number), "")
    value = lambda x, i: F.when(
        i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), x.cast("int") + 1)
    ).otherwise(x.cast("int"))
    values = F.transform(F.filter(back, lambda x: x != ""), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """True if an account number, its first four characters moved to the end, leaves 1 by 97."""
    bare = F.upper(F.replace(account, F.lit(" "), F.lit("")))
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda x: x != "")

    def step(a: Column, x: Column) -> Column:
        code = F.ascii(x)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.aggregate(chars, F.lit(0), step) == 1


_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_LOCAL = "A-Za-z0-9._%+-"
_PHONE_WORDS = r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|fax|whatsapp|teléfono|téléphone|telefon)\b"

#: The base kinds come first, in the order in which spans with the same start are listed.
KINDS: tuple[Kind, ...] = (
    Kind(
        "email",
        rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"),
        lambda m: F.lit(True),
        True,
        0.9,
        r"(?i)\b(?:e-?mail|contact|correo|courriel)\b",
    ),
    Kind(
        "ip",
        r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}\z"),
        True,
        0.8,
        r"(?i)\b(?:ip|host|server|address|client)\b",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        lambda m: F.length(digits(m)).between(14, 19) & luhn(digits(m)),
        True,
        0.8,
        r"(?i)\b(?:card|visa|mastercard|credit|debit|payment|tarjeta|carte|karte)\b",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: t.rlike(r"\+[0-9]"),
        lambda m: F.length(digits(m)).between(10, 15),
        True,
        0.8,
        _PHONE_WORDS,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
        mod97,
        False,
        0.8,
        r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        lambda m: F.lit(True),
        False,
        0.4,
        r"(?i)\b(?:ssn|social security|taxpayer)\b",
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
        lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
        lambda m: F.lit(True),
        False,
        0.4,
        _PHONE_WORDS,
    ),
)


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _step(matches: Column, gaps: Column) -> Callable[[Column, Column], Column]:
    """From the start of one match to the start of the next."""
    return lambda x, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0))


#: Matches of which the steps are added up at once.
_RUN = 128


def _total(steps: Column, start: Column, count: Column) -> Column:
    return F.aggregate(F.slice(steps, start, count), F.lit(0), lambda a, v: a + v)


def _runs(steps: Column) -> Column:
    """The sum of each run of _RUN steps."""
    firsts = F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(_RUN))
    return F.transform(firsts, lambda k: _total(steps, k, F.lit(_RUN)))


def _bases(runs: Column) -> Column:
    """The sum of all steps before each run. With the runs' sums, a text with many matches costs little more for each."""
    return F.transform(runs, lambda x, k: _total(runs, F.lit(1), k))


def _span(kind: Kind, rank: int, gaps: Column, steps: Column, bases: Column) -> Callable[[Column, Column], Column]:
    """A match with its place, score and whether the check confirms it."""

    def span(x: Column, i: Column) -> Column:
        start = F.get(bases, F.floor(i / _RUN).cast("int")) + _total(steps, i - i % _RUN + 1, i % _RUN + 1)
        before, after = F.right(F.get(gaps, i), F.lit(CONTEXT)), F.substring(F.get(gaps, i + 1), 1, CONTEXT)
        near = before.rlike(kind.context) | after.rlike(kind.context)
        score = F.lit(kind.prior) + F.when(near, F.lit(kind.bonus)).otherwise(F.lit(0.0))
        return F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            (start + F.length(x)).alias("end"),
            F.lit(kind.name).alias("kind"),
            F.least(score, F.lit(1.0)).alias("score"),
            kind.check(x).alias("valid"),
        )

    return span


def find_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """Add to docs found: an array of (start, rank, end, kind, score), sorted by start and then kind.

    Places are code points, the end is exclusive. A null text is an empty text
    and has no spans, as has an empty one. Rows are handled one by one, so ties
    and repeated rows need no care; an empty table gives no rows. Columns of
    docs named found or starting with _pii are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [k.name for k in kinds]
    out = docs.withColumn("_pii", text)
    raw = {}
    for k in kinds:
        gate = k.gate(F.col("_pii"))
        raw[f"_pii_m_{k.name}"] = F.when(gate, F.regexp_extract_all("_pii", F.lit(k.pattern), 0)).otherwise(_nothing())
    out = out.withColumns(raw)
    gaps = {}
    for k in kinds:
        some = F.size(f"_pii_m_{k.name}") > 0
        gaps[f"_pii_g_{k.name}"] = F.when(some, F.split("_pii", k.pattern, -1)).otherwise(_nothing())
    out = out.withColumns(gaps)
    steps = {}
    for k in kinds:
        m, g = F.col(f"_pii_m_{k.name}"), F.col(f"_pii_g_{k.name}")
        steps[f"_pii_s_{k.name}"] = F.transform(m, _step(m, g))
    out = out.withColumns(steps)
    out = out.withColumns({f"_pii_r_{n}": _runs(F.col(f"_pii_s_{n}")) for n in names})
    out = out.withColumns({f"_pii_b_{n}": _bases(F.col(f"_pii_r_{n}")) for n in names})
    spans = {}
    for rank, k in enumerate(kinds):
        m, g, s, b = (F.col(f"_pii_{x}_{k.name}") for x in "mgsb")

        found = F.transform(m, _span(k, rank, g, s, b))
        keep = (lambda x: x["valid"]) if k.base else (lambda x: x["valid"] & (x["score"] >= threshold))
        spans[f"_pii_f_{k.name}"] = F.filter(found, keep)
    out = out.withColumns(spans)
    out = out.withColumn("found", F.sort_array(F.concat(*[F.col(f"_pii_f_{n}") for n in names])))
    return out.drop("_pii", *[f"_pii_{x}_{n}" for x in "mgsrbf" for n in names])


def join_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with every span of text that find_spans gives replaced by [kind].

    Of overlapping spans the first one stands, then what follows it. Null texts
    stay null.
    """
    found = find_spans(docs, kinds)
    found = found.withColumn("found", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("chosen"))

    def choose(a: Column, x: Column) -> Column:
        ahead = x["start"] >= a["at"]
        return F.struct(
            F.when(ahead, x["end"]).otherwise(a["at"]).alias("at"),
            F.when(ahead, F.array_append(a["chosen"], x)).otherwise(a["chosen"]).alias("chosen"),
        )

    found = found.withColumn("found", F.aggregate("found", start, choose, lambda a: a["chosen"]))
    # Each span with the text between the one before and it.
    before = lambda i: F.coalesce(F.get("found", i - 1)["end"], F.lit(0))
    pieces = F.transform(
        "found", lambda x, i: F.concat(F.substring(F.col("text"), before(i) + 1, x["start"] - before(i)), F.lit("["), x["kind"], F.lit("]"))
    )
    tail = F.substring(F.col("text"), F.get("found", F.size("found") - 1)["end"] + 1, F.length("text"))
    whole = F.concat(F.array_join(pieces, ""), tail)
    return found.withColumn("text", F.when(F.size("found") > 0, whole).otherwise(F.col("text"))).drop("found")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, counts by base kind, base_sha256, spans, and the counts of other kinds.

    See find_spans for odd inputs.
    """
    found = find_spans(docs.select("doc_id", "text"))
    count = lambda n: F.size(F.filter("found", lambda x: x["kind"] == n)).cast("long")
    base = F.filter("found", lambda x: x["rank"] < sum(k.base for k in KINDS))
    return found.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(join_spans(base).cast("binary"), 256).alias("base_sha256"),
        join_spans(F.col("found")).alias("spans"),
        *[count(k.name).alias(f"n_{k.name}") for k in KINDS if not k.base],
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("top_score"),
    )
