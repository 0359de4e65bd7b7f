"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, modulo 97) and value ranges confirm them, and words nearby
raise or lower the score. Repeated groups in the patterns are possessive and runs are entered only at their
start, so long texts cost linear time and no deep recursion.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spans folded at a time; keeps the cost of very many spans in one text far below their square.
FOLD = 256
#: Characters before and after a span that are searched for context words.
BEFORE, AFTER = 48, 24
#: Spans of the added kinds stay from this score on.
LEAST_SCORE = 0.5
CONTEXT_STEP = 0.25


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip(value: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def _card(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)


def _phone(value: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


# Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Country, check digits and as many letters as the country has, a space before any; what follows is no part of it."""
    by_length = "|".join(
        rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length, codes in IBAN_LENGTHS.items()
    )
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{by_length})(?![A-Za-z0-9])"


def _iban(value: Column) -> Column:
    """Country and check digits go last, letters count from 10, and the number is 1 modulo 97."""
    bare = F.replace(value, F.lit(" "))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))

    def step(rest: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    letters = F.filter(F.split(turned, ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0), step) == 1


def _national(value: Column) -> Column:
    """Area, group and serial number are not all zeros, and the area is in use."""
    return ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-") & ~value.rlike("-0000$")


class Kind(NamedTuple):
    pattern: str
    proven: Callable[[Column], Column] | None
    base: bool
    score: float
    context: str
    needs: str  # a text without this pattern has no span of the kind


# The kinds in their order, their patterns, and words that speak for them.
KINDS: dict[str, Kind] = {
    "email": Kind(
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        None, True, 0.75, r"(?i)\b(?:e-?mail|mail|contact|write|address|kontakt|correo|courriel)\b", "@",
    ),
    "ip": Kind(
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        _ip, True, 0.5, r"(?i)\b(?:ip|host|server|address|client|login|adresse|servidor|serveur)\b", ".",
    ),
    "card": Kind(
        r"[0-9](?:[\x20-]?[0-9])++",
        _card, True, 0.75, r"(?i)\b(?:card|credit|visa|mastercard|payment|karte|tarjeta|carte)\b", "",
    ),
    "phone": Kind(
        r"\+[0-9][\x20().0-9-]+[0-9]",
        _phone, True, 0.5, r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b", "+",
    ),
    "iban": Kind(
        _iban_pattern(),
        _iban, False, 0.75, r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b", "",
    ),
    "national": Kind(
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        _national, False, 0.25, r"(?i)\b(?:ssn|social security|national|insurance)\b", "-",
    ),
}
#: Words near a span that speak against personal data, whatever the kind.
AGAINST = r"(?i)\b(?:example|sample|version|test|order no|invoice)\b"

_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"
_START = "struct<at:bigint,spans:" + _SPANS + ">"


def find_all(text: Column, pattern: str) -> Column:
    """All leftmost matches as `start, end, value` in code points; the parts between them give the places."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        steps = F.zip_with(gaps, found, lambda g, v: F.struct(F.length(g).cast("long").alias("gap"), v.alias("value")))
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(found) - 1) / FOLD).cast("int")),
            lambda i: F.slice(steps, i * FOLD + 1, FOLD),
        )
        sums = F.transform(
            parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + F.length(x["value"]))
        )
        starts = F.transform(
            parts,
            lambda p, i: F.aggregate(F.slice(sums, 1, i), F.lit(0).cast("long"), lambda a, x: a + x),
        )

        def add(held: Column, x: Column) -> Column:
            start = held["at"] + x["gap"]
            end = start + F.length(x["value"])
            span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(held["spans"], F.array(span)).alias("spans")).cast(_START)

        return F.flatten(
            F.zip_with(
                parts, starts,
                lambda p, at: F.aggregate(
                    p, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("spans")).cast(_START), add,
                    lambda held: held["spans"],
                ),
            )
        )

    # One element that holds the matches, so that they are looked for once.
    return F.flatten(
        F.transform(F.array(values), lambda v: F.when(F.size(v) > 0, placed(v)).otherwise(F.array().cast(_SPANS)))
    )


def _scored(text: Column, name: str, kind: Kind) -> Column:
    """The confirmed spans of one kind as `kind, start, end, score`."""

    def one(span: Column) -> Column:
        first = F.greatest(span["start"] - BEFORE, F.lit(0))
        around = F.concat(
            text.substr((first + 1).cast("int"), (span["start"] - first).cast("int")), F.lit(" "),
            text.substr((span["end"] + 1).cast("int"), F.lit(AFTER)),
        )
        up = F.when(around.rlike(kind.context), CONTEXT_STEP).otherwise(0.0)
        down = F.when(around.rlike(AGAINST), -CONTEXT_STEP).otherwise(0.0)
        return F.struct(
            F.lit(name).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
            (F.lit(kind.score) + up + down).alias("score"),
        )

    spans = find_all(text, kind.pattern)
    if kind.proven:
        spans = F.filter(spans, lambda s: kind.proven(s["value"]))
    scored = F.transform(spans, one)
    if not kind.base:
        scored = F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return F.when(F.contains(text, F.lit(kind.needs)), scored).otherwise(empty) if kind.needs else scored


def find_pii(docs: DataFrame) -> DataFrame:
    """`docs` with `spans`, an array of `kind, start, end, score` in the order of KINDS, then by place.

    Places are code points, ends exclusive. Spans of the base kinds stay
    whatever their score; those of the added kinds need LEAST_SCORE. A null or
    empty text has no spans. Repeated rows give repeated rows, an empty table
    an empty result; a column `spans` of the input is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("spans", F.concat(*[_scored(text, name, kind) for name, kind in KINDS.items()]))
