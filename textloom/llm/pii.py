"""Personal data: patterns propose, checksums confirm, words nearby weigh in.

Spans are counted in code points.  A text is split by a pattern and the matches
are extracted; the lengths of the pieces in between give the places.  Patterns
are written so that a run of characters is tried once, however long it is:
possessive repeats, and no attempt inside a run unless the last match ended there.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Characters of an account number by country, without blanks.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """As long as the country says, so that a word behind a blank is not taken in.

    Other countries: any size, up to a blank before a known country.
    """
    known = "(?:" + "|".join("|".join(names.split()) for names in IBAN_SIZES.values()) + ")[0-9]{2}"
    sized = [rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_SIZES.items()]
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{known}))?[A-Z0-9]){{11,30}}"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*sized, other])})(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    """What to look for; ``hint`` is a plain character or pattern without which no match can occur."""

    name: str
    pattern: str
    hint: str
    score: float  # after the checksum, before the words nearby
    context: str = ""


#: In the order in which equal starts are listed.  Scores of the first four are
#: such that they are kept without any word nearby.
KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        0.9,
        r"mail|contact|write",
    ),
    Kind(
        "ip",
        r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]",
        0.7,
        r"\bip\b|address|host|server",
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.8, r"card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, r"phone|call|tel|mobile|fax"),
    Kind(
        "iban",
        _iban(),
        r"[A-Z]{2}[0-9]{2}",
        0.9,
        r"iban|bank|account",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        0.4,
        r"\bssn\b|social|security|tax",
    ),
)
BASE_KINDS = ("email", "ip", "card", "phone")
#: Code points looked at on either side, what a word there adds, and the least score.
NEARBY, BONUS, LEAST_SCORE = 40, 0.2, 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most a few dozen digits passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda total, i: total
        + F.when(
            (n - i) % 2 == 1,
            F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int")),
        ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number of letters and digits leaves 1 by 97, its first four characters moved to the end."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)),
        F.lit(0),
        lambda rest, i: F.when(
            F.substring(turned, i, F.lit(1)).between("0", "9"),
            rest * 10 + F.ascii(F.substring(turned, i, F.lit(1))) - 48,
        ).otherwise(rest * 100 + F.ascii(F.substring(turned, i, F.lit(1))) - 55)
        % 97,
    )
    return rest == 1


def confirmed(kind: str, match: Column) -> Column:
    """The checksum or range check of a kind."""
    if kind == "ip":
        return match.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z")
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(14, 19), luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        n = F.length(F.replace(match, F.lit(" "), F.lit("")))
        return F.when(n.between(15, 34), mod97(match)).otherwise(F.lit(False))
    if kind == "ssn":
        return ~match.rlike(r"\A(?:000|666|9)|-00-|-0000\z")
    return F.lit(True)


def _found(kind: Kind) -> Column:
    """All matches of a kind: distance to the match before, size, value, text around, whether the check holds."""
    pieces, matches = F.col(f"__pieces_{kind.name}"), F.col(f"__matches_{kind.name}")
    return F.transform(
        matches,
        lambda match, i: F.struct(
            F.length(F.get(pieces, i)).alias("gap"),
            F.length(match).alias("size"),
            match.alias("value"),
            F.right(F.get(pieces, i), F.lit(NEARBY)).alias("before"),
            F.left(F.get(pieces, i + 1), F.lit(NEARBY)).alias("after"),
            confirmed(kind.name, match).alias("ok"),
        ),
    )


def with_matches(docs: DataFrame, text: Column) -> DataFrame:
    """Add per kind the pieces between matches and the matches themselves (null where a hint is missing)."""
    columns = {}
    for kind in KINDS:
        there = F.contains(text, F.lit(kind.hint)) if kind.hint == "@" else text.rlike(kind.hint)
        columns[f"__pieces_{kind.name}"] = F.when(there, F.split(text, kind.pattern, -1))
        columns[f"__matches_{kind.name}"] = F.when(there, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)))
    return docs.withColumns(columns)


_SPAN = "array<struct<start:int,order:int,end:int,kind:string,value:string,score:double>>"


def _placed(kind: Kind, order: int) -> Column:
    """Spans of a kind, confirmed and scored; places from running lengths."""
    score = F.lit(kind.score)

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        near = F.lower(F.concat_ws(" ", m["before"], m["after"]))
        weight = score + F.when(near.rlike(kind.context), F.lit(BONUS)).otherwise(0.0)
        span = F.struct(
            start.alias("start"),
            F.lit(order).alias("order"),
            (start + m["size"]).alias("end"),
            F.lit(kind.name).alias("kind"),
            m["value"].alias("value"),
            weight.alias("score"),
        )
        good = m["ok"] & (weight >= LEAST_SCORE)
        return F.struct(
            (start + m["size"]).alias("at"),
            F.when(good, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).cast(_SPAN).alias("spans"),
        )

    first = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))
    return F.coalesce(
        F.aggregate(_found(kind), first, step, lambda state: state["spans"]), F.array().cast(_SPAN)
    )


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and __spans, an array of (start, order, end, kind, value, score).

    Matches of a kind are leftmost and do not overlap; one that fails its check
    is dropped and not tried again.  Spans are sorted by start, then kind as
    listed in KINDS; kinds may overlap each other.  The score is that of the
    kind plus a bonus if a context word is within ``NEARBY`` code points (up to
    the next match of the kind); spans below ``LEAST_SCORE`` are dropped, which
    concerns only kinds beside the base ones.  A null or empty text has no
    spans.  Rows are neither merged nor lost; no shuffle.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = with_matches(docs, body)
    spans = F.array_sort(F.concat(*[_placed(kind, i) for i, kind in enumerate(KINDS)]))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], spans.alias("__spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, text: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets.

    Of overlapping spans the first stands and covers the rest.  Null texts stay null.
    """
    marked = find_personal_data(docs, text)
    body = F.col(f"`{text}`")

    def step(state: Column, s: Column) -> Column:
        fresh = (s["start"] >= state["at"]) & (s["score"] >= least_score)
        part = F.concat(F.substring(body, state["at"] + 1, s["start"] - state["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(
            F.when(fresh, s["end"]).otherwise(state["at"]).alias("at"),
            F.when(fresh, F.concat(state["parts"], F.array(part))).otherwise(state["parts"]).alias("parts"),
        )

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate(
        F.col("__spans"), first, step,
        lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(body, state["at"] + 1, F.lit(2**31 - 1))),
    )
    return marked.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
