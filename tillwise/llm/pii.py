"""Personal data, with DataFrame functions only: patterns propose, checksums confirm, words nearby weigh.

Every kind is a regular expression.  Its spans are laid out from the pieces of text between the
matches, so positions count code points.  Proposed spans must pass a validator (Luhn, mod-97, ranges,
number of digits).  Base kinds are then taken as they are; further kinds start from a prior and are
taken when words nearby lift their score to the threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import text_or_empty

NEAR = 48  # characters before and after a span that are searched for context words
THRESHOLD = 0.6


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = d * 2
        other = (n - i) % 2 == 1
        return total + F.when(other, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97, letters counted from 10."""
    moved = F.concat(F.substring(iban, 5, 34), F.substring(iban, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), add) == 1


def _count(match: Column, least: int, most: int) -> Column:
    return F.length(_digits(match)).between(least, most)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """``hint``: a pattern that each match holds; texts without it are not searched."""

    name: str
    pattern: str
    hint: str
    valid: Callable[[Column], Column]
    prior: float
    words: str = ""
    base: bool = False


# The base patterns.  Where one is written with possessive repeats and with a look
# back, it finds the same spans, but in linear time and without recursion on very long runs.
KINDS = [
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        lambda m: F.lit(True),
        0.9,
        "mail|contact|kontakt|courriel|correo",
        True,
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]",
        lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        0.7,
        "host|server|address|adresse|login",
        True,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9](?:[\x20-]?[0-9]){11}",
        lambda m: F.when(_count(m, 12, 19), luhn(_digits(m))).otherwise(False),
        0.8,
        "card|visa|master|karte|carte|tarjeta|pay",
        True,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        lambda m: _count(m, 9, 15),
        0.7,
        "phone|call|tel|mobile|fax|anruf|appel|llama",
        True,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2}",
        lambda m: F.when(
            F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34),
            mod97(F.replace(m, F.lit(" "), F.lit(""))),
        ).otherwise(False),
        0.8,
        "iban|account|konto|compte|cuenta|bank",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        "[0-9]-[0-9]",
        lambda m: F.lit(True),
        0.4,
        "ssn|social|security|taxpayer",
    ),
    Kind(
        "phone_local",
        r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
        "[0-9]{3}",
        lambda m: F.lit(True),
        0.4,
        "phone|call|tel|mobile|fax",
    ),
]
BASE = [k.name for k in KINDS if k.base]


_SPAN = "array<struct<start:int,kind:int,end:int,match:string,score:double>>"
_PIECE = 256  # numbers summed at a time
_RUN = NEAR // 3  # matches whose text is kept together; so many are NEAR characters long at least


def _grow(steps: Column, first: Column) -> Column:
    """Running totals of a short array, from ``first`` on."""
    none = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        total = acc["at"] + x
        return F.struct(total.alias("at"), F.concat(acc["out"], F.array(total)).alias("out"))

    return F.aggregate(steps, none, add, lambda acc: acc["out"])


def running(steps: Column) -> Column:
    """Running totals of an array of any length: of pieces, and within each from where it begins.

    An array that grows is copied with each step, so it is never longer than a piece or the number of
    pieces.
    """
    places = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _PIECE).cast("int"))
    pieces = F.transform(places, lambda c: F.slice(steps, c * _PIECE + 1, _PIECE))
    sums = F.transform(pieces, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
    begins = F.transform(
        F.arrays_zip(_grow(sums, F.lit(0)).alias("e"), sums.alias("n"), pieces.alias("p")),
        lambda x: _grow(x["p"], x["e"] - x["n"]),
    )
    return F.flatten(begins)


def _raw(kind: Kind) -> Column:
    """Matches of the pattern and the text between them; null where the hint is not found."""
    text = F.col("text")
    return F.when(
        text.rlike(kind.hint),
        F.struct(
            F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"),
            F.split(text, kind.pattern, -1).alias("b"),
        ),
    )


def _ends(raw: Column) -> Column:
    """Where each match ends: the lengths of all matches and of the text between them, added up."""
    steps = F.transform(raw["m"], lambda m, i: F.length(F.get(raw["b"], i)) + F.length(m))
    return F.when(raw.isNotNull() & (F.size(raw["m"]) > 0), running(steps))


def _runs(raw: Column) -> Column:
    """The text cut after every ``_RUN`` matches; the last piece goes to its end."""
    matches, between = raw["m"], raw["b"]
    last = F.size(matches) - 1

    def text_of(c: Column) -> Column:
        places = F.sequence(c * _RUN, F.least(c * _RUN + _RUN - 1, last))
        both = F.transform(places, lambda i: F.concat(F.get(between, i), F.get(matches, i)))
        rest = F.when(c * _RUN + _RUN > last, F.get(between, last + 1)).otherwise("")
        return F.concat(F.array_join(both, ""), rest)

    pieces = F.transform(F.sequence(F.lit(0), F.floor(last / _RUN).cast("int")), text_of)
    return F.when(raw.isNotNull() & (F.size(matches) > 0), pieces)


def _spans(kind: Kind, number: int, raw: Column, ends: Column, runs: Column) -> Column:
    """The valid matches with a score: the prior, raised where a context word stands nearby.

    What stands nearby is looked up in the text around the neighbouring matches, so the whole text is
    never walked for a match.
    """
    matches = raw["m"]

    def lay(i: Column) -> Column:
        match, end = F.get(matches, i), F.get(ends, i)
        start = end - F.length(match)
        c = F.floor(i / _RUN).cast("int")
        local = F.concat(*[F.coalesce(F.get(runs, c + k), F.lit("")) for k in (-1, 0, 1)])
        shift = F.when(c > 1, F.get(ends, (c - 1) * _RUN - 1)).otherwise(0)
        begin = F.greatest(start - NEAR, F.lit(0))
        near = F.substring(local, begin - shift + 1, end - begin + NEAR)
        lift = F.when(F.lower(near).rlike(kind.words), 0.3).otherwise(0.0)
        return F.struct(
            start.alias("start"),
            F.lit(number).alias("kind"),
            end.alias("end"),
            match.alias("match"),
            F.least(F.lit(kind.prior) + lift, F.lit(1.0)).alias("score"),
        )

    places = F.sequence(F.lit(0), F.size(matches) - 1)
    valid = F.filter(places, lambda i: kind.valid(F.get(matches, i)))
    laid = F.transform(valid, lay)
    return F.when(ends.isNotNull(), laid).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, found): found holds start, kind, end, match and score of every span, in order.

    A null text is empty and has no spans.  Base kinds are always kept; a further kind is kept when
    its score reaches ``threshold`` and it overlaps no base span.  Spans of one kind never overlap,
    spans of two kinds may.  Every row is treated on its own, so repeated rows repeat and the size of
    a source or a group of copies does not matter; nothing is shuffled.
    """
    df = docs.select("doc_id", text_or_empty(docs).alias("text"))
    df = df.select("*", *[_raw(k).alias(f"_r{i}") for i, k in enumerate(KINDS)])
    parts = [(f"_r{i}", f"_e{i}", f"_t{i}") for i in range(len(KINDS))]
    df = df.select("*", *[c for r, e, t in parts for c in (_ends(F.col(r)).alias(e), _runs(F.col(r)).alias(t))])
    spans = [_spans(k, i, *map(F.col, parts[i])) for i, k in enumerate(KINDS)]
    df = df.select("doc_id", "text", *[s.alias(f"_s{i}") for i, s in enumerate(spans)])
    base = F.concat(*[F.col(f"_s{i}") for i, k in enumerate(KINDS) if k.base])
    more = F.concat(*[F.col(f"_s{i}") for i, k in enumerate(KINDS) if not k.base])
    df = df.select("doc_id", "text", base.alias("_base"), more.alias("_more"))

    def clear(s: Column) -> Column:
        over = F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return (s["score"] >= threshold) & ~over

    return df.select(
        "doc_id", "text", F.array_sort(F.concat("_base", F.filter("_more", clear))).alias("found")
    )


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets.

    Of overlapping spans the first, and of those the longest, is replaced.
    """
    names = F.array(*[F.lit(f"[{k.name}]") for k in KINDS])

    def put(acc: Column, s: Column) -> Column:
        piece = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        done = F.struct(
            F.concat(acc["out"], piece, F.get(names, s["kind"])).alias("out"), s["end"].alias("at")
        )
        return F.when(s["start"] >= acc["at"], done).otherwise(acc)

    rest = F.substring
    text = F.aggregate(
        "found",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        put,
        lambda acc: F.concat(acc["out"], rest(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return find_pii(docs, threshold).select("doc_id", text.alias("text"))


def pii_report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans as text."""
    names = F.array(*[F.lit(k.name) for k in KINDS])

    def shown(s: Column) -> Column:
        return F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
        )

    def of_kind(n: int) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == n

    found = find_pii(docs, threshold)
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id",
        *[
            F.size(F.filter("found", of_kind(n))).cast("bigint").alias(f"n_{name}")
            for n, name in enumerate(BASE)
        ],
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", shown), ",").alias("spans"),
    )
