"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a column expression.  Spark's regular expressions return matched
strings without places, so the places are summed up from the lengths of the
pieces between matches.  Positions count code points; ends are exclusive.

Null and empty texts have no spans; texts of any length are read whole.  Repeated
rows get the same spans each; an empty table gives an empty one.  Spans that begin
together are listed in the order of their kinds.  A column named spans is
replaced, other extra columns pass.  Matches of one kind never overlap; kinds
may.  Possessive quantifiers and look-behinds keep each pattern linear on very
long runs without white space; they accept exactly what the plain forms accept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """How one kind is found.

    ``needs``: a plain string without which no text has a match, or "".
    ``valid``: matched string -> boolean column.  ``context``: words that, within
    ``PIICONTEXT`` characters before or after the span, raise the score by 0.3.
    ``least``: spans that score less are dropped (0 keeps all that are valid).
    """

    name: str
    pattern: str
    needs: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    least: float = 0.0


PIICONTEXT = 40


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_ok(m: Column) -> Column:
    """The Luhn checksum over the digits of ``m``."""
    d = _digits(m)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(d, -i, F.lit(1)).cast("int"))
        .when(F.substring(d, -i, F.lit(1)).cast("int") > 4, F.substring(d, -i, F.lit(1)).cast("int") * 2 - 9)
        .otherwise(F.substring(d, -i, F.lit(1)).cast("int") * 2),
    )
    return total % 10 == 0


def mod97_ok(m: Column) -> Column:
    """The ISO 7064 mod 97-10 checksum, letters as 10 to 35, the first four characters moved to the end."""
    c = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda x: x != ""),
        F.lit(0),
        lambda acc, x: F.when(x.rlike("[0-9]"), (acc * 10 + F.ascii(x) - 48) % 97).otherwise(
            (acc * 100 + F.ascii(x) - 55) % 97
        ),
    )
    return rest == 1


def _octets_ok(m: Column) -> Column:
    return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$")


def _card_ok(m: Column) -> Column:
    n = F.length(_digits(m))
    return F.when(n.between(14, 19), luhn_ok(m)).otherwise(False)


BASE = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.6, r"(?i)\b(?:e-?mail|mail|contact|write)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _octets_ok, 0.5, r"(?i)\b(?:ip|host|server|address)\b"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "", _card_ok, 0.6, r"(?i)\b(?:card|visa|credit|debit|payment)\b"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", lambda m: F.length(_digits(m)).between(10, 15), 0.5, r"(?i)\b(?:phone|tel|call|mobile|fax)\b"),
)

#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Per country as many characters as it has, in groups of four; of other countries any length."""
    known = []
    for n, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(n - 4, 4)
        known.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    names = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    other = rf"(?!{names})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}+(?: ?[A-Z0-9]{{1,3}})?+"
    return rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(known)}|{other})\b"


MORE = (
    Kind("iban", _iban(), "", mod97_ok, 0.7, r"(?i)\b(?:iban|account|bank)\b"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", lambda m: ~m.rlike("^(?:000|666|9)"), 0.3, r"(?i)\b(?:ssn|social security)\b", 0.6),
)

SPAN = "struct<start:int, rank:int, kind:string, end:int, score:double>"


#: Matches that one running sum goes over; characters that any match has.
PART, LEAST_MATCH = 200, 2


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _located(text: Column, kind: Kind, rank: int) -> Column:
    """All valid spans of one kind.

    Places are running sums over gaps and matches, which an ``aggregate`` would copy for every
    match; so matches are summed by parts of ``PART``, and the parts' sums tell where each part begins.
    """
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    each = lambda gaps: _let(found, lambda m: F.arrays_zip(F.slice(gaps, F.lit(1), F.size(m)).alias("gap"), m.alias("m")))
    item = "struct<start:int, end:int, gap:string, m:string>"
    length = lambda x: F.length(x["gap"]) + F.length(x["m"])

    def within(part: Column, begin: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            span = F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + length(x)).alias("end"), x["gap"].alias("gap"), x["m"].alias("m"))
            return F.struct(span["end"].alias("at"), F.array_append(acc["out"], span).alias("out"))

        return F.aggregate(part, F.struct(begin.alias("at"), F.array().cast(f"array<{item}>").alias("out")), step, lambda acc: acc["out"])

    def placed_of(pairs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(pairs) - 1, F.lit(0)), F.lit(PART))
        return _let(F.transform(starts, lambda i: F.slice(pairs, i + 1, F.lit(PART))), joined)

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + length(x)))
        begins = F.aggregate(sums, F.array(F.lit(0)), lambda out, n: F.array_append(out, F.element_at(out, -1) + n))
        return F.flatten(F.zip_with(parts, F.slice(begins, F.lit(1), F.size(parts)), within))

    around = -(-PIICONTEXT // LEAST_MATCH)

    def score(gaps: Column, spans: Column, s: Column, i: Column) -> Column:
        # what stands around a match is put together from the pieces next to it; a match has LEAST_MATCH characters at least
        lead = F.transform(F.slice(spans, F.greatest(i + 1 - around, F.lit(1)), F.least(i, F.lit(around))), lambda p: F.concat(p["gap"], p["m"]))
        before = F.right(F.concat(F.array_join(lead, ""), s["gap"]), F.lit(PIICONTEXT))
        tail = F.transform(F.slice(spans, i + 2, F.lit(around)), lambda p: F.concat(p["gap"], p["m"]))
        rest = F.when(i + 1 + around >= F.size(spans), F.substring(F.element_at(gaps, -1), 1, PIICONTEXT)).otherwise("")
        after = F.substring(F.concat(F.array_join(tail, ""), rest), 1, PIICONTEXT)
        return F.lit(kind.score) + F.when(before.rlike(kind.context) | after.rlike(kind.context), 0.3).otherwise(0.0)

    def scored(gaps: Column, all_spans: Column) -> Column:
        told = F.transform(all_spans, lambda s, i: F.when(kind.valid(s["m"]), F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), s["end"].alias("end"), score(gaps, all_spans, s, i).alias("score"))))
        return F.filter(told, lambda s: s.isNotNull())

    spans = _let(F.split(text, kind.pattern, -1), lambda gaps: _let(_let(each(gaps), placed_of), lambda found_spans: scored(gaps, found_spans)))
    if kind.least:
        spans = F.filter(spans, lambda s: s["score"] >= kind.least)
    # cheap test first: most texts have no match of most kinds
    there = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    return F.when(there & text.rlike(kind.pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "spans", kinds: tuple[Kind, ...] = BASE + MORE) -> DataFrame:
    """Every row with ``out``: its spans as array<struct<start, rank, kind, end, score>> by start, then kind as listed.

    A projection of the scan: no shuffle, no Python.  A column named ``out`` is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(out, F.array_sort(F.concat(*(_located(text, k, i) for i, k in enumerate(kinds)))))


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """The text with each span replaced by its kind in brackets; of overlapping spans the one that starts first counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    done = F.aggregate(
        F.col(spans_col),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out")),
        ).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return found.withColumn(text_col, done)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
