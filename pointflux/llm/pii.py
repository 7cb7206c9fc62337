"""Personal data in texts: patterns propose, checksums confirm, context weighs.

Everything is a Spark expression. A kind's matches are wrapped in two control
characters by one ``regexp_replace`` and the text is split at them, so the odd
parts are the matches and the lengths before them the positions, in code points.
Quantifiers are possessive and matches start at the start of a run of their
first characters, so the time stays linear in texts of any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, cut, pieces, running

MARK, STOP = "\x01", "\x02"
BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban",)
KINDS = BASE + EXTRA
#: The registered lengths of IBANs by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
    "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)


def _iban_pattern() -> str:
    """Groups of four with or without blanks, as many as the country's length asks for, so that no word after them is taken in."""
    countries: dict[int, list[str]] = {}
    for entry in IBAN_LENGTHS.split():
        countries.setdefault(int(entry[2:]) - 4, []).append(entry[:2])
    one = lambda n: rf"(?:\x20?[A-Z0-9]{{4}}){{{n // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    ways = "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}{one(n)}" for n, c in sorted(countries.items()))
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{ways})(?![A-Za-z0-9])"


#: The patterns of the kinds, as linear-time equivalents. A match may start where the
#: one before ended (\G); runs of under 12 digits, which can't be cards, are passed over at once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9](?:[\x20-]?[0-9]){11})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "phone": "+"}
#: Words that, within NEAR code points of a match, raise or lower its score.
NEAR = 48
RAISE = {
    "email": "mail|contact|write|reach|correo|courriel",
    "ip": r"\bip\b|address|host|server|login|adresse",
    "card": "card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|appel",
    "iban": "iban|bank|account|konto|compte|cuenta|transfer",
}
LOWER = {
    "email": "example|noreply|no-reply",
    "ip": "version|release|chapter|section",
    "card": "order|invoice|tracking|isbn|serial",
    "phone": "order|invoice|isbn|part no",
    "iban": "serial|licen[sc]e key|part no",
}
#: Scores: what the pattern and its checks give, and what context adds or takes.
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
STEP = 0.2
#: Added spans are reported from this score on; base spans always.
REPORT = 0.75

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0).otherwise(False)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks passes the mod-97 check (letters count 10 to 35)."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substr(turned, i, F.lit(1))) - 1
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def _proposed(kind: str, text: Column) -> Column:
    """The spans of one kind in ``text``, validated and scored."""
    rank = KINDS.index(kind) + 1
    parts = F.split(F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{STOP}"), f"[{MARK}{STOP}]")

    def odd(p: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: i % 2 == 1)
        return F.when(F.size(p) > 1, at).otherwise(F.array().cast("array<int>"))

    def starts(s: Column) -> Column:
        ends = running(s["lens"])
        return bound(ends, lambda e: F.transform(s["odd"], lambda i: F.get(e, i - 1)))

    def spans(s: Column) -> Column:
        def span(i: Column, k: Column) -> Column:
            start, match = F.get(s["starts"], k), F.get(s["parts"], i)
            around = F.lower(F.concat(F.right(F.get(s["parts"], i - 1), F.lit(NEAR)), F.lit(" "), F.left(F.coalesce(F.get(s["parts"], i + 1), F.lit("")), F.lit(NEAR))))
            score = F.lit(START[kind]) + F.when(around.rlike(RAISE[kind]), STEP).otherwise(0.0) - F.when(around.rlike(LOWER[kind]), STEP).otherwise(0.0)
            return F.struct(
                start.alias("start"), F.lit(rank).alias("rank"), (start + F.get(s["lens"], i)).alias("end"), F.lit(kind).alias("kind"),
                F.when(_valid(kind, match), F.least(score, F.lit(1.0))).alias("score"),
            )

        found = F.filter(F.transform(s["odd"], span), lambda x: x["score"].isNotNull())
        return F.filter(found, lambda x: x["score"] >= REPORT) if kind in EXTRA else found

    # Each step is bound, so that nothing is computed once per match.
    steps = bound(parts, lambda p: F.struct(p.alias("parts"), F.transform(p, F.length).alias("lens"), odd(p).alias("odd")))
    steps = bound(steps, lambda s: F.struct(s["parts"].alias("parts"), s["lens"].alias("lens"), s["odd"].alias("odd"), starts(s).alias("starts")))
    found = bound(steps, spans)
    may = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
    return F.when(may, found).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, spans)`` for each row of ``docs``.

    ``spans`` is an array of (start, rank, end, kind, score), sorted by start and
    then by kind in the order of ``KINDS``; positions are code points, ``end`` is
    exclusive. Spans of different kinds may overlap. A null text counts as empty;
    repeated rows stay, each with its spans; other columns are ignored; an empty
    table gives no rows. A text's own \\x01 and \\x02 end a match like any
    character that no pattern takes.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.translate(body, MARK + STOP, "\x03\x03").alias("clean"))
    found = rows.select("doc_id", "text", *[_proposed(k, F.col("clean")).alias(f"s_{k}") for k in KINDS])
    return found.select("doc_id", "text", F.sort_array(F.concat(*[F.col(f"s_{k}") for k in KINDS])).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(spans: Column) -> Column:
    """The scores of spans with two digits, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans replaced by its first kind in brackets."""

    def put_together(x: Column) -> Column:
        upto = lambda i: F.when(i > 0, F.get(x["upto"], i - 1)).otherwise(0)

        def piece(s: Column, i: Column) -> Column:
            gap = cut(x["parts"], upto(i), s["start"] - upto(i))
            return F.when(s["start"] >= upto(i), F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        last = F.element_at(x["upto"], -1)
        return F.concat(F.array_join(F.transform(x["spans"], piece), ""), cut(x["parts"], last, x["size"] - last))

    facts = F.struct(pieces(text).alias("parts"), F.length(text).alias("size"), spans.alias("spans"), running(F.transform(spans, lambda s: s["end"]), larger=True).alias("upto"))
    return F.when(F.size(spans) == 0, text).otherwise(bound(facts, put_together))


def redact_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; rows and all other columns stay.

    A null text stays null. Texts without findings come back unchanged.
    """
    keep = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    found = find_pii(keep.select("row", F.col(f"row.{text}").alias("text")), "row", "text")
    new = F.when(F.col(f"doc_id.{text}").isNull(), F.lit(None).cast("string")).otherwise(redact(F.col("text"), F.col("spans")))
    return found.select(*[new.alias(c) if c == text else F.col("doc_id")[c].alias(c) for c in docs.columns])


def counts(spans: Column) -> list[Column]:
    of = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return [of(k) for k in BASE]


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: reduce(lambda a, b: a | b, [s["kind"] == k for k in BASE]))
