"""Operator 5: personal data. Patterns propose spans, checksum validators confirm them, nearby words adjust the score.

All of it is native columns on the row of the document: no shuffle, no Python. The patterns are written so that matching
is linear: a run of characters is tried once, at its start or right after the last match (``\\G``), with possessive
repetition; and no group is repeated without bound, which in Java's engine would recurse once per repetition. Where the
definition repeats a group (``.label`` of a domain, blank or hyphen and digit of a card), those separators are first
replaced by a mark of the same length, which turns the group into a run of one character class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.regex_spans import no_spans, running, spans

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: The score that a kind has by itself, and the words near a span that raise it.
PRIORS = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.85, "ssn": 0.3}
CONTEXT_WORDS = {
    "email": "e-?mail|mail|contact|write to|reach|correo|courriel|adresse",
    "ip": "ip|host|server|address|login|adresse|client|peer",
    "card": "card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|whatsapp|contact|telefon|tél|llam",
    "iban": "iban|account|bank|konto|compte|cuenta|swift|bic",
    "ssn": "ssn|social security|social-security|soc sec",
}
CONTEXT_GAIN = 0.2
_MARK = "\x01"


def _marked(text: Column, pattern: str) -> Column:
    """``text`` with what ``pattern`` matches (one character each) replaced by the mark; lengths stay."""
    return F.regexp_replace(F.translate(text, _MARK, "\x02"), pattern, _MARK)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is divisible by ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN (letters and digits, no blanks) leaves 1 when divided by 97 in its digit form."""
    moved = F.concat(F.substring(account, 5, 1000), F.substring(account, 1, 4))

    def step(s: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (s * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _found(text: Column) -> dict[str, Column]:
    """Confirmed spans by kind; a cheap test of a character or pattern that every match holds goes first."""
    label, local, digit = "[A-Za-z0-9-]", "[A-Za-z0-9._%+" + _MARK + "-]", "[0-9]"
    email = spans(_marked(text, rf"(?<={label})\.(?={label})"), F.lit(rf"(?:\G|(?<!{local})){local}++@{label}++{_MARK}[A-Za-z0-9{_MARK}-]*+"))
    ip = spans(text, F.lit(rf"(?:\G|(?<!{digit})){digit}++\.{digit}++\.{digit}++\.{digit}++"))
    card = spans(_marked(text, rf"(?<={digit})[ -](?={digit})"), F.lit(rf"[0-9{_MARK}]{{13,}}+"))
    phone = spans(text, F.lit(r"\+[0-9][ ().0-9-]+[0-9]"))
    iban = spans(text, F.lit(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"))
    ssn = spans(text, F.lit(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"))
    octets = lambda m: F.forall(F.split(m, r"\."), lambda x: x.cast("double") <= 255)
    length = lambda m, low, high: F.length(_digits(m)).between(low, high)
    return {
        "email": F.when(F.contains(text, F.lit("@")), email).otherwise(no_spans()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(ip, lambda s: octets(s["match"]))).otherwise(no_spans()),
        "card": F.when(text.rlike(r"[0-9][0-9 -]{11,}"), F.filter(card, lambda s: length(s["match"], 13, 19) & luhn(_digits(s["match"])))).otherwise(no_spans()),
        "phone": F.when(text.rlike(r"\+[0-9]"), F.filter(phone, lambda s: length(s["match"], 9, 15))).otherwise(no_spans()),
        "iban": F.when(text.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{8}"), F.filter(iban, lambda s: mod97(F.regexp_replace(s["match"], " ", "")))).otherwise(no_spans()),
        "ssn": F.when(text.rlike(r"[0-9]-[0-9]{2}-[0-9]"), F.filter(ssn, lambda s: _near(s, "ssn"))).otherwise(no_spans()),
    }


def _near(span: Column, kind: str) -> Column:
    return F.concat_ws("\n", span["before"], span["after"]).rlike(rf"(?i)(?<![a-z])(?:{CONTEXT_WORDS[kind]})")


def _scored(found: Column, kind: str) -> Column:
    def one(s: Column) -> Column:
        gain = F.when(_near(s, kind), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(F.lit(PRIORS[kind]) + gain, F.lit(1.0)).alias("score"))

    return F.transform(found, one)


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (kind, start, end, score).

    Places count code points, ends exclusive. A null or empty text has no spans; other columns of ``docs`` are ignored;
    repeated rows and null ``doc_id`` keep their rows. Spans are ordered by kind, as listed in ``KINDS``, then start.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    # The spans of all kinds come first, so that each pattern runs once.
    texts = texts.select("doc_id", "text", *(found.alias(kind) for kind, found in _found(text).items()))

    return texts.select("doc_id", F.concat(*(_scored(F.col(k), k) for k in KINDS)).alias("spans"))


def of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda s: s["kind"] == kind)


def listing(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span of at least that score replaced by its kind in angle brackets; overlapping spans go together, as the kind of the first.

    A null or empty text and rows without such a span stay as they are, as do all other columns, whatever their names;
    an empty table gives none.
    """
    text = F.col("whole")
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("whole"))
    rows = rows.select("row", "whole", *(found.alias(kind) for kind, found in _found(text).items()))
    every = F.concat(*(_scored(F.col(k), k) for k in KINDS))
    placed = F.transform(every, lambda s: F.struct(s["start"], s["end"], s["kind"], s["score"]))
    sorted_ = F.array_sort(F.filter(F.coalesce(placed, F.array()), lambda s: s["score"] >= threshold))
    rows = rows.select("row", "whole", sorted_.alias("found"))
    # A span that starts before the furthest end so far belongs to those before it.
    ends = running(F.col("found"), F.lit(0), "int", lambda s, x: F.greatest(s, x["end"]), lambda s, t: F.greatest(s, t))
    told = F.zip_with("found", ends, lambda s, e: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), e.alias("after")))
    heads = F.filter(told, lambda t: t["start"] >= t["after"])
    out = F.transform(heads, lambda t: F.concat(text.substr(t["after"] + 1, t["start"] - t["after"]), F.lit("<"), t["kind"], F.lit(">")))
    last = F.array_max(F.transform("found", lambda s: s["end"]))
    new = F.when(F.size("found") > 0, F.concat(F.array_join(out, ""), text.substr(last + 1, F.length(text))))
    rows = rows.select("row", new.alias("new"))
    return rows.select(*(F.coalesce("new", F.col("row").getField(c)).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
