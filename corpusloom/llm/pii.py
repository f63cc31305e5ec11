"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Emails, IP addresses, payment cards (Luhn) and international phone numbers follow fixed
rules and are always reported. Bank account numbers (mod-97), shorter card numbers and
local phone numbers are reported where their score, raised by a passed checksum and by
context words shortly before the match, reaches the threshold. All of it is column
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names
from .spans import characters, clear_of, masked, matches, no_spans, ordered

#: The patterns of the scan, possessive and anchored where that changes no match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+\b"
LOCAL_PHONE = r"(?:\([0-9]{3}\)\x20?|\b[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}\b"
CONTEXT = {
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|telefon|téléphone|teléfono)\b",
}
MASKS = {k: f"[{k.upper()}]" for k in (*KINDS, "iban")}


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = F.transform(characters(F.reverse(number)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
    ))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(number: Column) -> Column:
    """Whether an account number, spaces dropped, has the remainder 1 (ISO 7064)."""
    plain = F.regexp_replace(number, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(
        characters(turned),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _small_part(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(F.when(F.length(short) <= 3, short).try_cast("int"), F.lit(0)) <= 255)


def base_spans(text: Column) -> Column:
    """Matches of the four fixed kinds that pass their rules."""

    def digits_between(s: Column, least: int, most: int) -> Column:
        return F.length(digits(s["text"])).between(least, most)

    email = F.when(text.contains("@"), matches(text, EMAIL, 0, KINDS[0])).otherwise(no_spans())
    ip = F.filter(matches(text, IP, 1, KINDS[1]), lambda s: F.forall(F.split(s["text"], r"\."), _small_part))
    card = F.filter(matches(text, CARD, 2, KINDS[2]), lambda s: F.when(digits_between(s, 14, 19), luhn(digits(s["text"]))).otherwise(False))
    phone = F.when(text.contains("+"), matches(text, PHONE, 3, KINDS[3])).otherwise(no_spans())
    return ordered(email, ip, card, F.filter(phone, lambda s: digits_between(s, 10, 15)))


def _near(text: Column, span: Column, kind: str, reach: int) -> Column:
    before = F.substring(text, F.greatest(span["start"] - reach, F.lit(0)) + 1, F.least(span["start"], F.lit(reach)))
    return before.rlike(CONTEXT[kind])


def added_spans(text: Column, base: Column, threshold: float, reach: int) -> Column:
    """Further spans, clear of the base ones: checksum 0.6, bare form 0.3, context words 0.3."""

    def scored(spans: Column, kind: str, worth: Column | None, valid) -> Column:
        form = clear_of(spans, base)
        checked = F.filter(form, valid) if valid is not None else form
        given = F.transform(checked, lambda s: s.withField("score", F.lit(0.6 if valid is not None else 0.3) + F.when(_near(text, s, kind, reach), 0.3).otherwise(0.0)))
        return F.filter(given, lambda s: s["score"] >= threshold)

    iban = scored(matches(text, IBAN, 4, "iban"), "iban", None, lambda s: mod97(s["text"]))
    short = F.filter(matches(text, CARD, 2, "card"), lambda s: F.length(digits(s["text"])).between(12, 13) & _near(text, s, "card", reach))
    card = scored(short, "card", None, lambda s: luhn(digits(s["text"])))
    phone = scored(matches(text, LOCAL_PHONE, 3, "phone"), "phone", None, None)
    return F.concat(iban, card, clear_of(phone, F.concat(iban, card)))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, reach: int = 40) -> DataFrame:
    """One row a document: doc_id, base and spans (arrays of start, rank, kind, end, text, score).

    base holds the fixed kinds, spans also those added at a score of ``threshold`` or more,
    with context words looked for in the ``reach`` characters before a match. Null texts
    count as empty. Repeated rows are returned each; other columns are not read; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.select("doc_id", "base", added_spans(F.col("text"), F.col("base"), threshold, reach).alias("more"))
    return rows.select("doc_id", "base", ordered(F.col("base"), F.col("more")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", threshold: float = 0.6, reach: int = 40) -> DataFrame:
    """The documents with every span of personal data replaced by the name of its kind.

    All columns stay; ``size_col``, if there, is the new length of changed texts. Null texts
    stay null, empty ones empty; repeated rows are changed alike; an empty table stays empty.
    A very long text is masked as one row; other columns may have any name.
    """
    text, (base, spans) = F.col(text_col), fresh_names(docs, "base_spans", "all_spans")
    marked = docs.withColumn(base, F.when(text.isNotNull(), base_spans(text)))
    marked = marked.withColumn(spans, F.when(text.isNotNull(), ordered(F.col(base), added_spans(text, F.col(base), threshold, reach))))
    marked = marked.withColumn(text_col, F.when(text.isNotNull(), masked(text, F.col(spans), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))))
    if size_col in docs.columns:
        changed = F.col(spans).isNotNull() & (F.size(spans) > 0)
        marked = marked.withColumn(size_col, F.when(changed, F.length(text_col).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col)))
    return marked.select(docs.columns)
