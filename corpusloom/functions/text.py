"""Text as column expressions: folding, normalising, cleaning, labels, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plain letters with the marked letters that fold to them, and letters that become two.
FOLDED = {
    "a": "àáâãäåāăą", "c": "çćčċĉ", "d": "ðďđ", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïīĭįı", "j": "ĵ", "k": "ķ", "l": "łľĺļŀ",
    "n": "ñńňņŋ", "o": "òóôõöøōŏő", "r": "ŕřŗ", "s": "śšşșŝ", "t": "ťţțŧ", "u": "ùúûüūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źžż",
}
DOUBLED = {"ß": "ss", "æ": "ae", "œ": "oe"}
MARKED, PLAIN = "".join(FOLDED.values()), "".join(p * len(m) for p, m in FOLDED.items())


def fold(text: Column) -> Column:
    """Lower case without accents; combining marks go."""
    out = F.translate(F.lower(text), MARKED, PLAIN)
    for one, two in DOUBLED.items():
        out = F.replace(out, F.lit(one), F.lit(two))
    return F.regexp_replace(out, "[\\u0300-\\u036f]", "")


def tokens(query: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.filter(F.split(fold(query), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def strip_nested(text: Column, opening: str, closing: str) -> Column:
    """Drop what stands in brackets, however deep; unclosed brackets drop the rest.

    Texts are cut at brackets first, so the fold takes a step a bracket, not a character.
    """
    parts = F.filter(F.regexp_extract_all(text, F.lit(f"[\\{opening}\\{closing}]|[^\\{opening}\\{closing}]+"), F.lit(0)), lambda p: p != "")

    def step(a: Column, p: Column) -> Column:
        depth = F.when(p == opening, a["depth"] + 1).when(p == closing, F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        kept = (a["depth"] == 0) & ~p.isin(opening, closing)
        return F.struct(depth.alias("depth"), F.when(kept, F.concat(a["out"], p)).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    return F.aggregate(parts, start, step, lambda a: a["out"])


#: Fixed values of movetext: numeric glyphs, move numbers, results.
GLYPH, NUMBER, RESULTS = r"^\$", r"^[0-9.]+$", ("1-0", "0-1", "1/2-1/2", "*")


def markup(text: Column, gap: str = " ") -> Column:
    """A struct of a movetext without markup (out) and how many comments, variations and line comments went.

    One fold over the pieces between markup characters, with the state that decides what a
    character means: in a line comment only the line's end counts, in braces only the
    closing one, in a variation parentheses and braces. What is not closed goes to the end.
    A percent sign starts a line comment at a line's start. ``gap`` takes the place of what
    goes. Texts without markup cost one search.
    """
    lines = F.concat(F.lit("\n"), text)  # so that a percent sign at the start stands behind a line's end, too
    pieces = F.filter(F.regexp_extract_all(lines, F.lit(r"\n%?|[{}();]|[^{}();\n]+"), F.lit(0)), lambda p: p != "")

    def step(a: Column, p: Column) -> Column:
        line, brace, inside = a["line"], a["brace"], a["depth"] > 0
        plain = ~line & ~brace & ~inside
        percent = p == "\n%"
        opens_line = plain & ((p == ";") | percent) | line & (p == "\n%")
        opens_brace = ~line & ~brace & (p == "{")
        goes = (p == "{") | (p == "(") | (p == ";") | percent
        return F.struct(
            F.when(line, (p == "\n%") | ~F.startswith(p, F.lit("\n"))).otherwise(opens_line).alias("line"),
            F.when(brace, p != "}").otherwise(opens_brace).alias("brace"),
            F.when(line | brace, a["depth"]).when(p == "(", a["depth"] + 1).when(inside & (p == ")"), a["depth"] - 1).otherwise(a["depth"]).alias("depth"),
            F.when(plain, F.concat(a["out"], F.when(p == "\n%", F.lit("\n" + gap)).when(goes, F.lit(gap)).otherwise(p))).otherwise(a["out"]).alias("out"),
            (a["comments"] + (opens_brace & plain).cast("int")).alias("comments"),
            (a["variations"] + (plain & (p == "(")).cast("int")).alias("variations"),
            (a["lines"] + opens_line.cast("int")).alias("lines"),
        )

    def state(out: Column) -> Column:
        return F.struct(F.lit(False).alias("line"), F.lit(False).alias("brace"), F.lit(0).alias("depth"), out.alias("out"), F.lit(0).alias("comments"), F.lit(0).alias("variations"), F.lit(0).alias("lines"))

    return F.when(text.rlike(r"[{(;%]"), F.aggregate(pieces, state(F.lit("")), step, lambda a: a.withField("out", F.substring(a["out"], F.lit(2), F.length(a["out"]))))).otherwise(state(text))


#: Markup that a search from the left takes away whole: comments, line comments, variations with no markup inside.
FLAT = r"\{[^}]*\}|;[^\n]*\n?|\([^(){};]*\)"


def strip_markup(text: Column, gap: str = " ") -> Column:
    """A movetext without markup. One replacement does it unless a bracket is left or a line begins with a percent sign; then ``markup`` folds."""
    flat = F.regexp_replace(text, FLAT, gap)
    return F.when(~text.rlike(r"[{(;%]"), text).when(~text.rlike(r"(\A|\n)%") & ~flat.rlike("[{(]"), flat).otherwise(markup(text, gap)["out"])


def move_tokens(text: Column) -> Column:
    """Tokens that are moves: no glyphs, move numbers or results."""
    return F.filter(F.split(strip_markup(text), r"[ \t\r\n]+"), lambda t: (t != "") & ~t.rlike(GLYPH) & ~t.rlike(NUMBER) & ~t.isin(*RESULTS))


def normalize_moves(text: Column) -> Column:
    return F.array_join(move_tokens(text), " ")


def strip_glued_number(token: Column) -> Column:
    return F.regexp_replace(token, r"^[0-9]+\.+", "")


def clean(text: Column) -> Column:
    """No byte-order mark, replacement characters as question marks, LF line ends, no control characters."""
    out = F.regexp_replace(text, "^\\uFEFF", "")
    out = F.replace(out, F.lit("�"), F.lit("?"))
    out = F.regexp_replace(out, "\\r\\n?", "\n")
    return F.regexp_replace(out, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")


def with_result(text: Column) -> Column:
    """Movetext that ends without a result gets the open one."""
    trimmed = F.rtrim(text)
    return F.when(trimmed.rlike(r"(^|\s)(1-0|0-1|1/2-1/2|\*)$"), trimmed).otherwise(F.ltrim(F.concat(trimmed, F.lit(" *"))))


def rewritten(text: Column) -> Column:
    """A cleaned movetext (out) without markup, its white space single, its result there, and what was done to it."""
    marked = markup(clean(text))
    bare = F.trim(F.regexp_replace(marked["out"], r"\s+", " "))
    full = with_result(bare)
    return F.struct(full.alias("out"), marked["comments"].alias("comments"), marked["variations"].alias("variations"), marked["lines"].alias("lines"), (full != bare).cast("int").alias("results"))


def trimmed_token(token: Column, kept: str = "") -> Column:
    """A token without what is no ASCII letter, digit or kept character at its ends."""
    some = f"A-Za-z0-9{kept}"
    return F.regexp_replace(token, f"^[^{some}]+|[^{some}]+$", "")


def inserted(text: Column, notes: Column) -> Column:
    """A text with notes (struct of offset and note) put in at their offsets, those of one offset in their order: each stretch of text is copied once."""
    by_place = F.sort_array(notes)

    def stretch(n: Column, k: Column) -> Column:
        before = F.when(k == 0, 0).otherwise(F.get(by_place, k - 1)["offset"])
        return F.concat(F.substring(text, before + 1, n["offset"] - before), n["note"])

    last = F.coalesce(F.get(by_place, F.size(by_place) - 1)["offset"], F.lit(0))
    return F.concat(F.array_join(F.transform(by_place, stretch), ""), F.substring(text, last + 1, F.length(text)))


def inspect(text: Column) -> dict[str, Column]:
    """Counters of what cleaning would change."""
    return {
        "boms": F.when(F.startswith(text, F.lit("﻿")), 1).otherwise(0),
        "replacements": F.regexp_count(text, F.lit("\\uFFFD")),
        "carriage_returns": F.regexp_count(text, F.lit("\\r")),
        "controls": F.regexp_count(text, F.lit("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]")),
        "lines": F.regexp_count(text, F.lit("\\n")) + 1,
    }


def reflow(words: Column, width: int = 80) -> Column:
    """Words joined by spaces into lines of at most ``width`` characters; longer words stand alone."""

    def step(a: Column, w: Column) -> Column:
        fits = a["used"] + 1 + F.length(w) <= width
        return (
            F.when(a["used"] == 0, F.struct(F.length(w).alias("used"), F.concat(a["out"], w).alias("out")))
            .when(fits, F.struct((a["used"] + 1 + F.length(w)).alias("used"), F.concat(a["out"], F.lit(" "), w).alias("out")))
            .otherwise(F.struct(F.length(w).alias("used"), F.concat(a["out"], F.lit("\n"), w).alias("out")))
        )

    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("out"))
    return F.aggregate(words, start, step, lambda a: a["out"])


def drop_black_numbers(words: Column) -> Column:
    """Words without move numbers of three dots, apart from the first word that is no glyph; a move glued to one stays."""
    first = F.array_position(F.transform(words, lambda w: ~F.startswith(w, F.lit("$"))), True) - 1

    def bare(w: Column, k: Column) -> Column:
        return F.when((k > first) & w.rlike(r"^[0-9]+\.\.\.([^.]|$)"), F.regexp_replace(w, r"^[0-9]+\.\.\.", "")).otherwise(w)

    return F.filter(F.transform(words, bare), lambda w: w != "")


def known_labels(comment: Column, known: Sequence[str]) -> Column:
    """The whole trimmed comment if it is a label, else its words that are, sorted."""
    names = F.array(*(F.lit(k) for k in known))
    whole = F.trim(comment)
    words = F.array_sort(F.array_intersect(F.array_distinct(F.split(whole, r"\s+")), names))
    return F.when(F.array_contains(names, whole), F.array(whole)).otherwise(words)


def key_base(code: Column, letters: str = "A-E") -> Column:
    """A letter and two digits from the first three characters, upper-cased, else unknown."""
    base = F.upper(F.substring(code, 1, 3))
    return F.when(base.rlike(f"^[{letters}][0-9]{{2}}$"), base).otherwise("unknown")


def year_of(date: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(date, r"^([0-9]{4})", 1), F.lit("")), F.lit("unknown"))


def month_of(date: Column) -> Column:
    month = F.regexp_extract(date, r"^([0-9]{4})\.([0-9]{2})", 2)
    return F.when(month != "", F.concat(F.substring(date, 1, 4), F.lit("-"), month)).otherwise("unknown")


def entity_key(fields: Sequence[Column]) -> Column:
    """A hash of fields, white space collapsed, missing ones empty."""
    parts = [F.coalesce(F.trim(F.regexp_replace(f, r"\s+", " ")), F.lit("")) for f in fields]
    return F.md5(F.concat_ws("\u001f", *parts))


def canonical_fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with sorted keys."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def comment_delta(new: Column, old: Column) -> Column:
    """What a longer comment adds to an older one it starts or ends with, else all of it; braces are kept apart."""
    old_ = F.coalesce(old, F.lit(""))
    rest = (
        F.when(F.startswith(new, old_), F.substring(new, F.length(old_) + 1, F.length(new)))
        .when(F.endswith(new, old_), F.substring(new, F.lit(1), F.length(new) - F.length(old_)))
        .otherwise(new)
    )
    return F.replace(F.trim(rest), F.lit("}"), F.lit(")"))
