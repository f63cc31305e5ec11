"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order character models are trained from labelled samples, one of random strings
and one of ordinary identifiers. A string's score is the log ratio of its likelihoods;
strings above a threshold are added to the matches of the fixed patterns. The random
strings are drawn in the forms that keys have, apart from the fixed patterns; the ordinary
ones are identifiers of the corpus. Training and scoring are column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, workspace
from .spans import characters, clear_of, count_of, joined, matches, no_spans, ordered

#: The patterns of the scan, possessive where that changes no match.
ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
#: Strings of 12 characters or more with a digit or, after the first character, a capital.
CANDIDATE = r"(?=[A-Za-z+/_=-][a-z+/_=-]*+[A-Z0-9]|[0-9])[A-Za-z0-9+/_=-]{12,}+"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{6,}+"
KINDS = ("assign", "access", "hex")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."


def base_spans(text: Column) -> Column:
    """Matches of the fixed patterns; an assignment's value has 12 characters at least."""
    assign = F.filter(matches(text, ASSIGN, 0, KINDS[0]), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= 12)
    access = F.when(text.contains("AKIA"), matches(text, ACCESS, 1, KINDS[1])).otherwise(no_spans())
    return ordered(assign, access, matches(text, HEX, 2, KINDS[2]))


def train(samples: DataFrame, smoothing: float = 0.5, drawn: float = 5.0) -> list[float] | None:
    """Log ratios of character transitions from samples (value, label); 1 marks random strings.

    A flat table of (n + 1) x (n + 1) entries for the n characters of ALPHABET, 0 standing
    for the start and for any other character. Transitions are drawn towards the
    characters' own shares by ``drawn`` counts, so that a character that a model hardly
    ever saw is rare after any other. None without both labels.
    """
    n = len(ALPHABET) + 1
    text = F.concat(F.lit("\u0000"), F.col("value"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("value")), lambda i: F.substring(text, i, F.lit(2))))
    pairs = samples.where(F.length("value") > 0).select("label", pair.alias("pair"))
    code = [F.position(F.substring("pair", k, 1), F.lit(ALPHABET)) for k in (1, 2)]
    counted = pairs.groupBy("label", code[0].alias("a"), code[1].alias("b")).count().collect()  # 2 n^2 rows at most
    if {r["label"] for r in counted} != {0, 1}:
        return None
    logs = []
    for label in (1, 0):
        move, single = [[0] * n for _ in range(n)], [smoothing] * n
        for r in counted:
            if r["label"] == label:
                move[r["a"]][r["b"]] += r["count"]
                single[r["b"]] += r["count"]
        whole = sum(single)
        logs.append([math.log((move[a][b] + drawn * single[b] / whole) / (sum(move[a]) + drawn)) for a in range(n) for b in range(n)])
    return [random - ordinary for random, ordinary in zip(*logs, strict=True)]


def log_ratio(value: Column, table: list[float]) -> Column:
    """A string's log-likelihood ratio, random against ordinary."""
    n = len(ALPHABET) + 1
    given = F.from_json(F.lit("[" + ",".join(f"{x:.3f}" for x in table) + "]"), "array<double>")

    def step(a: Column, c: Column) -> Column:
        at = F.position(c, F.lit(ALPHABET))
        return F.struct(at.alias("at"), (a["sum"] + F.element_at(given, a["at"] * n + at + 1)).alias("sum"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))
    return F.aggregate(characters(value), start, step, lambda a: a["sum"])


def random_strings(spark: SparkSession, n: int, seed: int = 29) -> DataFrame:
    """n seeded random strings of 12 to 40 characters: letters and digits, base64, hex, capitals and digits, in turn."""
    at = spark.range(n)
    raw = F.base64(F.unhex(F.sha2(F.concat_ws(":", F.lit(seed), "id"), 512)))
    plain = F.regexp_replace(raw, "[+/=]", "")
    hexed = F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256)
    form = F.when(F.col("id") % 4 == 0, plain).when(F.col("id") % 4 == 1, raw).when(F.col("id") % 4 == 2, hexed).otherwise(F.upper(plain))
    return at.select(F.substring(form, F.lit(1), (F.pmod(F.xxhash64("id"), F.lit(29)) + 12).cast("int")).alias("value"), F.lit(1).alias("label"))


def ordinary_identifiers(docs: DataFrame, id_col: str, text_col: str, sample_docs: int, space: str) -> DataFrame:
    """Identifiers, clear of the fixed patterns' matches, of the ``sample_docs`` rows with the smallest hash of id and text, as label 0.

    The drawn texts are written first, so that the patterns run on these only.
    """
    known = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    least = known.select("h").orderBy("h").limit(sample_docs).agg(F.max("h").alias("most"))
    drawn = known.join(F.broadcast(least), F.col("h") <= F.col("most")).select("text").distinct().limit(sample_docs)
    drawn = stash(drawn, space, "drawn")
    plain = F.filter(matches(F.col("text"), IDENTIFIER, 9, "word"), lambda s: F.length(s["text"]) < 60)
    found = drawn.select("text", base_spans(F.col("text")).alias("base"))
    return found.select(F.explode(clear_of(plain, F.col("base"))).alias("s")).select(F.col("s.text").alias("value"), F.lit(0).alias("label"))


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    samples: DataFrame | None = None,
    threshold: float = 12.0,
    sample_docs: int = 1000,
    sample_strings: int = 4000,
) -> DataFrame:
    """One row a document: doc_id, base and spans (arrays of start, rank, kind, end, text, score).

    base holds the fixed patterns' matches; spans also the strings of 12 characters or more,
    clear of those, whose log ratio reaches ``threshold``, as kind ``markov``. Without
    ``samples`` (value, label) the models are trained on ``sample_strings`` random strings
    and the identifiers of at most ``sample_docs`` documents (the fit's bounds); without
    examples of both kinds nothing is added. Null texts count as empty; very long texts are
    searched whole. Repeated rows are returned each; other columns are not read; an empty
    table gives an empty result.
    """
    if samples is None:
        samples = ordinary_identifiers(docs, id_col, text_col, sample_docs, workspace(docs.sparkSession)).union(random_strings(docs.sparkSession, sample_strings))
    table = train(samples)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    if table is None:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    rows = rows.select("doc_id", "base", clear_of(matches(F.col("text"), CANDIDATE, 3, "markov"), F.col("base")).alias("more"))
    scored = F.transform("more", lambda s: s.withField("score", log_ratio(s["text"], table)))
    rows = rows.select("doc_id", "base", F.filter(scored, lambda s: s["score"] >= threshold).alias("more"))
    return rows.select("doc_id", "base", ordered(F.col("base"), F.col("more")).alias("spans"))


def digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, counts of the base kinds, the base spans' SHA-256 and all spans as text."""
    return found.select(
        "doc_id",
        *(count_of(F.col("base"), k).alias(f"n_{k}") for k in kinds),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
