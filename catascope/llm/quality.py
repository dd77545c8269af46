"""Line-first quality rules.

Every line of a document is judged by punctuation, navigation, symbol, shouting, repetition and
boilerplate rules; failing lines are removed and a document that loses too much of its text is
rejected. Everything is a column expression over one row: no shuffle, no Python on the executors.

Defined cases: a null or blank text has no word, fails the base rules and is not kept; repeated rows
and ties are judged row by row; an empty table gives an empty result; other columns pass through
untouched in ``clean_documents`` and are ignored by ``quality_report``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.llm.common import bind, space_words, window_hashes

#: Phrases of boilerplate lines (searched in the lower-cased line).
BOILERPLATE = (
    "all rights reserved", "licensed under", "license, version", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "accept cookies", "uses cookies", "click here", "sign in", "log in to", "subscribe now",
    "subscribe to", "enable javascript", "powered by", "copyright (c)", "copyright ©", "lorem ipsum",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules. Ratios are per word of the line."""

    max_symbol_ratio: float = 0.2  # characters of #*$%&|<> per word
    max_bang_ratio: float = 0.3  # words ending in !! per word
    max_separator_ratio: float = 0.15  # free-standing | » › • per word
    max_upper_ratio: float = 0.7  # capitals per ASCII letter
    min_distinct_ratio: float = 0.2  # distinct words per word, from long_line words on
    long_line: int = 12  # a line of so many words must hold sentence punctuation
    max_boilerplate_words: int = 60  # longer lines are prose that may mention a phrase
    min_kept_ratio: float = 0.5  # of the document's words


def _count(s: Column, pattern: str) -> Column:
    """Characters that match a one-character class (meant for classes that match few)."""
    return F.length(s) - F.length(F.regexp_replace(s, pattern, ""))


def _boilerplate(low: Column) -> Column:
    return reduce(or_, (low.contains(p) for p in BOILERPLATE))


def split_lines(text: Column) -> Column:
    """Array of (line, its words)."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), space_words(x).alias("words")))


def line_fails(line: Column, words: Column, rules: LineRules = LineRules()) -> Column:
    """True for a line that one of the rules rejects; blank lines never fail."""
    n = F.size(words)
    per = lambda c: c / n
    return (n > 0) & (
        (per(_count(line, r"[#*$%&|<>]")) > rules.max_symbol_ratio)
        | (per(_count(line, "[|»›•]")) > rules.max_separator_ratio)
        | (line.contains("!!") & (per(F.size(F.split(line, r"!!(?=\s|$)")) - 1) > rules.max_bang_ratio))
        | ((n >= 4) & line.rlike("[A-Z]{4}") & (_count(line, "[A-Z]") > rules.max_upper_ratio * _count(line, "[A-Za-z]")))
        | ((n >= rules.long_line) & (per(F.size(F.array_distinct(words))) < rules.min_distinct_ratio))
        | ((n >= rules.long_line) & ~line.rlike(r"[.!?…。]"))
        | ((n <= rules.max_boilerplate_words) & bind(F.lower(line), _boilerplate))
    )


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside ``width``-word windows that occur twice or more in the array (first included).

    Windows are compared by 64-bit hashes within one document; only documents with a repeated
    window pay for the sort that finds its positions.
    """
    hashes = window_hashes(F.transform(words, lambda w: F.xxhash64(w)), width)
    far = F.lit(1 << 30)

    def repeats(order: Column) -> Column:
        # neighbours of equal hash in sorted order; both ends are repeated windows
        pairs = F.zip_with(order, F.slice(order, F.lit(2), far), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    def length(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, F.lit(2), far), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return bind(bind(order, repeats), length)

    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def quality_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per input row: base counts, base verdict, words left by line removal, final verdict."""
    zero = F.lit(0).cast("long")

    def judged(lines: Column, words: Column) -> Column:
        worded = F.transform(F.filter(lines, lambda x: F.size(x["words"]) > 0), lambda x: x["line"])
        failing = F.filter(lines, lambda x: line_fails(x["line"], x["words"], rules))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            bind(worded, lambda w: (F.size(w) - F.size(F.array_distinct(w))).cast("long")).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.aggregate(failing, zero, lambda s, x: s + F.size(x["words"])).alias("n_removed_words"),
        )

    whole = bind(
        split_lines(F.coalesce(F.col("text"), F.lit(""))),
        lambda lines: bind(F.flatten(F.transform(lines, lambda x: x["words"])), lambda words: judged(lines, words)),
    )
    return (
        docs.select("doc_id", _count(F.coalesce(F.col("text"), F.lit("")), r"[#*$%&|<>]").cast("long").alias("n_symbols"), whole.alias("r"))
        .select(
            "doc_id", "r.n_words", "r.word_chars", "n_symbols", "r.n_dup_lines", "r.n_repeat_words",
            ((F.col("r.n_words") < 20) | (100 * F.col("r.n_repeat_words") > 30 * F.col("r.n_words"))).alias("base_failed"),
            "r.n_lines", "r.n_removed_words",
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= rules.min_kept_ratio * F.col("n_words")))
    )


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Kept documents with their failing lines removed; ``n_chars`` (if present) follows the text."""

    def judged(lines: Column, words: Column) -> Column:
        n = F.size(words)
        good = F.filter(lines, lambda x: ~line_fails(x["line"], x["words"], rules))
        base = (n >= 20) & (100 * repeated_words(words) <= 30 * n)

        def verdict(g: Column) -> Column:
            left = F.aggregate(g, F.lit(0), lambda s, x: s + F.size(x["words"]))
            return F.when(left >= rules.min_kept_ratio * n, F.array_join(F.transform(g, lambda x: x["line"]), "\n"))

        return F.when(base, bind(good, verdict))

    whole = bind(
        split_lines(F.col("text")),
        lambda lines: bind(F.flatten(F.transform(lines, lambda x: x["words"])), lambda words: judged(lines, words)),
    )
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    out = docs.select(*others, whole.alias("text")).where(F.col("text").isNotNull())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
