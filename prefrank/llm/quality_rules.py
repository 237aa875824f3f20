"""Line-first quality rules, native.

Every line is judged on its own: navigation bars, boilerplate phrases, and lines that are
mostly symbols or shouting go. A document that loses too much of its text with them, that
is short, or that repeats itself is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefrank.llm.scratch import tidy

LEAST_WORDS = 20
WINDOW = 8
MOST_REPEATED = 30  # per cent of the words
#: A document that loses more than this share of its characters with its failing lines is rejected.
MOST_LOST = 0.5
#: Symbols and exclamation marks, as a share of a line's characters outside white space.
MOST_SYMBOLS = 0.1
SEPARATORS = "|»›•"
LEAST_SEPARATORS = 3
BOILERPLATE = (
    r"(?i)\b(all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings|consent)|uses cookies|"
    r"enable javascript|lorem ipsum|sign up for our newsletter|click here to|skip to (main )?content|"
    r"share (this )?on (facebook|twitter))\b")
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def words_of(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: _without(line, BLANKS) != "")


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _covered(windows: Column) -> Column:
    """Words in the windows that occur again; ``windows``: a hash for each window's first word."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        again = lambda k, j: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        return F.sort_array(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: again(k, k - 1) | again(k, k + 1)),
            lambda k: F.get(s, k)["i"]))

    def total(p: Column) -> Column:
        step = lambda k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW)))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda n, k: n + step(k))

    return _once(_once(ordered, places), total)


def repeated_words(words: Column) -> Column:
    """Words that lie in a run of `WINDOW` words found twice or more in the text."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    counted = _once(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_covered(w)))
    return F.when(F.size(words) >= WINDOW, counted).otherwise(0).cast("bigint")


def line_passes(line: Column) -> Column:
    """Whether a line stays: no navigation bar, no boilerplate phrase, no symbol soup or shouting."""
    solid = F.length(_without(line, BLANKS))
    symbols = solid - F.length(_without(line, BLANKS + SYMBOLS + "!"))
    separators = F.length(line) - F.length(_without(line, SEPARATORS))
    navigation = (separators >= LEAST_SEPARATORS) & (separators * 20 > solid)
    return ~(navigation | (symbols > MOST_SYMBOLS * solid) | line.rlike(BOILERPLATE))


def apply_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``kept`` and ``cleaned``, the text without its failing lines.

    Null text has no words; it and empty texts fail for being short and their ``cleaned`` is
    empty. Columns with the added names are replaced, others pass through.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned")
    rows = tidy(docs, *added)
    whole = F.coalesce(F.col(text), F.lit(""))
    of_words = _once(words_of(whole), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("repeated")))
    of_lines = _once(lines_of(whole), lambda lines: F.struct(
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("again"),
        F.array_join(F.filter(lines, line_passes), "\n").alias("cleaned")))
    measured = rows.withColumns({"_words": of_words, "_lines": of_lines})
    n, repeated = F.col("_words.n"), F.col("_words.repeated")
    solid = F.length(_without(whole, BLANKS))
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
    enough = F.length(_without(F.col("_lines.cleaned"), BLANKS)) >= (1 - MOST_LOST) * solid
    return measured.select(
        *rows.columns, n.alias("n_words"), solid.cast("bigint").alias("word_chars"),
        (F.length(whole) - F.length(_without(whole, SYMBOLS))).cast("bigint").alias("n_symbols"),
        F.col("_lines.again").alias("n_dup_lines"), repeated.alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & enough).alias("kept"), F.col("_lines.cleaned").alias("cleaned"))
