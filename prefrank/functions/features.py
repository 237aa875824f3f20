"""Pair features: structure of each response, comparison, segment one-hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.functions.privacy import SPACE, _col
from prefrank.functions.text import words

# One match per sentence that holds a word. Most characters are found in the first range of a class.
SENTENCE = f"(?U)[/-~[^.{SPACE}]][^.]*"
# Words of a sentence that follow a full stop without a space, and full stops that begin a word of the text.
AFTER_STOP = f"(?U)\\.[/-~[^.{SPACE}]]"
STOP_FIRST = f"(?U)\\.(?<![^{SPACE}]\\.)"

#: Names of the nine features of two responses in vector order.
PAIR_FEATURES = ["a_chars", "a_sentence_words", "a_ttr", "b_chars", "b_sentence_words", "b_ttr", "len_delta", "jaccard",
                 "sentence_delta"]


def lower_words(text) -> Column:
    return words(F.lower(_col(text)))


def words_per_sentence(text, word_count=None) -> Column:
    """Mean words per sentence; sentences end at '.', blank ones do not count.

    A word of a sentence follows a space, as a word of the text that does not begin with '.', or it follows a '.'. So
    no word is taken out of the text again if ``word_count``, the number of words of the text, is known.
    """
    text = _col(text)
    word_count = F.size(words(text)) if word_count is None else _col(word_count)
    sentences = F.regexp_count(text, F.lit(SENTENCE))
    count = word_count - F.regexp_count(text, F.lit(STOP_FIRST)) + F.regexp_count(text, F.lit(AFTER_STOP))
    return F.coalesce(F.try_divide(count, sentences), F.lit(0.0))


def type_token_ratio(tokens) -> Column:
    """Distinct share of a word array; 0 for an empty one."""
    tokens = _col(tokens)
    return F.coalesce(F.try_divide(F.size(F.array_distinct(tokens)), F.size(tokens)), F.lit(0.0))


def jaccard(tokens_a, tokens_b) -> Column:
    """Set overlap of two word arrays; 0 when both are empty."""
    a, b = _col(tokens_a), _col(tokens_b)
    return _overlap(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))


def _overlap(shared, size_a, size_b) -> Column:
    """Share of the common words among all different ones."""
    return F.coalesce(F.try_divide(shared, size_a + size_b - shared), F.lit(0.0))


def length_delta(length_a, length_b) -> Column:
    """Absolute length difference over the total length."""
    a, b = _col(length_a), _col(length_b)
    return F.abs(a - b) / F.greatest(a + b, F.lit(1))


def segment_index(segment) -> Column:
    """0, 1, 2 by segment; null for an unknown one."""
    mapping = F.create_map(*[F.lit(x) for i, s in enumerate(fixed.SEGMENTS) for x in (s, i)])
    return F.try_element_at(mapping, _col(segment))


def one_hot(segment) -> list[Column]:
    return [F.when(_col(segment) == s, 1.0).otherwise(0.0) for s in fixed.SEGMENTS]


def finite(value) -> Column:
    """NaN to 0 and infinities to plus or minus 1e6."""
    value = _col(value)
    return (F.when(F.isnan(value), 0.0)
            .when(value == float("inf"), 1e6)
            .when(value == float("-inf"), -1e6)
            .otherwise(value))


def cosine(a, b) -> Column:
    """Cosine of two numeric arrays; null when a norm is zero."""
    a, b = _col(a), _col(b)

    def dot(x, y):
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q)
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pair_features(a, b, a_words, b_words, a_sentence_words, b_sentence_words) -> dict[str, Column]:
    """The nine features of two responses in vector order.

    Word arrays and words per sentence come as inputs because several features share them.
    """
    a, b, sa, sb = _col(a), _col(b), _col(a_sentence_words), _col(b_sentence_words)
    return {
        "a_chars": F.length(a), "a_sentence_words": sa, "a_ttr": type_token_ratio(a_words),
        "b_chars": F.length(b), "b_sentence_words": sb, "b_ttr": type_token_ratio(b_words),
        "len_delta": length_delta(F.length(a), F.length(b)),
        "jaccard": jaccard(a_words, b_words),
        "sentence_delta": F.abs(sa - sb),
    }


def aux_vector(features: dict[str, Column], segment, extra: tuple[Column, ...] = ()) -> Column:
    """Float vector of the nine features, the segment one-hot and any ``extra`` columns."""
    parts = [c.cast("double") for c in features.values()] + one_hot(segment) + list(extra)
    return F.array(*[finite(p).cast("float") for p in parts])


def with_struct_features(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add characters, words per sentence and type-token ratio of one text."""
    df = df.withColumn("_words", lower_words(text))
    return df.withColumns({
        f"{prefix}_chars": F.length(text),
        f"{prefix}_sentence_words": words_per_sentence(text, F.size("_words")),
        f"{prefix}_ttr": type_token_ratio("_words"),
    }).drop("_words")


def _apart(function, *columns) -> Column:
    """``function`` of columns, evaluated by itself.

    In one generated method with all other steps, the loops over matches and words make that method too long for the
    JVM to compile, and then every one of them is interpreted.
    """
    fields = F.struct(*[_col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    return F.transform(F.array(fields), lambda s: function(*[s[f"_{i}"] for i in range(len(columns))]))[0]


def _with_pair_features(df: DataFrame, response_a: str, response_b: str, names: list[str]) -> DataFrame:
    """Add the nine pair features under ``names``.

    What several features use, and every feature, is a column of its own projection: an expression that is
    used twice in one would be evaluated twice.
    """
    a, b = F.col(response_a), F.col(response_b)
    df = df.withColumns({"_wa": _apart(lower_words, a), "_wb": _apart(lower_words, b)})
    df = df.withColumns({
        "_da": _apart(F.array_distinct, "_wa"), "_db": _apart(F.array_distinct, "_wb"),
        "_sa": _apart(words_per_sentence, a, F.size("_wa")), "_sb": _apart(words_per_sentence, b, F.size("_wb"))})
    df = df.withColumns({"_both": F.size(_apart(F.array_intersect, "_da", "_db")), "_na": F.size("_da"), "_nb": F.size("_db"),
                         "_ca": F.length(a), "_cb": F.length(b)})
    ratio = lambda n, words_: F.coalesce(F.try_divide(F.col(n), F.size(words_)), F.lit(0.0))
    features = [F.col("_ca"), F.col("_sa"), ratio("_na", "_wa"), F.col("_cb"), F.col("_sb"), ratio("_nb", "_wb"),
                length_delta("_ca", "_cb"), _overlap(F.col("_both"), F.col("_na"), F.col("_nb")), F.abs(F.col("_sa") - F.col("_sb"))]
    return df.withColumns(dict(zip(names, features))).drop(
        "_wa", "_wb", "_sa", "_sb", "_da", "_db", "_both", "_na", "_nb", "_ca", "_cb")


def with_pair_features(df: DataFrame, response_a: str = "response_a",
                       response_b: str = "response_b") -> DataFrame:
    """Add the nine pair features as named columns."""
    return _with_pair_features(df, response_a, response_b, PAIR_FEATURES)


def with_aux_vector(df: DataFrame, response_a: str = "response_a", response_b: str = "response_b",
                    segment: str = "segment", out: str = "x_aux",
                    extra: tuple[Column, ...] = ()) -> DataFrame:
    """Add the 12-dimensional float vector; ``extra`` columns are appended behind it."""
    names = [f"_{name}" for name in PAIR_FEATURES]
    df = _with_pair_features(df, response_a, response_b, names)
    return df.withColumn(out, aux_vector({name: F.col(name) for name in names}, segment, extra)).drop(*names)
