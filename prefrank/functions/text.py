"""Model input text, token arrays, cache keys and parsing of generated text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.functions.privacy import SPACE, _col, strip

# Most characters are found in the first range; the class has all but spaces.
WORD = f"(?U)[!-~[^{SPACE}]]+"


def words(text) -> Column:
    """Whitespace-separated words."""
    return F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0))


def hash_word(word) -> Column:
    return F.xxhash64(word)


def token_ids(text, vocabulary: int, limit: int | None = None, hash_of=hash_word) -> Column:
    """Hashed word ids in ``[0, vocabulary)``, of the first ``limit`` words if it is given.

    ``hash_of`` turns a word into a whole number.
    """
    found = words(text)
    if limit is not None:
        found = F.slice(found, 1, limit)
    return F.transform(found, lambda w: F.pmod(hash_of(w), F.lit(vocabulary)).cast("int"))


def truncate_triple(prompt, response_a, response_b, max_length: int,
                    reserved: int = fixed.RESERVED_TOKENS) -> Column:
    """Cut three token arrays to one budget: keep the prompt, share the rest evenly.

    A prompt over the budget is cut to leave room for two tokens per response.
    """
    prompt, a, b = _col(prompt), _col(response_a), _col(response_b)
    budget = F.lit(max_length - reserved) - F.size(prompt)
    too_long = budget < 0
    share = F.when(too_long, F.lit(2)).otherwise(F.floor(budget / 2).cast("int"))
    prompt_room = max(max_length - reserved - 4, 0)
    return F.struct(
        F.when(too_long, F.slice(prompt, 1, prompt_room)).otherwise(prompt).alias("prompt"),
        F.slice(a, F.lit(1), share).alias("response_a"),
        F.slice(b, F.lit(1), share).alias("response_b"),
    )


def pad_encoding(ids, max_length: int, pad_id: int = 0) -> Column:
    """Fixed-length ids plus attention mask."""
    kept = F.slice(_col(ids), 1, max_length)
    missing = F.lit(max_length) - F.size(kept)
    return F.struct(
        F.concat(kept, F.array_repeat(F.lit(pad_id), missing)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(kept)),
                 F.array_repeat(F.lit(0), missing)).alias("attention_mask"),
    )


def input_text(prompt, response_a, response_b, segment) -> Column:
    """Segment tag followed by the three tagged texts."""
    return F.concat(
        F.lit("["), _col(segment), F.lit("] <prompt>"), _col(prompt),
        F.lit("</prompt> <response_a>"), _col(response_a),
        F.lit("</response_a> <response_b>"), _col(response_b), F.lit("</response_b>"),
    )


def cache_key(prompt, response_a, response_b, segment, namespace: str = "pref:") -> Column:
    """Namespaced SHA-256 over the raw request."""
    bar = F.lit("|")
    raw = F.concat(_col(prompt), bar, _col(response_a), bar, _col(response_b), bar, _col(segment))
    return F.concat(F.lit(namespace), F.sha2(raw, 256))


def between(text, start: str, end: str) -> Column:
    """Trimmed text between the first pair of markers, '' when absent."""
    pattern = f"(?s){re.escape(start)}(.*?){re.escape(end)}"
    return strip(F.regexp_extract(_col(text), pattern, 1))


def after(text, marker: str) -> Column:
    """Text after the first marker, '' when absent."""
    text = _col(text)
    at = F.locate(marker, text)
    return F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise("")


def parse_generated(raw) -> Column:
    """Split generated text into its reasoning and its answer.

    The whole text is the answer when nothing follows the closing marker.
    """
    raw = _col(raw)
    answer = strip(after(raw, fixed.THINK_CLOSE))
    return F.struct(
        between(raw, fixed.THINK_OPEN, fixed.THINK_CLOSE).alias("thinking"),
        F.when(answer == "", strip(raw)).otherwise(answer).alias("response"),
    )


def cut(text, length: int) -> Column:
    """First ``length`` characters."""
    return F.substring(_col(text), 1, length)


def ellipsis(text, length: int) -> Column:
    """First ``length`` characters, with '...' when something was cut."""
    text = _col(text)
    return F.when(F.length(text) > length, F.concat(cut(text, length), F.lit("..."))).otherwise(text)
