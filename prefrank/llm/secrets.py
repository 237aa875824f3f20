"""Secret scan: fixed patterns, and sliding-window entropy of candidate strings."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefrank.llm.scratch import small_batches, tidy
from prefrank.llm.words import slices, utf8

#: Kinds of spans, in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
#: A text without any of these, lower-cased, has no assignment.
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
MARK = "[SECRET]"

#: Window in characters, and bits per character that a window must reach by the class of its string.
WINDOW = 20
BITS = {"hex": 3.0, "alphanumeric": 3.6, "base64": 3.7}
#: Strings that look random and are none.
ALLOWED = (
    re.compile(r"[A-Za-z_=+/-]+"),  # no digit: words, paths, separators
    re.compile(r"[0-9_=+/-]+"),  # no letter: numbers, dates
)
#: The same for the parts of a string between `/` and `=`; what is beside such a part is judged without it.
ALLOWED_PARTS = (
    re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"),  # UUID
    re.compile(r"(?i).*(example|placeholder|changeme|xxxx|0123456789).*"),
)

_PART = re.compile("[^/=]+")
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", np.uint8)] = True
_LOG = [0.0] + [c * math.log2(c) for c in range(1, 4096)]


def char_class(value: str) -> str:
    if re.fullmatch("[0-9a-fA-F]+", value):
        return "hex"
    return "alphanumeric" if value.isalnum() else "base64"


def entropy_spans(value: str, window: int = WINDOW, bits: dict[str, float] = BITS) -> list[tuple[int, int]]:
    """Merged windows of ``value`` whose Shannon entropy reaches the threshold of its class.

    The sum of c * log2(c) over character counts c changes by two terms when the window moves.
    """
    if len(value) < window:
        return []
    least, counts, total, found = bits[char_class(value)], {}, 0.0, []
    for i, new in enumerate(value):
        c = counts.get(new, 0)
        total += _LOG[c + 1] - _LOG[c]
        counts[new] = c + 1
        if i >= window:
            c = counts[old := value[i - window]]
            total += _LOG[c - 1] - _LOG[c]
            counts[old] = c - 1
        if i + 1 >= window and math.log2(window) - total / window >= least - 1e-9:
            begin = i + 1 - window
            if found and begin <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((begin, i + 1))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    lowered = text.encode().lower()
    if any(hint in lowered for hint in ASSIGN_HINTS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return spans


def without(begin: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a range outside of other ranges."""
    left = []
    for a, b in sorted(taken):
        if begin < a < end:
            left.append((begin, a))
        begin = max(begin, b)
    return [*left, (begin, end)] if begin < end else left


def spans_of(text: str, candidates: list[tuple[int, int]], allowed=ALLOWED,
             allowed_parts=ALLOWED_PARTS) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind; ``candidates``: its runs of candidate characters.

    Windows are scored inside what other spans and allowed parts leave of a run.
    """
    spans = base_spans(text)
    for begin, end in candidates:
        spans += [("hex", *m.span()) for m in HEX.finditer(text, begin, end)]
    base = [(a, b) for _, a, b in spans]
    for begin, end in candidates:
        taken = [(a, b) for a, b in base if a < end and begin < b]
        parts = [m.span() for m in _PART.finditer(text, begin, end)]
        taken += [part for part in parts if any(rule.fullmatch(text, *part) for rule in allowed_parts)]
        for a, b in without(begin, end, taken):
            if b - a >= WINDOW and not any(rule.fullmatch(text, a, b) for rule in allowed):
                spans += [("entropy", a + i, a + j) for i, j in entropy_spans(text[a:b])]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _candidates(part: pa.Array) -> list[list[tuple[int, int]]]:
    """For each text its runs of `WINDOW` or more candidate characters, as code points."""
    data, offsets = utf8(part)
    inside = _CANDIDATE[data]
    limits = np.zeros(len(data) + 1, bool)
    limits[offsets] = True
    before = np.r_[False, inside[:-1]] & ~limits[:-1] if len(data) else inside
    after = np.r_[inside[1:], False] & ~limits[1:] if len(data) else inside
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long = last - first >= WINDOW
    first, last = first[long], last[long]
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(part))]
    if len(first):
        chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        doc = np.searchsorted(offsets, first, side="right") - 1
        base = chars[offsets[doc]]
        for d, a, b in zip(doc.tolist(), (chars[first] - base).tolist(), (chars[last] - base).tolist()):
            out[d].append((a, b))
    return out


def _scan(texts: pa.Array):
    for part in slices(texts):
        for text, candidates in zip(part.to_pylist(), _candidates(part), strict=True):
            yield text or "", spans_of(text or "", candidates)


def secret_spans():
    """The UDF, made when a session is there."""

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        """Spans of one text in code points, end exclusive; null text has none."""
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for _, spans in _scan(texts)], kind)

    return run


def _redacted():
    """The UDF, made when a session is there."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text, spans in _scan(texts):
            parts, at = [], 0
            for _, begin, end in sorted((s for s in spans), key=lambda s: s[1]):
                if begin >= at:
                    parts += [text[at:begin], MARK]
                at = max(at, end)
            out.append("".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    return run


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: spans (kind, start, end) in code points, by start and kind.

    Null and empty texts have none. A column ``secrets`` is replaced, others pass through.
    """
    small_batches(docs.sparkSession)
    return tidy(docs, "secrets").withColumn("secrets", secret_spans()(F.col(text)))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of `scan_secrets` in ``text`` replaced by a mark; null text stays null."""
    small_batches(docs.sparkSession)
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), _redacted()(F.col(text))))
