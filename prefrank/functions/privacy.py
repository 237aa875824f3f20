"""Redaction, detection, pseudonymisation and clean-up of text columns.

All functions take and return columns and stay inside the JVM. Patterns run with
``(?U)`` so that digits, word characters, boundaries and spaces follow Unicode.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed

UNICODE = "(?U)"

# Whitespace as str.split() / str.strip() see it: Unicode White_Space plus U+001C..U+001F.
SPACE = r"\s\x{1c}-\x{1f}\x{85}"
SPACE_CHARACTERS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Every digit pattern of both dialects needs at least ten digits of which neighbours are at
# most two other characters apart, so text without such a run skips all digit patterns.
DIGIT_RUN = r"(?U)\d(?:\D{0,2}+\d){9}"


@dataclass(frozen=True)
class Dialect:
    """Ordered redaction rules: (type, pattern, placeholder)."""

    rules: tuple

    @property
    def types(self) -> list[str]:
        return [rule[0] for rule in self.rules]


MAIN = Dialect(fixed.PII_MAIN)
PORTUGUESE = Dialect(fixed.PII_PORTUGUESE)


def _col(text) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _can_match(kind: str, text: Column) -> Column:
    """Cheap necessary condition of a rule."""
    return F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(DIGIT_RUN))


def _runs(dialect: Dialect):
    """Rules in order, neighbouring rules of the same guard kept together."""
    groups: list[tuple[str, list]] = []
    for rule in dialect.rules:
        guard = "email" if rule[0] == "email" else "digits"
        if groups and groups[-1][0] == guard:
            groups[-1][1].append(rule)
        else:
            groups.append((guard, [rule]))
    return groups


def redact(text, dialect: Dialect = MAIN) -> Column:
    """Replace personal data by typed placeholders, rule after rule.

    Placeholders hold neither digits nor '@', so the guards can look at the original.
    """
    text = _col(text)
    current = text
    for guard, rules in _runs(dialect):
        replaced = current
        for _, pattern, placeholder in rules:
            replaced = F.regexp_replace(replaced, UNICODE + pattern, placeholder)
        current = F.when(_can_match(guard, text), replaced).otherwise(current)
    return current


def has_pii(text, dialect: Dialect = MAIN) -> Column:
    """True when any rule matches the text."""
    text = _col(text)
    found = None
    for guard, rules in _runs(dialect):
        hit = None
        for _, pattern, _ in rules:
            match = F.rlike(text, F.lit(UNICODE + pattern))
            hit = match if hit is None else hit | match
        hit = _can_match(guard, text) & hit
        found = hit if found is None else found | hit
    return F.coalesce(found, F.lit(False))


def pii_types(text, dialect: Dialect = MAIN) -> Column:
    """Types whose pattern occurs in the text, each rule seen on its own."""
    text = _col(text)
    return F.array_compact(F.array(*[
        F.when(_can_match(kind, text) & F.rlike(text, F.lit(UNICODE + pattern)), F.lit(kind))
        for kind, pattern, _ in dialect.rules
    ]))


def redacted_types(text, dialect: Dialect = MAIN) -> Column:
    """Types whose step changed the text while redacting in order."""
    text = _col(text)
    current = text
    flags = []
    for kind, pattern, placeholder in dialect.rules:
        hit = _can_match(kind, text) & F.rlike(current, F.lit(UNICODE + pattern))
        flags.append(F.when(hit, F.lit(kind)))
        current = F.regexp_replace(current, UNICODE + pattern, placeholder)
    return F.array_compact(F.array(*flags))


def pseudonymize(value, salt: str) -> Column:
    """HMAC-SHA256 of the value under ``salt`` as 64 hex digits."""
    key = salt.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    message = F.encode(_col(value).cast("string"), "UTF-8")
    digest = F.unhex(F.sha2(F.concat(inner, message), 256))
    return F.sha2(F.concat(outer, digest), 256)


def strip(text) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.btrim(_col(text), F.lit(SPACE_CHARACTERS))


def rstrip(text) -> Column:
    """Trim Unicode whitespace on the right."""
    return F.rtrim(_col(text), F.lit(SPACE_CHARACTERS))


def is_blank(text) -> Column:
    """True for text without any non-space character."""
    return ~F.rlike(_col(text), F.lit(f"(?U)[^{SPACE}]"))


def normalize_text(text) -> Column:
    """Delete control characters, collapse whitespace, trim."""
    cleaned = F.regexp_replace(_col(text), fixed.CONTROL_CHARACTERS, "")
    return strip(F.regexp_replace(cleaned, f"(?U)[{SPACE}]+", " "))
