"""Byte, hexadecimal and pattern expressions. Patterns are lower-case hex text, two digits a byte, `??` for any byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, x))


def tail(content: Column, offset: int) -> Column:
    """Bytes behind a header of `offset` bytes; empty if there are none."""
    return F.when(F.octet_length(content) > offset, F.substring(content, F.lit(offset + 1), F.octet_length(content) - offset)).otherwise(F.lit(b""))


def even(content: Column) -> Column:
    """Without an odd last byte."""
    n = F.octet_length(content)
    return F.substring(content, F.lit(1), n - n % 2)


def cut(content: Column, a: Column, b: Column) -> Column:
    """Bytes a to b (exclusive), both inside the content or clamped to it."""
    n = F.octet_length(content)
    lo, hi = clamp(a, F.lit(0), n), clamp(b, F.lit(0), n)
    return F.substring(content, (lo + 1).cast("int"), F.greatest(F.lit(0), hi - lo).cast("int"))


def hex_of(content: Column) -> Column:
    return F.lower(F.hex(content))


def spaced(pattern: Column) -> Column:
    """`b5f0` as `b5 f0`."""
    return F.rtrim(F.regexp_replace(pattern, "(..)", "$1 "))


def unspaced(text: Column) -> Column:
    """`b5 f0` as bytes; blank is empty."""
    return F.unhex(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")))


def byte_at(hexed: Column, i: Column) -> Column:
    """Byte i of hex text as an int."""
    return F.conv(F.substring(hexed, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def byte_array(hexed: Column) -> Column:
    """All bytes of hex text as ints; none for empty text."""
    n = (F.char_length(hexed) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: byte_at(hexed, i))).otherwise(F.array().cast("array<int>"))


def source_tag(device: Column, file_name: Column, start: Column) -> Column:
    """device/name@0x0001f, the name without .dat."""
    digits = F.lower(F.hex(start))
    return F.concat(device, F.lit("/"), F.replace(file_name, F.lit(".dat"), F.lit("")), F.lit("@0x"), F.lpad(digits, F.greatest(F.lit(5), F.char_length(digits)), F.lit("0")))


def matches_at(hexed: Column, pattern: str, at: Column) -> Column:
    """pattern matches hex text at byte `at`."""
    tests = [F.substring(hexed, (2 * (at + i) + 1).cast("int"), F.lit(2)) == pattern[2 * i : 2 * i + 2] for i in range(len(pattern) // 2) if pattern[2 * i] != "?"]
    ok = F.lit(True)
    for t in tests:
        ok = ok & t
    return ok


def first_match(hexed: Column, pattern: str) -> Column:
    """Byte offset of the pattern's first match in hex text, null for none."""
    last = (F.char_length(hexed) / 2).cast("int") - len(pattern) // 2
    at = F.filter(F.sequence(F.lit(0), last), lambda i: matches_at(hexed, pattern, i))
    return F.when(last >= 0, F.get(at, F.lit(0)))


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", " "))


def safe_filename(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9._-]+", "_")


def changelog_date(s: Column) -> Column:
    return F.try_to_timestamp(s, F.lit("MMM d, yyyy"))
