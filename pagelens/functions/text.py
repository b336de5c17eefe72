"""Text column functions (built-in expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JavaScript's \s class; Java's \s is ASCII-only, so the class is spelled out.
JS_WS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def collapse(c: Column) -> Column:
    """Null -> ''; whitespace runs -> one space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), JS_WS, " "))


def text_slice(text: Column, start: Column, end: Column) -> Column:
    """Substring of a frame text given 0-based [start, end) offsets."""
    return F.substring(text, start + 1, end - start)


def cut(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.substring(c, 1, n)).otherwise(c)


def nullif_empty(c: Column) -> Column:
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


def js_quote(c: Column) -> Column:
    """Single-quoted JS literal: backslash, then single quote escaped."""
    esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), esc, F.lit("'"))


def dq_escape(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit('\\"'))
