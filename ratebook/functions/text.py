"""Text helpers as Column expressions (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's ``str.strip`` sees it, derived from ``str.isspace``
# (the rule), so a trimmed cell equals what the reference keeps.
WHITESPACE = tuple(c for c in map(chr, range(0x10000)) if c.isspace())


def _java_class(chars) -> str:
    return "[" + "".join("\\u%04X" % ord(c) for c in chars) + "]"


def re2_whitespace_class() -> str:
    """Same character class written for RE2 (used by the DuckDB oracle)."""
    return "[" + "".join("\\x{%04X}" % ord(c) for c in WHITESPACE) + "]"


_WS = _java_class(WHITESPACE)
TRIM_PATTERN = f"^{_WS}+|{_WS}+$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


WHITESPACE_CHARS = "".join(WHITESPACE)


def strip_unicode(c) -> Column:
    """Strip leading/trailing Unicode whitespace (``trim`` only strips U+0020).

    ``btrim`` with the character set: no regex, same result as the pattern
    ``TRIM_PATTERN``."""
    return F.btrim(col_(c), F.lit(WHITESPACE_CHARS))


def blank_to_null(c) -> Column:
    """Null for null or whitespace-only text, else the stripped text."""
    return F.nullif(strip_unicode(c), F.lit(""))


def is_missing(c) -> Column:
    """Missing = null, or text that is blank after stripping."""
    s = col_(c)
    return s.isNull() | (strip_unicode(s.cast("string")) == "")


def mask_digits(c) -> Column:
    """Runs of three or more digits -> ``***``; newlines -> space; trimmed."""
    masked = F.regexp_replace(col_(c), r"\p{Nd}{3,}", "***")
    return strip_unicode(F.regexp_replace(masked, "\n", " "))


def file_extension(name) -> Column:
    """Extension from the last dot, with the dot; names starting with a dot have none."""
    n = col_(name)
    ext = F.regexp_extract(n, r"^.+(\.[^./]*)$", 1)
    return F.when(ext == ".", F.lit("")).otherwise(ext)


def mask_filename(name) -> Column:
    """``***`` plus the extension of the file name."""
    return F.concat(F.lit("***"), file_extension(name))


def sanitize_reason(message, path, name) -> Column:
    """Replace full path, then file name, by the masked name; newlines -> space; trim."""
    masked = mask_filename(name)
    out = F.replace(col_(message), col_(path), masked)
    out = F.replace(out, col_(name), masked)
    return strip_unicode(F.regexp_replace(out, "\n", " "))


def strip_query(url) -> Column:
    """URL without its query string."""
    return F.split_part(col_(url), F.lit("?"), F.lit(1))


def text_preview(text, n: int) -> Column:
    """First ``n`` characters (n > 0) of the text, empty for null."""
    if n <= 0:
        raise ValueError("max_chars must be positive")
    return F.substring(F.coalesce(col_(text), F.lit("")), 1, n)


# Words that mark a failure message as transient.
RETRYABLE_WORDS = ("timeout", "超时", "temporarily", "网络", "connection")
# Error classes that are transient whatever the message.
RETRYABLE_CLASSES = ("TimeoutError", "ConnectionError", "PlaywrightTimeoutError", "PlaywrightError")


def retryable(message, error_class=None) -> Column:
    """Transient failure by message words or by error class."""
    lowered = F.lower(F.coalesce(col_(message), F.lit("")))
    hit = F.lit(False)
    for word in RETRYABLE_WORDS:
        hit = hit | F.contains(lowered, F.lit(word))
    if error_class is not None:
        hit = hit | F.coalesce(col_(error_class).isin(*RETRYABLE_CLASSES), F.lit(False))
    return hit


def try_cast(c, dtype) -> Column:
    """Cast that yields null instead of failing (ANSI mode is on)."""
    return col_(c).try_cast(dtype)
