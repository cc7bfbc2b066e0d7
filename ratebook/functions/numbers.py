"""Decimal parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratebook.functions.text import blank_to_null, try_cast
from ratebook.schemas import AMOUNT


def parse_amount(c, dtype=AMOUNT) -> tuple[Column, Column]:
    """(value, invalid flag). Missing -> (null, false); commas removed;
    text that does not cast -> (null, true). Exponents and signs are accepted."""
    text = blank_to_null(c)
    value = try_cast(F.replace(text, F.lit(","), F.lit("")), dtype.simpleString())
    return value, text.isNotNull() & value.isNull()
