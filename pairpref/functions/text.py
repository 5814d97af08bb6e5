"""String normalisation with the whitespace rules of the source data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that counts as blank space at the ends of a value (all of them lie below U+3001).
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def stripped(value: Column) -> Column:
    """Strip blank space of any script from both ends; null stays null.

    Text from a visible ASCII character to a visible ASCII character is left as it is, without a search of the blanks.
    """
    visible = lambda end: (end >= F.lit("!")) & (end < F.lit("\x7f"))
    return F.when(visible(value) & visible(F.right(value, F.lit(1))), value).otherwise(F.btrim(value, F.lit(WHITESPACE)))


def trimmed(value: Column) -> Column:
    """Strip; a value that is blank becomes null."""
    text = stripped(value.cast("string"))
    return F.when(text != "", text)


def present(value: Column) -> Column:
    return F.coalesce(stripped(value.cast("string")) != "", F.lit(False))
