"""Battle time: epoch seconds or ISO text, always UTC, with a stable error code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairpref.functions.text import stripped

# Representable range of a 64-bit nanosecond clock (1677 to 2262), in seconds.
RANGE_SECONDS = 9223372036.854775
NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*)?(\.([0-9]+(_[0-9]+)*)?)?([eE][+-]?[0-9]+(_[0-9]+)*)?$"
HAS_DIGIT_MANTISSA = r"^[+-]?\.?[0-9]"
NOT_A_NUMBER = r"^[+-]?nan$"
ISO = (
    r"^[0-9]{4}[-/][0-9]{1,2}([-/][0-9]{1,2}([T ][0-9]{1,2}(:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?)?"
    r"( ?(Z|UTC|[+-][0-9]{2}(:?[0-9]{2})?))?)?)?$"
)


def _seconds(value: Column) -> Column:
    return F.when(F.abs(value) <= RANGE_SECONDS, F.timestamp_seconds(value))


def _iso(text: Column) -> Column:
    clean = F.regexp_replace(text, "/", "-")
    clean = F.regexp_replace(clean, "([T ][0-9]{1,2})( ?(Z|UTC|[+-][0-9:]+))?$", "$1:00$2")
    clean = F.regexp_replace(clean, "([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    # Year-month text ends in two digits after a dash as well; only a full date can carry an offset.
    clean = F.when(text.rlike("^[0-9]{4}[-/][0-9]{1,2}([-/][0-9]{1,2})?$"), F.regexp_replace(text, "/", "-")).otherwise(clean)
    stamp = F.when(text.rlike(ISO), F.try_to_timestamp(clean))
    return F.when(F.abs(F.unix_micros(stamp) / F.lit(1e6)) <= RANGE_SECONDS, stamp)


def read_time(value: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """(is the value missing, its timestamp or null). Booleans and calendar types are never a battle time."""
    if isinstance(dtype, T.NumericType):
        number = value.cast("double")
        return value.isNull() | F.isnan(number), F.when(~F.isnan(number), _seconds(number))
    if isinstance(dtype, T.StringType):
        text = stripped(value)
        absent = value.isNull() | (text == "") | F.lower(text).rlike(NOT_A_NUMBER)
        numeric = text.rlike(NUMBER) & text.rlike(HAS_DIGIT_MANTISSA)
        number = F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
        return absent, F.when(numeric, _seconds(number)).otherwise(_iso(text))
    return value.isNull(), F.lit(None).cast("timestamp")


def time_error(absent: Column, stamp: Column) -> Column:
    return F.when(absent, "missing").when(stamp.isNull(), "invalid").otherwise("ok")
