"""Closed-set columns: the vote and the anonymity flag."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairpref.functions.text import stripped, trimmed
from pairpref.schema import OUTCOME_SPELLINGS, UNKNOWN


def canonical_outcome(winner: Column) -> Column:
    spellings = F.create_map(*[F.lit(x) for x in chain(*OUTCOME_SPELLINGS.items())])
    return F.coalesce(F.try_element_at(spellings, F.lower(trimmed(winner))), F.lit(UNKNOWN))


def anony_truth(anony: Column, dtype: T.DataType) -> Column:
    """true / false for an accepted flag, null for anything else (numbers are not flags)."""
    if isinstance(dtype, T.BooleanType):
        return anony
    if isinstance(dtype, T.StringType):
        text = F.lower(stripped(anony))
        return F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False))
    return F.lit(None).cast("boolean")
