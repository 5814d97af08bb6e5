"""Identities: canonical JSON and SHA-256 keys, as columns for data and as values for configuration."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value: Any, *, ascii_only: bool = False) -> str:
    """Sorted keys, no blanks. Only plain JSON values are accepted, so equal text means equal value."""

    def plain(item: Any) -> Any:
        if isinstance(item, Mapping):
            return {str(key): plain(member) for key, member in item.items()}
        if isinstance(item, (list, tuple)):
            return [plain(member) for member in item]
        if item is None or isinstance(item, (str, bool, int)):
            return item
        if isinstance(item, float) and math.isfinite(item):
            return item
        raise TypeError(f"not a canonical JSON value: {item!r}")

    return json.dumps(plain(value), ensure_ascii=ascii_only, sort_keys=True, separators=(",", ":"))


def sha256_of(value: Any, *, ascii_only: bool = False) -> str:
    return hashlib.sha256(canonical_json(value, ascii_only=ascii_only).encode("utf-8")).hexdigest()


def label_seed(label: str) -> int:
    """A preregistered seed: the first eight bytes of the label's SHA-256, big-endian."""
    return int.from_bytes(hashlib.sha256(label.encode("utf-8")).digest()[:8], "big")


def battle_id(snapshot: Column, row_index: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", snapshot, row_index.cast("string")), 256)


def _comparable(value: Column, dtype: T.DataType) -> Column:
    """Not-a-number is a missing value wherever it is nested, and a map is compared by sorted key."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    if isinstance(dtype, T.StructType):
        members = [_comparable(value[f.name], f.dataType).alias(f.name) for f in sorted(dtype, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*members))
    if isinstance(dtype, T.ArrayType):
        if _has_special(dtype.elementType):
            return F.transform(value, lambda item: _comparable(item, dtype.elementType))
        return value
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.map_entries(value))
    return value


def _has_special(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_special(f.dataType) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return _has_special(dtype.elementType)
    return isinstance(dtype, (T.DoubleType, T.FloatType, T.MapType))


def row_json(df: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    """The row as canonical JSON text: columns by name, missing values left out."""
    fields = sorted((f for f in df.schema if f.name not in exclude), key=lambda f: f.name)
    return F.to_json(F.struct(*[_comparable(df[f.name], f.dataType).alias(f.name) for f in fields]))


def _plain(dtype: T.DataType) -> bool:
    """Types whose values are equal exactly when their JSON is."""
    if isinstance(dtype, T.StructType):
        return all(_plain(f.dataType) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return _plain(dtype.elementType)
    return isinstance(dtype, (T.StringType, T.IntegralType, T.BooleanType))


def row_hash(df: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    """64 bits of the row, equal where :func:`row_json` is: texts and numbers as they lie, other values by their JSON."""
    fields = sorted((f for f in df.schema if f.name not in exclude), key=lambda f: f.name)
    values = [df[f.name] if _plain(f.dataType) else F.to_json(F.struct(_comparable(df[f.name], f.dataType).alias("v"))) for f in fields]
    return F.xxhash64(*values) if values else F.lit(0).cast("bigint")


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)
