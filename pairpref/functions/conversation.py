"""Conversations: a column of turns, or text in JSON or Python-literal form, to checked turns.

The error code belongs to the first turn that is wrong. Typed columns and JSON text stay in the JVM; text
that the JVM cannot judge (literal syntax, duplicate keys, members that are not text) is turned, alone, into
plain JSON by one Arrow-batched function and then judged by the same columns.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairpref.functions.text import stripped
from pairpref.schema import ROLES, TURNS


def _with_parsed(df: DataFrame, target: str, error: Column, turns: Column) -> DataFrame:
    """Two steps, so that the error is computed once and only good conversations are rebuilt."""
    df = df.withColumn(f"{target}_error", error)
    return df.withColumn(f"{target}_turns", F.when(F.col(f"{target}_error") == "ok", turns))


def _known(role: Column) -> Column:
    return F.coalesce(F.lower(stripped(role.cast("string"))), F.lit("")).isin(*ROLES)


def _first_code(codes: Column) -> Column:
    bad = F.filter(codes, lambda code: code.isNotNull())
    return F.coalesce(F.try_element_at(bad, F.lit(1)), F.lit("ok"))


def _parse_typed(conversation: Column) -> tuple[Column, Column]:
    """From array<struct<role, content>>."""

    def code(turn: Column) -> Column:
        return (
            F.when(turn.isNull(), "invalid_turn")
            .when(~_known(turn["role"]), "invalid_role")
            .when(turn["content"].isNull(), "missing_content")
        )

    turns = F.transform(
        conversation,
        lambda turn: F.struct(
            F.lower(stripped(turn["role"])).alias("role"), turn["content"].cast("string").alias("content")
        ),
    )
    error = F.when(conversation.isNull(), "missing").otherwise(_first_code(F.transform(conversation, code)))
    return error, turns


def _member(turn: Column, name: str) -> Column:
    return F.try_variant_get(turn, f"$.{name}", "string")


def _kind(turn: Column, name: str) -> Column:
    """VOID for a null member, SQL null for an absent one, otherwise the type of the member."""
    return F.schema_of_variant(F.try_variant_get(turn, f"$.{name}", "variant"))


def _parse_json(document: Column) -> tuple[Column, Column]:
    """From a VARIANT; the error is null when a member that is not text has to be judged elsewhere."""
    items = document.try_cast("array<variant>")

    def code(turn: Column) -> Column:
        kind, role_kind, content_kind = F.schema_of_variant(turn), _kind(turn, "role"), _kind(turn, "content")
        return (
            F.when(turn.isNull() | ~kind.startswith("OBJECT"), "invalid_turn")
            .when(role_kind.isNull(), "missing_role")
            .when(role_kind == "VOID", "invalid_role")
            .when(role_kind != "STRING", "unsure")
            .when(~_known(_member(turn, "role")), "invalid_role")
            .when(content_kind.isNull() | (content_kind == "VOID"), "missing_content")
            .when(content_kind != "STRING", "unsure")
        )

    turns = F.transform(
        items,
        lambda turn: F.struct(
            F.lower(stripped(_member(turn, "role"))).alias("role"), _member(turn, "content").alias("content")
        ),
    )
    error = F.when(items.isNull(), "not_list").otherwise(_first_code(F.transform(items, code)))
    return F.when(document.isNotNull() & (error != "unsure"), error), turns


def _as_text(value: object) -> str | None:
    return None if value is None or value != value else str(value)


def plain_json(text: str | None) -> str | None:
    """A JSON or Python-literal text as JSON whose roles and contents are text or null; None where it cannot be read.

    Only what the column chain looks at is kept; a turn that is no mapping becomes null.
    """
    if text is None:
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            document = read(text)
            break
        except (ValueError, SyntaxError, RecursionError, MemoryError):  # one odd row must not end the run
            continue
    else:
        return None
    if not isinstance(document, list):
        return "{}"
    keep = lambda turn: {k: _as_text(turn[k]) for k in ("role", "content") if k in turn}
    return json.dumps([keep(turn) if isinstance(turn, dict) else None for turn in document])


@F.pandas_udf(T.StringType())
def _plain_json(texts: pd.Series) -> pd.Series:
    return texts.map(plain_json)


def _document(text: Column) -> Column:
    """The text as a VARIANT, null unless it is one JSON value and nothing else.

    Spark's JSON readers stop after the first value. As a list member the text may be followed by "]" or ","
    unnoticed, as an object member by "}" or ","; what passes as both ends where its value ends.
    """
    alone = F.json_object_keys(F.concat(F.lit('{"d":'), text, F.lit("}"))) == F.array(F.lit("d"))
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def _judged(df: DataFrame, target: str, document: Column, text: Column, special: Column) -> DataFrame:
    """From a VARIANT, or from ``text`` made plain first where the VARIANT is null or its members are not text.

    ``special`` is the error of columns without any document, null for all others.
    """
    doc, judged, odd = (f"__{target}_{name}" for name in ("doc", "code", "odd"))
    df = df.withColumn(doc, document)
    error, turns = _parse_json(F.col(doc))
    df = df.withColumn(judged, F.coalesce(special, error))
    df = df.withColumn(odd, F.try_parse_json(_plain_json(F.when(F.col(judged).isNull(), text))))
    odd_error, odd_turns = _parse_json(F.col(odd))
    error = F.coalesce(F.col(judged), odd_error, F.lit("parse_error"))
    return _with_parsed(df, target, error, F.when(F.col(odd).isNotNull(), odd_turns).otherwise(turns)).drop(doc, judged, odd)


def _parse_text(df: DataFrame, column: str, target: str) -> DataFrame:
    name = f"__{target}_text"
    df = df.withColumn(name, stripped(F.col(column)))
    text = F.col(name)
    special = F.when(text.isNull(), "missing").when(text == "", "empty")
    return _judged(df, target, _document(text), text, special).drop(name)


def parse_conversation(df: DataFrame, column: str, target: str) -> DataFrame:
    """Add ``{target}_error`` and ``{target}_turns`` whatever the type of the conversation column.

    Arrays of maps or of other structs and VARIANTs are judged turn by turn, as text is.
    """
    dtype, value = df.schema[column].dataType, F.col(column)
    missing = F.when(value.isNull(), "missing")
    if isinstance(dtype, T.StringType):
        return _parse_text(df, column, target)
    if isinstance(dtype, T.VariantType):
        return _judged(df, target, value, F.to_json(value), missing)
    if isinstance(dtype, T.ArrayType):
        element = dtype.elementType
        if isinstance(element, T.StructType) and {"role", "content"} <= set(element.fieldNames()):
            return _with_parsed(df, target, *_parse_typed(value))
        if not isinstance(element, T.MapType) or isinstance(element.keyType, T.StringType):
            document = F.to_variant_object(value)
            return _judged(df, target, document, F.to_json(document), missing)
        # Keys that are not text: no turn can have a role.
        codes = F.transform(value, lambda turn: F.when(turn.isNull(), "invalid_turn").otherwise("missing_role"))
        return _with_parsed(df, target, missing.otherwise(_first_code(codes)), F.array().cast(TURNS))
    return _with_parsed(df, target, missing.otherwise("not_list"), F.lit(None).cast(TURNS))


def texts_of(turns: Column, role: str) -> Column:
    """Contents of one role, in order; an unusable conversation has none."""
    mine = F.filter(turns, lambda turn: turn["role"] == role)
    return F.coalesce(F.transform(mine, lambda turn: turn["content"]), F.array().cast("array<string>"))
