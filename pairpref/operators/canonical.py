"""Canonical battles: one checked row for every raw row, none dropped."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairpref.functions.conversation import parse_conversation, texts_of
from pairpref.functions.identity import battle_id, fingerprint, row_hash, row_json, sha256_of
from pairpref.functions.outcomes import anony_truth, canonical_outcome
from pairpref.functions.text import present, trimmed
from pairpref.functions.timestamps import read_time, time_error
from pairpref.schema import CANONICAL_SCHEMA_VERSION, IDENTITY_COLUMNS, RAW_COLUMNS, UNKNOWN
from pairpref.session import broadcast_if_small, stored
from pairpref.skew import with_group_size

#: Column by which battles refer to conversations they do not hold, and the texts that are added by it.
REFERENCE = "conversation_ref"
TEXTS = ("prompt_text", "response_a_text", "response_b_text")
BROADCAST_FACTS = 200_000  # rows of flags, lengths and a digest, about 200 bytes each

# A record is valid when all of these hold.
VALIDITY_FLAGS = (
    "model_fields_valid",
    "distinct_models",
    "outcome_valid",
    "conversation_a_valid",
    "conversation_b_valid",
    "conversation_a_has_user",
    "conversation_b_has_user",
    "conversation_a_has_assistant",
    "conversation_b_has_assistant",
    "prompt_pair_consistent",
    "timestamp_valid",
)

#: Columns that say what another one says, as it came.
AS_IT_CAME = {
    "question_id_raw": "question_id",
    "winner_raw": "winner",
    "model_a_raw": "model_a",
    "model_b_raw": "model_b",
    "tstamp_raw": "tstamp",
    "judge_cluster_id": "judge",
    "language_raw": "language",
    "anony_raw": "anony",
}


@dataclass(frozen=True)
class Provenance:
    """Where one snapshot of raw battles came from."""

    source_dataset: str | None
    source_revision: str | None = None
    source_split: str | None = None
    source_file: str | None = None
    source_file_sha256: str | None = None

    @property
    def snapshot_id(self) -> str:
        return sha256_of(asdict(self))


def row_index_report(raw: DataFrame) -> DataFrame:
    """One row: how many indices are negative, missing or repeated, and whether the snapshot is usable."""
    index = F.col("source_row_index")
    per_index = raw.groupBy(index).agg(F.count(F.lit(1)).alias("n"))
    report = per_index.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(index).alias("distinct_indices"),
        F.coalesce(F.sum(F.when(index.isNull() | (index < 0), F.col("n"))), F.lit(0)).alias("unusable_indices"),
    )
    ok = (F.col("rows") == F.col("distinct_indices")) & (F.col("unusable_indices") == 0)
    return report.withColumn("valid", ok)


def require_row_index(raw: DataFrame) -> None:
    """Reject a snapshot whose row indices are not unique non-negative integers."""
    if not isinstance(raw.schema["source_row_index"].dataType, T.IntegralType):
        raise ValueError("source_row_index must contain unique non-negative integers")
    report = row_index_report(raw).first()
    if report["unusable_indices"]:
        raise ValueError("source_row_index must contain unique non-negative integers")
    if not report["valid"]:
        raise ValueError("source_row_index must be unique within a source snapshot")


def with_optional_columns(raw: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """Every raw column is optional; an absent one reads as missing, those of ``but`` aside."""
    absent = {name: F.lit(None).cast("string") for name in RAW_COLUMNS if name not in (*raw.columns, *but)}
    return raw.withColumns(absent) if absent else raw


def duplicate_key(raw: DataFrame, exclude: tuple[str, ...] = IDENTITY_COLUMNS) -> Column:
    """Fingerprint of everything a raw row says, its identity columns aside."""
    return fingerprint(row_json(raw, exclude=exclude))


def _all(flags: tuple[str, ...]) -> Column:
    condition = F.col(flags[0])
    for flag in flags[1:]:
        condition = condition & F.col(flag)
    return condition


def conversation_facts(df: DataFrame) -> DataFrame:
    """Add everything that canonical battles say about their conversations alone."""
    for side in ("a", "b"):
        df = parse_conversation(df, f"conversation_{side}", f"__{side}")
    df = df.withColumns(
        {f"__{side}_{role}": texts_of(F.col(f"__{side}_turns"), role) for side in "ab" for role in ("user", "assistant")}
    )
    df = df.withColumns(
        {
            "conversation_a_valid": F.col("__a_error") == "ok",
            "conversation_b_valid": F.col("__b_error") == "ok",
            "conversation_a_error": F.col("__a_error"),
            "conversation_b_error": F.col("__b_error"),
            "conversation_a_has_user": F.size("__a_user") > 0,
            "conversation_b_has_user": F.size("__b_user") > 0,
            "conversation_a_has_assistant": F.size("__a_assistant") > 0,
            "conversation_b_has_assistant": F.size("__b_assistant") > 0,
            "prompt_pair_consistent": (F.col("__a_error") == "ok")
            & (F.col("__b_error") == "ok")
            & (F.col("__a_user") == F.col("__b_user")),
            "prompt_text": F.coalesce(F.try_element_at("__a_user", F.lit(1)), F.lit("")),
            "response_a_text": F.array_join("__a_assistant", " "),
            "response_b_text": F.array_join("__b_assistant", " "),
        }
    )
    df = df.withColumns(
        {
            "prompt_chars": F.length("prompt_text"),
            "response_a_chars": F.length("response_a_text"),
            "response_b_chars": F.length("response_b_text"),
        }
    )
    difference = F.col("response_a_chars") - F.col("response_b_chars")
    df = df.withColumns({"response_char_diff": difference, "response_abs_char_diff": F.abs(difference)})
    return df.drop(*[f"__{side}_{name}" for side in "ab" for name in ("error", "turns", "user", "assistant")])


def referenced_conversations(conversations: DataFrame) -> DataFrame:
    """The facts of conversations that battles refer to, for :func:`canonicalize`; store them, they are read often.

    ``conversations`` has conversation_a and conversation_b per ``conversation_ref``, one row each. ``conversation_key``
    is the fingerprint of what both say, equal where they are, whatever the reference.
    """
    key = fingerprint(row_json(conversations, exclude=(REFERENCE,)))
    return conversation_facts(conversations.withColumn("conversation_key", key)).drop("conversation_a", "conversation_b")


def with_texts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with their ``conversation_ref`` and the texts that :func:`referenced_conversations` found for it."""
    return rows.join(facts.select(REFERENCE, *TEXTS), REFERENCE, "left")


def constants(provenance: Provenance) -> dict[str, Column]:
    """What all canonical battles of one snapshot have in common."""
    return {
        "schema_version": F.lit(CANONICAL_SCHEMA_VERSION),
        **{name: F.lit(value).cast("string") for name, value in asdict(provenance).items()},
        "source_snapshot_id": F.lit(provenance.snapshot_id),
        "model_alias_map_version": F.lit("none"),
        "language_source": F.lit("source"),
    }


def calendar() -> dict[str, Column]:
    return {
        "battle_date_utc": F.to_date("timestamp_utc"),
        "battle_hour_utc": F.hour("timestamp_utc"),
        "battle_month_utc": F.date_format("timestamp_utc", "yyyy-MM"),
    }


def store_canonical(canonical: DataFrame, provenance: Provenance) -> DataFrame:
    """Store what :func:`canonicalize` made of a snapshot, without the columns that follow from one other column or are the
    same in all rows. Those are added where they are read, so that nobody pays for one that is not: the id alone, 64
    letters a row that no codec shortens, would be most of the table."""
    follow = {
        **constants(provenance),
        **calendar(),
        **{name: F.col(source) for name, source in AS_IT_CAME.items()},
        "battle_id": battle_id(F.lit(provenance.snapshot_id), F.col("source_row_index")),
    }
    return stored(canonical.drop(*follow)).withColumns(follow).select(*[F.col(f"`{c}`") for c in canonical.columns])


def canonicalize(
    raw: DataFrame, provenance: Provenance, *, check_index: bool = False, measured: bool = False,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Canonical battles from raw ones.

    Everything is one narrow pass except ``exact_duplicate``, which Spark leaves out of the plan when no later
    step reads it. Who stores the result reads it always: ``measured`` then counts the copies first, in a job
    of its own, so that few groups of copies can be broadcast and conversations stay where they were read.
    ``check_index`` spends one aggregate job on the row-index contract.

    Battles may refer to their conversations by ``conversation_ref`` instead of holding them. ``facts`` are then what
    :func:`referenced_conversations` found: each conversation is judged once, copies are told by its fingerprint, and
    the result has the reference in place of conversations and texts, which :func:`with_texts` adds.
    """
    if "source_row_index" not in raw.columns:
        raise ValueError("raw battles need a source_row_index column")
    if check_index:
        require_row_index(raw)
    if facts is not None:
        known = facts.drop(*TEXTS)
        raw = raw.join(broadcast_if_small(known, BROADCAST_FACTS), REFERENCE, "left")
        exclude = (*IDENTITY_COLUMNS, *(name for name in known.columns if name != "conversation_key"))
    else:
        exclude = IDENTITY_COLUMNS
    key = duplicate_key(raw, exclude)
    cheap = row_hash(raw, exclude=exclude)
    df = with_group_size(raw, key, "__copies", F.col("source_row_index"), at_least=2, measured=measured, cheap=cheap)
    df = with_optional_columns(df, () if facts is None else ("conversation_a", "conversation_b"))
    types = {f.name: f.dataType for f in df.schema}
    no_time, stamp = read_time(F.col("tstamp"), types["tstamp"])
    common = constants(provenance)
    came = {name: F.col(source) for name, source in AS_IT_CAME.items()}
    df = df.withColumns(
        {
            **{name: common.pop(name) for name in list(common) if name not in ("model_alias_map_version", "language_source")},
            "battle_id": battle_id(F.lit(provenance.snapshot_id), F.col("source_row_index")),
            "question_id_raw": came["question_id_raw"],
            "winner_raw": came["winner_raw"],
            "canonical_outcome": canonical_outcome(F.col("winner")),
            "model_a_raw": came["model_a_raw"],
            "model_b_raw": came["model_b_raw"],
            "model_a_id": trimmed(F.col("model_a")),
            "model_b_id": trimmed(F.col("model_b")),
            "model_alias_map_version": common["model_alias_map_version"],
            "tstamp_raw": came["tstamp_raw"],
            "__no_time": no_time,
            "timestamp_utc": stamp,
            "judge_cluster_id": came["judge_cluster_id"],
            "judge_present": present(F.col("judge")),
            "language_raw": came["language_raw"],
            "language_canonical": trimmed(F.col("language")),
            "language_source": common["language_source"],
            "anony_raw": came["anony_raw"],
            "__anony": anony_truth(F.col("anony"), types["anony"]),
        }
    )
    if facts is None:
        df = conversation_facts(df)
    models = F.col("model_a_id").isNotNull() & F.col("model_b_id").isNotNull()
    df = df.withColumns(
        {
            "outcome_valid": F.col("canonical_outcome") != UNKNOWN,
            "model_fields_valid": models,
            "distinct_models": models & (F.col("model_a_id") != F.col("model_b_id")),
            "timestamp_valid": F.col("timestamp_utc").isNotNull(),
            "timestamp_error": time_error(F.col("__no_time"), F.col("timestamp_utc")),
            **calendar(),
            "language_present": F.col("language_canonical").isNotNull(),
            "anony_valid": F.col("__anony").isNotNull(),
            "anonymous_battle": F.coalesce(F.col("__anony"), F.lit(False)),
        }
    )
    df = df.withColumns({"exact_duplicate": F.col("__copies").isNotNull(), "source_record_valid": _all(VALIDITY_FLAGS)})
    inner = [name for name in df.columns if name.startswith("__")]
    return df.drop(*inner) if facts is None else df.drop("conversation_key", *inner)


def clean_arena(raw: DataFrame, provenance: Provenance | None = None) -> DataFrame:
    """Canonical battles under the column names of the descriptive reports (no row is filtered)."""
    return legacy_columns(canonicalize(raw, provenance or Provenance("legacy_in_memory_dataframe")))


def legacy_columns(canonical: DataFrame) -> DataFrame:
    legacy = {
        "winner": "canonical_outcome",
        "model_a": "model_a_id",
        "model_b": "model_b_id",
        "language": "language_canonical",
        "tstamp": "timestamp_utc",
        "battle_date": "battle_date_utc",
        "battle_hour": "battle_hour_utc",
        "battle_month": "battle_month_utc",
        "prompt_len": "prompt_chars",
        "response_a_len": "response_a_chars",
        "response_b_len": "response_b_chars",
        "len_diff": "response_char_diff",
        "abs_len_diff": "response_abs_char_diff",
    }
    return canonical.withColumns({name: F.col(source) for name, source in legacy.items()})


def cleaning_report(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row; cleaning neither removes copies nor drops invalid rows, so those counts are zero."""
    before = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    return cleaned.agg(F.count(F.lit(1)).alias("cleaned_rows")).select(
        before.alias("source_rows"),
        F.col("cleaned_rows").alias("deduplicated_rows"),
        "cleaned_rows",
        F.lit(0).cast("bigint").alias("duplicate_rows_removed"),
        F.lit(0).cast("bigint").alias("invalid_rows_removed"),
        F.lit(len(cleaned.columns)).cast("bigint").alias("column_count"),
    )
