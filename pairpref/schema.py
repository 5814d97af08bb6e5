"""Fixed values of the data model: versions, closed sets, codes and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: versions -------------------------------------------------------------------
CANONICAL_SCHEMA_VERSION = 2
POPULATION_SPEC_VERSION = 2
POPULATION_VIEW_VERSION = 1
ESTIMATOR_VERSION = 1
MANIFEST_VERSION = 1
DERIVATION_VERSION = 1
METRIC_VERSION = 1
ARTIFACT_VERSION = 1

# --- fixed values: outcomes -------------------------------------------------------------------
A_WIN = "model_a_win"
B_WIN = "model_b_win"
TIE = "tie"
BOTH_BAD = "tie_bothbad"
UNKNOWN = "invalid_unknown"
VALID_OUTCOMES = (A_WIN, B_WIN, TIE, BOTH_BAD)
OUTCOMES = VALID_OUTCOMES + (UNKNOWN,)
OUTCOME_SPELLINGS = {
    "model_a": A_WIN,
    "a": A_WIN,
    "winner_a": A_WIN,
    "model_b": B_WIN,
    "b": B_WIN,
    "winner_b": B_WIN,
    "tie": TIE,
    "tie (bothbad)": BOTH_BAD,
}

# --- fixed values: conversation roles ---------------------------------------------------------
ROLES = ("user", "assistant", "system", "tool", "function")

# --- fixed values: tolerances and thresholds --------------------------------------------------
RANK_TOLERANCE = 1e-10
TOP_K = (1, 3, 5)
FORMAL_REPLICATES = 2_000
CONFIDENCE = 0.95

# --- raw battle columns; every one is optional on input ---------------------------------------
RAW_COLUMNS = (
    "question_id",
    "model_a",
    "model_b",
    "winner",
    "judge",
    "conversation_a",
    "conversation_b",
    "tstamp",
    "anony",
    "language",
)
PROVENANCE_COLUMNS = (
    "source_dataset",
    "source_revision",
    "source_split",
    "source_file",
    "source_file_sha256",
)
# Columns that name a record rather than describe it; they never decide whether two rows are copies.
IDENTITY_COLUMNS = ("source_row_index", "battle_id", "record_id", "source_snapshot_id", "schema_version")

TURNS = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)

# --- relational tables of the legacy store ----------------------------------------------------
ARENA_BATTLE = T.StructType(
    [
        T.StructField("record_id", T.LongType(), False),
        T.StructField("question_id", T.StringType()),
        T.StructField("model_a", T.StringType()),
        T.StructField("model_b", T.StringType()),
        T.StructField("winner", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("tstamp", T.TimestampType()),
        T.StructField("battle_date", T.DateType()),
        T.StructField("battle_hour", T.IntegerType()),
        T.StructField("battle_month", T.StringType()),
        T.StructField("prompt_text", T.StringType()),
        T.StructField("response_a_text", T.StringType()),
        T.StructField("response_b_text", T.StringType()),
        T.StructField("prompt_len", T.IntegerType()),
        T.StructField("response_a_len", T.IntegerType()),
        T.StructField("response_b_len", T.IntegerType()),
        T.StructField("len_diff", T.IntegerType()),
        T.StructField("abs_len_diff", T.IntegerType()),
        T.StructField("topic_name", T.StringType()),
        T.StructField("topic_cluster", T.IntegerType()),
    ]
)
MODEL_STATISTICS = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("battle_count", T.LongType()),
        T.StructField("win_count", T.LongType()),
        T.StructField("lose_count", T.LongType()),
        T.StructField("tie_count", T.LongType()),
        T.StructField("win_rate", T.DoubleType()),
        T.StructField("tie_rate", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("score_rate", T.DoubleType()),
    ]
)
TOPIC_STATISTICS = T.StructType(
    [
        T.StructField("topic_name", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("proportion", T.DoubleType()),
    ]
)
