"""Scans and canonicalization."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from pairpref.catalog import query
from pairpref.catalog.tables import CANONICAL, CLEANED, RAW, battles_table, canonical, conversations_table, facts_table, once
from pairpref.fixtures import PROVENANCE, battles_raw, table
from pairpref.functions.conversation import parse_conversation, texts_of
from pairpref.functions.identity import canonical_json, row_json
from pairpref.functions.outcomes import canonical_outcome
from pairpref.functions.text import trimmed
from pairpref.functions.timestamps import read_time, time_error
from pairpref.operators.canonical import (
    REFERENCE,
    VALIDITY_FLAGS,
    canonicalize,
    clean_arena,
    cleaning_report,
    referenced_conversations,
    row_index_report,
    with_texts,
)
from pairpref.sources.files import read_parquet

SNAPSHOT = canonical_json(asdict(PROVENANCE))


@query(
    "s02_parquet_scan",
    "select o_orderkey, o_custkey, o_orderpriority, round(o_totalprice, 2) o_totalprice from orders",
)
def parquet_scan(spark, sf):
    orders = read_parquet(spark, f"{sf}/orders.parquet")
    return orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("fixture_battles", RAW + """
select source_row_index, question_id, model_a, model_b, winner, tstamp, judge, "language", anony,
  coalesce(len(conversation_a), -1)::bigint turns_a, coalesce(len(conversation_b), -1)::bigint turns_b from battles""")
def fixture_battles(spark, sf):
    turns = lambda c: F.coalesce(F.size(F.when(F.col(c).isNotNull(), F.col(c))), F.lit(-1)).cast("bigint")
    return battles_raw(spark, sf).select(
        "source_row_index", "question_id", "model_a", "model_b", "winner", "tstamp", "judge", "language", "anony",
        F.when(F.col("conversation_a").isNull(), -1).otherwise(turns("conversation_a")).cast("bigint").alias("turns_a"),
        F.when(F.col("conversation_b").isNull(), -1).otherwise(turns("conversation_b")).cast("bigint").alias("turns_b"),
    )


@query("c01_trimmed_string", RAW + """
select source_row_index, nullif(trim(model_a), '') model_a, nullif(trim("language"), '') "language" from battles""")
def trimmed_string(spark, sf):
    raw = battles_raw(spark, sf)
    return raw.select("source_row_index", trimmed(F.col("model_a")).alias("model_a"), trimmed(F.col("language")).alias("language"))


@query("c02_snapshot_id", f"select sha256('{SNAPSHOT}') snapshot_id, count(*) \"rows\" from lineitem")
def snapshot_id(spark, sf):
    rows = table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("rows"))
    return rows.select(F.lit(PROVENANCE.snapshot_id).alias("snapshot_id"), "rows")


@query("c03_battle_id", RAW + f"""
select source_row_index, sha256(sha256('{SNAPSHOT}') || chr(31) || source_row_index) battle_id from battles""")
def battle_ids(spark, sf):
    return canonical(spark, sf).select("source_row_index", "battle_id")


@query("c04_row_index_check", RAW + """
select count(*) "rows", count(distinct source_row_index) distinct_indices,
  count(*) filter (source_row_index < 0) unusable_indices,
  count(*) = count(distinct source_row_index) and min(source_row_index) >= 0 valid from battles""")
def row_index_check(spark, sf):
    return row_index_report(battles_raw(spark, sf))


@query("c05_outcome", CANONICAL + "select source_row_index, canonical_outcome, outcome_valid from canon")
def outcome(spark, sf):
    return canonical(spark, sf).select("source_row_index", "canonical_outcome", "outcome_valid")


@query("c06_anony", CANONICAL + "select source_row_index, anony anony_raw, anony_valid, anonymous_battle from canon")
def anony(spark, sf):
    return canonical(spark, sf).select("source_row_index", "anony_raw", "anony_valid", "anonymous_battle")


@query("c07_conversation_codes", CANONICAL + """
select source_row_index, conversation_a_valid, conversation_b_valid,
  case when conversation_a is null then 'missing' else 'ok' end conversation_a_error,
  case when conversation_b is null then 'missing' else 'ok' end conversation_b_error from canon""")
def conversation_codes(spark, sf):
    return canonical(spark, sf).select(
        "source_row_index", "conversation_a_valid", "conversation_b_valid", "conversation_a_error", "conversation_b_error"
    )


# The same conversations as text, each made faulty in one of ten ways by its id.
_TEXT_CASES = """
with t as (select conv_id, list({'role': role, 'content': text} order by turn) turns from conversations group by 1)
select conv_id, case conv_id % 10 when 1 then 'missing' when 2 then 'empty' when 3 then 'parse_error'
  when 4 then 'not_list' when 5 then 'invalid_turn' when 6 then 'missing_role' when 7 then 'invalid_role'
  when 8 then 'missing_content' else 'ok' end error,
  case when conv_id % 10 in (0, 9) then len(turns) else 0 end::bigint turns from t"""


@query("c07_conversation_text", _TEXT_CASES)
def conversation_text(spark, sf):
    turns = table(spark, sf, "conversations")
    grouped = turns.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")),
        ).alias("turns")
    )
    fault = F.col("conv_id") % 10
    json_text = F.to_json("turns")
    prefixed = lambda bad: F.concat(F.lit(bad), F.substring(json_text, F.lit(2), F.length(json_text)))
    text = (
        F.when(fault == 1, F.lit(None).cast("string"))
        .when(fault == 2, "  ")
        .when(fault == 3, F.concat(json_text, F.lit("]")))
        .when(fault == 4, F.lit("{}"))
        .when(fault == 5, prefixed("[7,"))
        .when(fault == 6, prefixed('[{"content":"x"},'))
        .when(fault == 7, prefixed('[{"role":null,"content":"x"},'))
        .when(fault == 8, prefixed('[{"role":"user","content":null},'))
        # The literal form: single-quoted keys and values, which JSON does not accept.
        .when(fault == 9, F.concat(F.lit("["), F.array_join(F.transform("turns", lambda t: F.concat(
            F.lit("{'role': '"), t["role"], F.lit("', 'content': 'it\\'s'}"))), ", "), F.lit("]")))
        .otherwise(json_text)
    )
    parsed = parse_conversation(grouped.select("conv_id", text.alias("conversation")), "conversation", "c")
    return parsed.select(
        "conv_id",
        F.col("c_error").alias("error"),
        F.when(F.col("c_turns").isNull(), 0).otherwise(F.size("c_turns")).cast("bigint").alias("turns"),
    )


@query("c08_turn_texts", CANONICAL + "select source_row_index, prompt_text, response_a_text, response_b_text from canon")
def turn_texts(spark, sf):
    battles = with_texts(canonical(spark, sf), facts_table(spark, sf))
    return battles.select("source_row_index", "prompt_text", "response_a_text", "response_b_text")


@query("c09_has_turns", CANONICAL + """
select source_row_index, conversation_a_has_user, conversation_b_has_user, conversation_a_has_assistant,
  conversation_b_has_assistant from canon""")
def has_turns(spark, sf):
    return canonical(spark, sf).select(
        "source_row_index", "conversation_a_has_user", "conversation_b_has_user",
        "conversation_a_has_assistant", "conversation_b_has_assistant",
    )


@query("c10_prompt_pair", CANONICAL + "select source_row_index, prompt_pair_consistent from canon")
def prompt_pair(spark, sf):
    return canonical(spark, sf).select("source_row_index", "prompt_pair_consistent")


@query("c11_timestamp", CANONICAL + """
select source_row_index, strftime(timestamp_utc, '%Y-%m-%d %H:%M:%S') timestamp_utc, timestamp_valid,
  case when timestamp_valid then 'ok' else 'invalid' end timestamp_error from canon""")
def timestamp(spark, sf):
    return canonical(spark, sf).select(
        "source_row_index",
        F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("timestamp_utc"),
        "timestamp_valid",
        "timestamp_error",
    )


@query("c11_timestamp_iso", """
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') utc, 'ok' error from events""")
def timestamp_iso(spark, sf):
    """Event times written as ISO text, a third each without zone, with Z and with an offset."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    east = F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, iso).when(F.col("event_id") % 3 == 1, F.concat(iso, F.lit("Z")))
    events = events.withColumn("text", text.otherwise(F.concat(east, F.lit("+02:00"))))
    absent, stamp = read_time(F.col("text"), events.schema["text"].dataType)
    return events.select(
        "event_id", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("utc"), time_error(absent, stamp).alias("error")
    )


@query("c12_calendar", CANONICAL + """
select source_row_index, strftime(timestamp_utc, '%Y-%m-%d') battle_date, hour(timestamp_utc)::bigint battle_hour,
  strftime(timestamp_utc, '%Y-%m') battle_month from canon""")
def calendar(spark, sf):
    return canonical(spark, sf).select(
        "source_row_index",
        F.col("battle_date_utc").cast("string").alias("battle_date"),
        F.col("battle_hour_utc").cast("bigint").alias("battle_hour"),
        F.col("battle_month_utc").alias("battle_month"),
    )


@query("c13_models", CANONICAL + """
select source_row_index, model_a_id, model_b_id, model_fields_valid, distinct_models from canon""")
def models(spark, sf):
    return canonical(spark, sf).select("source_row_index", "model_a_id", "model_b_id", "model_fields_valid", "distinct_models")


@query("c14_judge_language", CANONICAL + """
select source_row_index, judge_present, language_canonical, language_present from canon""")
def judge_language(spark, sf):
    return canonical(spark, sf).select("source_row_index", "judge_present", "language_canonical", "language_present")


@query("c15_lengths", CANONICAL + """
select source_row_index, prompt_chars, response_a_chars, response_b_chars,
  response_a_chars - response_b_chars response_char_diff,
  abs(response_a_chars - response_b_chars) response_abs_char_diff from canon""")
def lengths(spark, sf):
    names = ("prompt_chars", "response_a_chars", "response_b_chars", "response_char_diff", "response_abs_char_diff")
    return canonical(spark, sf).select("source_row_index", *[F.col(n).cast("bigint").alias(n) for n in names])


@query("c16_exact_duplicate", CANONICAL + "select source_row_index, exact_duplicate from canon")
def exact_duplicate(spark, sf):
    return canonical(spark, sf, measured=True).select("source_row_index", "exact_duplicate")


@query("c17_record_valid", CANONICAL + "select source_row_index, source_record_valid from canon")
def record_valid(spark, sf):
    return canonical(spark, sf).select("source_row_index", "source_record_valid")


_CANONICAL = CANONICAL + f"""
select source_row_index, sha256(sha256('{SNAPSHOT}') || chr(31) || source_row_index) battle_id, 2 schema_version,
  question_id_raw, winner_raw, canonical_outcome, model_a_id, model_b_id, judge_cluster_id, language_canonical,
  prompt_text, md5(response_a_text) response_a_md5, md5(response_b_text) response_b_md5, anony anony_raw,
  anony_valid, anonymous_battle, judge_present, language_present, exact_duplicate, {", ".join(VALIDITY_FLAGS)},
  source_record_valid from canon"""


def _canonical_columns(battles, facts):
    """The texts of answers are digested where they are stored, once for all battles that have them."""
    md5 = [F.md5(f"response_{side}_text").alias(f"response_{side}_md5") for side in "ab"]
    return battles.join(facts.select(REFERENCE, "prompt_text", *md5), REFERENCE, "left").select(
        "source_row_index", "battle_id", "schema_version", "question_id_raw", "winner_raw", "canonical_outcome",
        "model_a_id", "model_b_id", "judge_cluster_id", "language_canonical", "prompt_text",
        "response_a_md5", "response_b_md5",
        "anony_raw", "anony_valid", "anonymous_battle", "judge_present", "language_present", "exact_duplicate",
        *VALIDITY_FLAGS, "source_record_valid",
    )


@query("c18_canonical", _CANONICAL)
def canonical_battles(spark, sf):
    return _canonical_columns(canonical(spark, sf, measured=True), facts_table(spark, sf))


@query("c18_text", _CANONICAL)
def canonical_battles_from_text(spark, sf):
    """The same battles from a snapshot whose conversations are JSON text, as in CSV files."""
    as_text = {side: F.to_json(side) for side in ("conversation_a", "conversation_b")}
    snapshot = once(spark, sf, "raw_text", lambda: conversations_table(spark, sf).withColumns(as_text))
    facts = once(spark, sf, "facts_of_text", lambda: referenced_conversations(snapshot))
    return _canonical_columns(canonicalize(battles_table(spark, sf), PROVENANCE, measured=True, facts=facts), facts)


@query("c19_cleaned", CLEANED + """
select source_row_index, winner, model_a, model_b, "language", strftime(tstamp, '%Y-%m-%d %H:%M:%S') tstamp,
  battle_month, prompt_len, len_diff, abs_len_diff from cleaned""")
def cleaned_battles(spark, sf):
    return clean_arena(battles_raw(spark, sf), PROVENANCE).select(
        "source_row_index", "winner", "model_a", "model_b", "language",
        F.date_format("tstamp", "yyyy-MM-dd HH:mm:ss").alias("tstamp"), "battle_month",
        *[F.col(n).cast("bigint").alias(n) for n in ("prompt_len", "len_diff", "abs_len_diff")],
    )


@query("c19_cleaning_report", RAW + """
select count(*) source_rows, count(*) deduplicated_rows, count(*) cleaned_rows, 0::bigint duplicate_rows_removed,
  0::bigint invalid_rows_removed from battles""")
def cleaning(spark, sf):
    raw = battles_raw(spark, sf)
    return cleaning_report(raw, clean_arena(raw, PROVENANCE)).drop("column_count")


@query("c20_legacy_helpers", RAW + """
select source_row_index,
  coalesce(list_filter(conversation_a, lambda t: t.role = 'user')[1].content, '') first_prompt,
  array_to_string(coalesce(list_transform(list_filter(conversation_b, lambda t: t.role = 'assistant'),
    lambda t: t.content), []), ' ') assistant_text,
  case lower(trim(winner)) when 'model_a' then 'model_a_win' when 'model_b' then 'model_b_win' when 'tie' then 'tie'
    when 'tie (bothbad)' then 'tie_bothbad' else 'invalid_unknown' end winner from battles""")
def legacy_helpers(spark, sf):
    df = battles_raw(spark, sf)
    for side in "ab":
        df = parse_conversation(df, f"conversation_{side}", side)
    return df.select(
        "source_row_index",
        F.coalesce(F.try_element_at(texts_of(F.col("a_turns"), "user"), F.lit(1)), F.lit("")).alias("first_prompt"),
        F.array_join(texts_of(F.col("b_turns"), "assistant"), " ").alias("assistant_text"),
        canonical_outcome(F.col("winner")).alias("winner"),
    )


@query("c21_canonical_json", """
select n_nationkey::bigint n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey
  || ',"n_regionkey":' || n_regionkey || '}' "json" from nation""")
def canonical_json_rows(spark, sf):
    nation = table(spark, sf, "nation")
    return nation.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), row_json(nation).alias("json"))
