"""Canonicalization: values, codes, and one row out for every row in."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pairpref import skew
from pairpref.catalog import tables
from pairpref.fixtures import PROVENANCE, battles_raw
from pairpref.functions.conversation import parse_conversation, plain_json
from pairpref.functions.identity import canonical_json, label_seed
from pairpref.functions.outcomes import anony_truth, canonical_outcome
from pairpref.functions.text import WHITESPACE, present, stripped, trimmed
from pairpref.functions.timestamps import read_time, time_error
from pairpref.operators.canonical import (
    Provenance,
    canonicalize,
    clean_arena,
    referenced_conversations,
    require_row_index,
    store_canonical,
    with_texts,
)
from pairpref.session import broadcast_if_small, stored

TALK = [{"role": "user", "content": "Hi"}, {"role": "assistant", "content": "Hello"}]
RAW = (
    "source_row_index long, question_id string, model_a string, model_b string, winner string, judge string,"
    " conversation_a array<struct<role:string,content:string>>, conversation_b array<struct<role:string,content:string>>,"
    " tstamp string, anony string, language string"
)


def battle(index, **changes):
    row = dict(
        source_row_index=index, question_id=f"q{index}", model_a="alpha", model_b="beta", winner="model_a",
        judge="judge-1", conversation_a=TALK, conversation_b=TALK, tstamp="1700000000", anony="true", language="English",
    )
    return row | changes


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_trim_follows_unicode_whitespace(spark):
    values = [None, "", "  ", " x ", "\x1ca b\x85", "　", "x"]
    expected = [None if v is None else (v.strip() or None) for v in values]
    assert column(spark, values, trimmed) == expected
    assert all(c.isspace() for c in WHITESPACE)


def test_trim_of_text_with_visible_ends(spark):
    values = ["a", "!x~", " a", "a ", "a\u3000", "\u00e9 ", "\x7fa", "a\x7f", "\x1fa", "", " ", "a b", "\U0001f600", None]
    rows = spark.createDataFrame(list(enumerate(values)), "i long, v string")
    found = [r[0] for r in rows.orderBy("i").select(stripped(F.col("v"))).collect()]
    assert found == [v if v is None else v.strip(WHITESPACE) for v in values]
    kept = rows.orderBy("i").select(present(F.col("v"))).collect()
    assert [r[0] for r in kept] == [v is not None and v.strip(WHITESPACE) != "" for v in values]


def test_outcome_spellings(spark):
    values = ["model_a", " A ", "winner_a", "MODEL_B", "b", "winner_b", "tie", "Tie (bothbad)", "both", None, ""]
    expected = ["model_a_win"] * 3 + ["model_b_win"] * 3 + ["tie", "tie_bothbad"] + ["invalid_unknown"] * 3
    assert column(spark, values, canonical_outcome) == expected


def test_anony_is_strict(spark):
    text = spark.createDataFrame([("x",)], "v string").schema["v"].dataType
    values = ["true", " TRUE ", "1", "false", "0", "yes", "", None]
    assert column(spark, values, lambda v: anony_truth(v, text)) == [True, True, True, False, False, None, None, None]
    number = spark.createDataFrame([(1,)], "v int").schema["v"].dataType
    assert column(spark, [1, 0], lambda v: anony_truth(v, number), "int") == [None, None]


CASES = [
    (None, "missing"),
    ("   ", "empty"),
    ("nonsense", "parse_error"),
    ("[1] trailing", "parse_error"),
    ('[{"role": "user", "content": "a"}]]', "parse_error"),
    ('[{"role": "user", "content": "a"}]}', "parse_error"),
    ('[{"role": "user", "content": "a"}],"e":1', "parse_error"),
    ('{"role": "user"}', "not_list"),
    ("null", "not_list"),
    ("3", "not_list"),
    ("('a', 'b')", "not_list"),
    ("[]", "ok"),
    ('["text"]', "invalid_turn"),
    ("[null]", "invalid_turn"),
    ('[{"content": "x"}]', "missing_role"),
    ('[{"role": null, "content": "x"}]', "invalid_role"),
    ('[{"role": 3, "content": "x"}]', "invalid_role"),
    ('[{"role": "robot", "content": "x"}]', "invalid_role"),
    ('[{"role": "user"}]', "missing_content"),
    ('[{"role": "user", "content": null}]', "missing_content"),
    ('[{"role": "user", "content": NaN}]', "missing_content"),
    ('[{"role": "user", "content": "x"}, {"role": "robot"}, 3]', "invalid_role"),
    ('[{"role": " User ", "content": "x"}, {"role": "assistant", "content": ""}]', "ok"),
    ("[{'role': 'user', 'content': \"it's\"}]", "ok"),
    ('[{"role": "user", "content": true}, {"role": "assistant", "content": 1.0}]', "ok"),
    ('[{"role": "user", "role": "assistant", "content": "last role counts"}]', "ok"),
]


def test_conversation_text_codes(spark):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "i int, c string")
    found = parse_conversation(rows, "c", "p").orderBy("i").collect()
    assert [(text, r["p_error"]) for (text, _), r in zip(CASES, found)] == CASES
    for (text, error), row in zip(CASES, found):
        turns = None if row["p_turns"] is None else [tuple(t) for t in row["p_turns"]]
        read = json.loads(plain_json(text.strip())) if error == "ok" else []
        assert turns == ([(t["role"].strip().lower(), t["content"]) for t in read] if error == "ok" else None)


def test_non_text_members_print_as_in_python(spark):
    rows = spark.createDataFrame([('[{"role": "user", "content": true}, {"role": "user", "content": 1.0}]',)], "c string")
    turns = parse_conversation(rows, "c", "p").first()["p_turns"]
    assert [t["content"] for t in turns] == ["True", "1.0"]


def test_typed_conversations(spark):
    turns = [
        None, [], [None], [{"role": None, "content": "x"}], [{"role": "user", "content": None}],
        [{"role": " ASSISTANT", "content": "y"}],
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], "i int, c array<struct<role:string,content:string>>")
    found = [r["p_error"] for r in parse_conversation(rows, "c", "p").orderBy("i").collect()]
    assert found == ["missing", "ok", "invalid_turn", "invalid_role", "missing_content", "ok"]
    numbers = parse_conversation(spark.createDataFrame([([1],), ([],)], "c array<int>"), "c", "p")
    assert sorted(r["p_error"] for r in numbers.collect()) == ["invalid_turn", "ok"]


def test_maps_variants_and_incomplete_structs(spark):
    good = [{"role": "User ", "content": "x"}, {"role": "assistant", "content": "it's"}]
    turns = [
        (None, "missing"), ([], "ok"), ([None], "invalid_turn"), ([{"content": "x"}], "missing_role"),
        ([{"role": None, "content": "x"}], "invalid_role"), ([{"role": "user"}], "missing_content"),
        ([{"role": "user", "content": None}], "missing_content"), ([*good, {"role": "?"}], "invalid_role"), (good, "ok"),
    ]
    maps = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(turns)], "i int, c array<map<string,string>>")
    variants = maps.selectExpr("i", "to_variant_object(c) c")
    for rows in (maps, variants):
        found = parse_conversation(rows, "c", "p").orderBy("i").collect()
        assert [r["p_error"] for r in found] == [error for _, error in turns]
        assert [tuple(t) for t in found[-1]["p_turns"]] == [("user", "x"), ("assistant", "it's")]
    odd = spark.sql("""select i, parse_json(t) c from values (1, '{"role": "user"}'), (2, 'null'),
      (3, '[{"role": "user", "content": 1}]'), (4, '[{"role": 7, "content": "x"}]'), (5, '[1]') as v(i, t)""")
    found = parse_conversation(odd, "c", "p").orderBy("i").collect()
    assert [r["p_error"] for r in found] == ["not_list", "not_list", "ok", "invalid_role", "invalid_turn"]
    assert found[2]["p_turns"][0]["content"] == "1"
    rows = spark.createDataFrame([(1, [("user",)]), (2, [None]), (3, [("?",)])], "i int, c array<struct<role:string>>")
    found = [r["p_error"] for r in parse_conversation(rows, "c", "p").orderBy("i").collect()]
    assert found == ["missing_content", "invalid_turn", "invalid_role"]
    rows = spark.createDataFrame([(1, [{1: "user"}]), (2, [None]), (3, [])], "i int, c array<map<int,string>>")
    found = [r["p_error"] for r in parse_conversation(rows, "c", "p").orderBy("i").collect()]
    assert found == ["missing_role", "invalid_turn", "ok"]


TIMES = [
    ("1700000000", "2023-11-14 22:13:20", "ok"),
    (" 1700000000.5 ", "2023-11-14 22:13:20", "ok"),
    ("-1", "1969-12-31 23:59:59", "ok"),
    ("1e9", "2001-09-09 01:46:40", "ok"),
    ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "ok"),
    ("2024-01-02 03:04:05+02:00", "2024-01-02 01:04:05", "ok"),
    ("2024-01-02 03:04:05+0200", "2024-01-02 01:04:05", "ok"),
    ("2024-01-02", "2024-01-02 00:00:00", "ok"),
    ("2024/01/02 03:04", "2024-01-02 03:04:00", "ok"),
    ("2024-03", "2024-03-01 00:00:00", "ok"),
    ("", None, "missing"),
    ("nan", None, "missing"),
    (None, None, "missing"),
    ("soon", None, "invalid"),
    ("inf", None, "invalid"),
    ("1d", None, "invalid"),
    ("1e30", None, "invalid"),
    ("2024-13-01", None, "invalid"),
    ("10:00", None, "invalid"),
]


def test_timestamps(spark):
    rows = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TIMES)], "i int, v string")
    absent, stamp = read_time(F.col("v"), rows.schema["v"].dataType)
    found = rows.orderBy("i").select(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), time_error(absent, stamp)).collect()
    assert [(t[0], r[0], r[1]) for t, r in zip(TIMES, found)] == TIMES


def test_typed_times(spark):
    for kind, values, expected in (
        ("double", [0.0, float("nan"), None, 1e30], ["ok", "missing", "missing", "invalid"]),
        ("boolean", [True, None], ["invalid", "missing"]),
        ("timestamp", [dt.datetime(2024, 1, 1)], ["invalid"]),
    ):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        absent, stamp = read_time(F.col("v"), rows.schema["v"].dataType)
        assert [r[0] for r in rows.orderBy("i").select(time_error(absent, stamp)).collect()] == expected


def test_canonical_record(spark):
    row = canonicalize(frame(spark, battle(7)), PROVENANCE).first()
    assert row["source_record_valid"] and row["canonical_outcome"] == "model_a_win" and row["schema_version"] == 2
    assert (row["prompt_text"], row["response_a_text"], row["prompt_chars"]) == ("Hi", "Hello", 2)
    assert str(row["battle_date_utc"]) == "2023-11-14" and row["battle_hour_utc"] == 22 and row["battle_month_utc"] == "2023-11"
    assert row["source_snapshot_id"] == PROVENANCE.snapshot_id and len(row["battle_id"]) == 64


def test_absent_columns_read_as_missing(spark):
    rows = spark.createDataFrame([(1,), (2,)], "source_row_index long")
    found = canonicalize(rows, Provenance("bare")).orderBy("source_row_index").collect()
    assert len(found) == 2 and not any(r["source_record_valid"] for r in found)
    assert found[0]["conversation_a_error"] == "missing" and found[0]["timestamp_error"] == "missing"
    assert all(r["exact_duplicate"] for r in found)


def test_exact_duplicates_ignore_identity_and_keep_all_copies(spark):
    rows = frame(spark, battle(1, question_id="q"), battle(2, question_id="q"), battle(3, question_id="q", winner="tie"))
    found = canonicalize(rows, PROVENANCE).orderBy("source_row_index").collect()
    assert [r["exact_duplicate"] for r in found] == [True, True, False]


@pytest.mark.parametrize("measured", [False, True])
def test_conversations_by_reference_say_the_same(spark, measured):
    other = [{"role": "user", "content": "Hi"}, {"role": "assistant", "content": "No"}, {"role": "robot", "content": "?"}]
    talks = {"x": (TALK, TALK), "y": (TALK, TALK), "z": (None, TALK), "w": (TALK, other), None: (None, None)}
    rows = [("x", {}), ("y", {}), ("z", {}), ("z", {}), ("w", {}), (None, {}), ("x", {"winner": "tie"}), ("w", {"judge": None})]
    held = [
        battle(i, question_id="q", conversation_a=talks[ref][0], conversation_b=talks[ref][1], **changes)
        for i, (ref, changes) in enumerate(rows)
    ]
    whole = frame(spark, *held)
    refs = spark.createDataFrame([(i, ref) for i, (ref, _) in enumerate(rows)], "source_row_index long, conversation_ref string")
    told = spark.createDataFrame(
        [(ref, *talk) for ref, talk in talks.items() if ref],
        "conversation_ref string, " + ", ".join(f"conversation_{s} array<struct<role:string,content:string>>" for s in "ab"),
    )
    battles = whole.drop("conversation_a", "conversation_b").join(refs, "source_row_index").where("conversation_ref is not null")
    facts = stored(referenced_conversations(told))
    found = with_texts(canonicalize(battles, PROVENANCE, facts=facts, measured=measured), facts).drop("conversation_ref")
    wanted = canonicalize(whole.where("source_row_index <> 5"), PROVENANCE).select(*found.columns)
    assert set(whole.columns) - set(found.columns) == {"conversation_a", "conversation_b"}
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    assert [r[0] for r in found.orderBy("source_row_index").select("exact_duplicate").collect()] == [True] * 4 + [False] * 3


def test_stored_battles_hold_no_texts(spark, sf):
    """What is stored per battle does not grow with the length of conversations."""
    for table in (tables.battles_table(spark, sf), tables.canonical_rows(spark, sf)):
        names = {"conversation_a", "conversation_b", "prompt_text", "response_a_text", "response_b_text"}
        assert "conversation_ref" in table.columns and not names & set(table.columns)
    pairs = tables.conversations_table(spark, sf)
    assert pairs.count() == tables.battles_table(spark, sf).select("conversation_ref").distinct().count()
    assert tables.raw_table(spark, sf).exceptAll(battles_raw(spark, sf)).isEmpty()


def test_stored_canonical_battles_leave_out_what_follows_from_one_column(spark):
    """Identifiers, constants, second names and calendar parts are the same when read, and take no room."""
    rows = canonicalize(frame(spark, battle(1), battle(1), battle(2, model_a=" ", tstamp=None), battle(None, judge=None)), PROVENANCE)
    found = store_canonical(rows, PROVENANCE)
    assert found.columns == rows.columns
    assert [f.dataType for f in found.schema] == [f.dataType for f in rows.schema]
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.collect()))
    held = set(spark.read.parquet(*found.inputFiles()).columns)
    assert not held & {"battle_id", "source_snapshot_id", "source_dataset", "model_a_raw", "judge_cluster_id", "battle_month_utc"}
    assert {"canonical_outcome", "exact_duplicate", "source_record_valid", "timestamp_utc"} <= held


@pytest.mark.parametrize("cheap, joins", [("xxhash64(k)", 1), ("7L", 2)])
def test_hash_tells_copies_unless_fingerprints_share_it(spark, cheap, joins):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate("aabcccd")], "i long, k string")
    sized = skew.with_group_size(rows, F.sha2("k", 256), "n", F.col("i"), at_least=2, measured=True, cheap=F.expr(cheap))
    assert [tuple(r) for r in sized.orderBy("i").collect()] == list(zip(range(7), "aabcccd", [2, 2, None, 3, 3, 3, None]))
    assert sized._jdf.queryExecution().optimizedPlan().toString().count("Join ") == joins


def test_missing_and_not_a_number_are_the_same_copy(spark):
    rows = spark.createDataFrame(
        [(1, float("nan"), 0.0), (2, None, 0.0), (3, None, -0.0)], "source_row_index long, toxicity double, x double"
    )
    found = canonicalize(rows, PROVENANCE).orderBy("source_row_index").collect()
    assert [r["exact_duplicate"] for r in found] == [True, True, False]


def test_row_index_contract(spark):
    for rows in ([battle(1), battle(1)], [battle(-1)]):
        with pytest.raises(ValueError):
            require_row_index(frame(spark, *rows))
    require_row_index(frame(spark, battle(0), battle(5)))


def test_cleaning_keeps_every_row(spark, sf):
    raw = battles_raw(spark, sf)
    cleaned = clean_arena(raw, PROVENANCE)
    assert cleaned.count() == raw.count() == 2663
    assert {"prompt_len", "len_diff", "battle_date", "winner"} <= set(cleaned.columns)


@pytest.mark.parametrize(("measured", "limit"), [(False, None), (True, None), (True, 10)])
def test_group_sizes_with_one_dominant_key(spark, monkeypatch, measured, limit):
    if limit is not None:  # more groups than may be broadcast
        monkeypatch.setattr(skew, "broadcast_if_small", lambda df: broadcast_if_small(df, limit))
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 9000))
    rows = spark.range(30_000).select("id", key.alias("k"))
    sized = skew.with_group_size(rows, F.sha2("k", 256), "n", F.col("id"), at_least=2, measured=measured)
    counts = rows.groupBy("k").agg(F.count("*").alias("want"))
    wanted = F.when(F.col("want") >= 2, F.col("want"))
    wrong = sized.join(counts, "k").where(~F.col("n").eqNullSafe(wanted))
    assert sized.count() == 30_000 and wrong.isEmpty() and sized.where("k is null and n is not null").isEmpty()


def test_identities():
    assert canonical_json({"b": [1, None], "a": "ü"}) == '{"a":"ü","b":[1,null]}' == json.dumps(
        {"a": "ü", "b": [1, None]}, ensure_ascii=False, separators=(",", ":")
    )
    with pytest.raises(TypeError):
        canonical_json({"x": float("nan")})
    assert 0 <= label_seed("study|A|v1") < 2**64 and label_seed("a") != label_seed("b")
