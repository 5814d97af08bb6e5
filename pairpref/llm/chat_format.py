r"""Chat formatting with a grammar round trip.

    conversation = { turn }
    turn         = "### " role ": " body "</turn>" newline

A body is free text in which control strings stand escaped: a header or an end mark preceded by k + 1
backslashes reads back as the same string preceded by k. The end mark of a turn is the first one that a newline and
then a header or the end of the conversation follow; backslashes before it belong to the body as they are, so a text
may end in any number of them. No escaped body holds such a mark, since headers in it stand behind a backslash. Each
conversation is rendered as it is, reparsed by the deterministic parser and compared with its source; turns that do
not come back identical are escaped, until all do.

Null text and null role read as empty. Turns come in order of ``turn`` (nulls first), then role, then text, so
equal turn numbers and repeated rows have one order. A conversation without rows does not exist; an empty table
gives no rows; a null conv_id is a conversation of its own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairpref.llm.catalog import query, table

END = "</turn>"
CONTROL = r"### (?:[A-Z][a-z_]*|=[A-Za-z0-9_.~%-]*): |</turn>"
FREE, GUARDED = re.compile(rf"(\\*)({CONTROL})"), re.compile(rf"\\(\\*(?:{CONTROL}))")
HEADER = re.compile(r"### (?:([A-Z][a-z_]*)|=([A-Za-z0-9_.~%-]*)): ")
STOP = re.compile(CONTROL)
PLAIN_ROLE = re.compile(r"[a-z][a-z_]*")
LEARNT = "assistant"
RESULT = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "escaped_turns long, formatted string, loss_spans array<array<int>>"
)
Turn = tuple[str, str]


def header(role: str) -> str:
    return f"### {role.capitalize()}: " if PLAIN_ROLE.fullmatch(role) else f"### ={quote(role, safe='')}: "


def escape(text: str) -> str:
    return FREE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return GUARDED.sub(r"\1", text)


def render(turns: list[Turn], escaped: list[bool]) -> str:
    return "".join(f"{header(r)}{escape(t) if e else t}{END}\n" for (r, t), e in zip(turns, escaped))


def ends_turn(text: str, mark: re.Match) -> bool:
    after = mark.end() + 1
    return mark[0] == END and text[mark.end() : after] == "\n" and (after == len(text) or HEADER.match(text, after) is not None)


def parse(text: str) -> list[tuple[str, int, int]] | None:
    """(role, begin, end) of each body, or None where the text does not follow the grammar."""
    found, at = [], 0
    while at < len(text):
        head = HEADER.match(text, at)
        if head is None:
            return None
        stop = next((m for m in STOP.finditer(text, head.end()) if text[m.start() - 1] != "\\" or ends_turn(text, m)), None)
        if stop is None or not ends_turn(text, stop):
            return None
        role = head[1].lower() if head[1] is not None else unquote(head[2])
        found.append((role, head.end(), stop.start()))
        at = stop.end() + 1
    return found


def recovered(text: str) -> list[Turn] | None:
    bodies = parse(text)
    return None if bodies is None else [(role, unescape(text[a:b])) for role, a, b in bodies]


def format_turns(turns: list[Turn]) -> tuple[str, int]:
    """(rendered text that reparses to ``turns``, how many turns had to be escaped)."""
    escaped = [False] * len(turns)
    while True:
        text = render(turns, escaped)
        if recovered(text) == turns:
            return text, sum(escaped)
        conflict = [not e and recovered(render([t], [False])) != [t] for t, e in zip(turns, escaped)]
        if not any(conflict):
            raise ValueError("a conversation does not come back from its rendering")
        escaped = [e or c for e, c in zip(escaped, conflict)]


def _digest(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["turn", "role", "text"], na_position="first", kind="stable")
    turns = list(zip(group["role"].fillna(""), group["text"].fillna("")))
    text, escaped = format_turns(turns)
    bodies = parse(text)
    back = [(role, unescape(text[a:b])) for role, a, b in bodies]
    learnt = "".join(body for role, body in back if role == LEARNT)
    whole = "".join(f"{role}\n{body}\n" for role, body in back)
    return pd.DataFrame({
        "conv_id": [group["conv_id"].iloc[0]],
        "n_turns": [len(back)],
        "turns_sha256": [hashlib.sha256(whole.encode()).hexdigest()],
        "loss_chars": [len(learnt)],
        "loss_sha256": [hashlib.sha256(learnt.encode()).hexdigest()],
        "formatted_chars": [len(text)],
        "escaped_turns": [escaped],
        "formatted": [text],
        "loss_spans": [[[a, b] for role, a, b in bodies if role == LEARNT]],
    }).astype({"conv_id": "Int64"})


def format_conversations(turns: DataFrame) -> DataFrame:
    """RESULT per conversation; ``loss_spans`` are character ranges of ``formatted`` under the loss mask."""
    rows = turns.selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "role", "text")
    return rows.groupBy("conv_id").applyInPandas(_digest, RESULT)


ADDED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, LEARNT, r"\### Assistant: </turn> ok")]

SQL = r"""
with all_turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + length(role) + 2 + 8 + length(regexp_replace(text,
    '(\\*(### ([A-Z][a-z_]*|=[A-Za-z0-9_.~%-]*): |</turn>))', '\\\1', 'g'))) as bigint) as formatted_chars
from all_turns group by conv_id
"""


@query("op1_chat_format", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return format_conversations(rows.unionByName(added)).drop("escaped_turns", "formatted", "loss_spans")
