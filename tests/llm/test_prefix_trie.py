"""The trie of conversations against brute force: nulls, repeated rows, turnless and deep ones, ranges of every size."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pairpref.llm import prefix_trie

TURN = "conv_id long, turn long, role string, text string, pos int, mark string, name string, entry int"


def conversations(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        by[conv].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    return {c: [(role, text) for _, role, _, text in sorted(t, key=lambda x: x[:3])] for c, t in by.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if c is not None else 0
        base = convs.get(int(c - c % 100 if c >= 0 else c + (-c) % 100), []) if c is not None else []
        out[c] = base[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    low = lambda m: min((c for c in m if c is not None), default=None)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    digest = lambda n: hashlib.sha256(",".join(map(str, sorted(c for c in ends[n] if c is not None))).encode()).hexdigest()
    rows = [(low(m), len(n), low(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], digest(n)) for n, m in members.items()]
    return sorted(rows, key=repr)


def found(spark, rows, rebuild):
    frame = spark.createDataFrame([(*r, 1, "m", "n", 2) for r in rows], TURN)
    return sorted((tuple(r) for r in prefix_trie.trie(frame, rebuild).drop("name").collect()), key=repr)


def some(seed, count):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-300, 900), count):
        for t in range(r.choice([1, 1, 2, 3, 5, 8, 30])):
            rows.append((c, r.choice([t, t, None]) if r.random() < 0.05 else t, r.choice(["user", "assistant", None]) if r.random() < 0.1 else "user", r.choice(["a", "b", "", None, "žä"])))
    rows += rows[:20]
    return rows


@pytest.mark.parametrize("entries,paths", [(400_000, 64), (60, 4), (25, 3)])
@pytest.mark.parametrize("rebuild", [False, True])
def test_nodes_equal_brute_force(spark, monkeypatch, entries, paths, rebuild):
    monkeypatch.setattr(prefix_trie, "ENTRIES_A_TASK", entries)
    monkeypatch.setattr(prefix_trie, "PATHS_A_TASK", paths)
    rows = some(4, 150) + [(None, 1, "user", "a"), (None, 2, None, None)]
    convs = conversations(rows)
    assert found(spark, rows, rebuild) == brute(rebuilt(convs) if rebuild else convs)


def test_hot_first_turn_copies_and_a_deep_chain(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENTRIES_A_TASK", 100)
    monkeypatch.setattr(prefix_trie, "PATHS_A_TASK", 8)
    rows = [(c, t, "user", x) for c in range(120) for t, x in enumerate(["hello", f"q{c % 40}", f"z{c % 60}"])]
    rows += [(200 + c, t, "user", "same") for c in range(80) for t in range(2)]
    rows += [(300 + c, t, "user", "log") for c in range(60) for t in range(5 * c + 1)]
    assert found(spark, rows, False) == brute(conversations(rows))


def test_no_rows_and_conversations_without_turns(spark):
    assert found(spark, [], True) == []
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert found(spark, [(alone, 0, "user", "x")], True) == brute({alone: []})
