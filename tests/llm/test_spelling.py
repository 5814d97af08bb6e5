"""Spelling variants against brute force: nulls, repeated rows, ties, long words, pieces of large blocks, chains of forms."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from pairpref.llm import spelling

DOC = "doc_id long, text string, word string, n int, key string, unit string, best string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    others = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in others.items() if x}
    form = {w: best[w] if w in best and n[best[w]] >= 2 * n[w] else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(others[w]), n[form[w]] if form[w] else None) for w in n)


def found(spark, rows):
    frame = spark.createDataFrame([(d, t, "w", 1, "k", "u", "b") for d, t in rows], DOC)
    out = spelling.variants(spelling.planted_words(frame)).select("word", "form", "root", "n", "n_near", "form_n")
    return sorted(tuple(r) for r in out.collect())


def texts(seed):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeé") for _ in range(r.randrange(5, 9))) for _ in range(60)]
    rows = []
    for d in range(300):
        words = []
        for _ in range(40):
            w = r.choice(stems[: 1 + r.randrange(60)])
            at = r.randrange(len(w))
            words.append(r.choice([w, w, w, w[:at] + w[at + 1 :], w[:at] + r.choice("abÀß×") + w[at + 1 :], w[:at] + "e" + w[at:], w.upper()]))
        rows.append((d, r.choice([" ", "-", "1", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("piece,tile", [(2000, 512), (40, 16)])
def test_variants_equal_brute_force(spark, monkeypatch, piece, tile):
    monkeypatch.setattr(spelling, "PIECE", piece)
    monkeypatch.setattr(spelling, "TILE", tile)
    long = "x" * 30 + "abc" * 40
    rows = texts(5) + [(None, "house house housé"), (None, "house house housé"), (7, None), (8, ""), (9, "12 !?")]
    rows += [(400 + i, f"{long} {long} {long}y {long[:50]}{long[51:]} HOUSE") for i in range(4)]
    assert found(spark, rows) == brute(rows)


def test_chains_of_forms_and_ties(spark):
    words = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("abbbb", 48), ("zzzzz", 9), ("zzzzy", 20), ("zzzyz", 20), ("alone", 4)]
    out = {r.word: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {w: r.root for w, r in out.items()} == {
        **dict.fromkeys(["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb"], "abbbb"), "zzzzz": "zzzyz", "zzzzy": "zzzzy", "zzzyz": "zzzyz", "alone": "alone",
    }
    assert (out["zzzzz"].form, out["zzzzz"].n_near, out["alone"].form, out["alone"].n_near) == ("zzzyz", 2, None, 0)


def test_no_rows(spark):
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []
