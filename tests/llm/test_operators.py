"""The operators against brute force on small rows: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from pairpref.llm import (
    byte_bpe,
    chat_format,
    embedding_dedup,
    jaccard_join,
    line_dedup,
    packing,
    quality_rules,
    source_mixing,
    substring_dedup,
    url_filter,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, name string, first int, bits string"


def texts(seed: int = 3) -> list[str | None]:
    """Passages, exact and near copies, one very long text, odd white space, nothing at all."""
    r = random.Random(seed)
    say = lambda n: [r.choice("an be cat dog ear fig gum hut ink jam key lip mud nut".split()) + str(r.randrange(400)) for _ in range(n)]
    passage, base = say(45), say(120)
    near = [" ".join(base[:i] + say(1) + base[i + 1 :]) for i in (3, 60, 119)]
    mixed = [" ".join(say(30) + passage + say(20)) for _ in range(4)]
    lines = "\n".join(" ".join(say(4)) for _ in range(6))
    loop = " ".join(say(5) * 12)
    return [
        *mixed, *near, " ".join(base), " ".join(base), lines, "head\n" + lines + "\ntail", lines, loop, " ".join(say(6000)),
        "one two", "one two", "One TWO three", "", None, " \t\n \x0b\x0c\r ", "\n\n\n\n", "naïve café 日本\u00a0語 \U0001f600 x\u2028y",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or ""), "x", 1, "b") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[2], (None, rows[0][1], "en", "s0", 0, "x", 1, "b")], DOC)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def later(rows, split, width):
    """Row number -> positions covered by windows that also start at an earlier place."""
    place = lambda row, i: ((row[0] is not None, row[0] or 0), row[1] or "", i)
    least: dict = {}
    for row in rows:
        parts = split(row[1])
        for i in range(len(parts) - width + 1):
            key, at = tuple(parts[i : i + width]), ((row[0] is not None, row[0] or 0), i)
            least[key] = min(least.get(key, at), at)
    out = []
    for row in rows:
        parts, gone = split(row[1]), set()
        for i in range(len(parts) - width + 1):
            if place(row, i)[::2] != least[tuple(parts[i : i + width])]:
                gone |= set(range(i, i + width))
        out.append(gone)
    return out


def test_substring_dedup(docs, nothing):
    rows = plain(docs)
    split = lambda t: WORD.findall(t or "")
    want = sorted(
        (str(row[0]), len(split(row[1])), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(split(row[1])) if i not in gone).encode()).hexdigest())
        for row, gone in zip(rows, later(rows, split, 20))
    )
    found = substring_dedup.remove_repeated(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == want
    assert any(r.n_removed for r in found) and all(sum(b - a for a, b in r.removed) == r.n_removed for r in found)
    assert substring_dedup.remove_repeated(nothing).count() == 0


def test_line_dedup(docs, nothing):
    rows = plain(docs)
    split = lambda t: [] if t is None else t.split("\n")
    want = sorted(
        (str(row[0]), str(row[1] if row[1] is None else "\n".join(x for i, x in enumerate(split(row[1])) if i not in gone)))
        for row, gone in zip(rows, later(rows, split, 3))
    )
    found = line_dedup.remove_lines(docs)
    assert found.columns[: len(docs.columns)] == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in found.collect()) == want
    assert line_dedup.remove_lines(nothing).count() == 0


def shingles(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if 0 < len(words) < 4:
        return frozenset({tuple(words)})
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3))


def groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(str(d), len(sets[i]), str(least.get(root(i)))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("tile", "rare"), [(500_000, 8), (150, 1)])
def test_jaccard_join(docs, nothing, monkeypatch, tile, rare):
    """The second case divides blocks into tiles, so visits between tiles are needed."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    found = jaccard_join.link_components(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == sorted(groups(plain(docs)))
    assert jaccard_join.link_components(nothing).count() == 0


def test_jaccard_near_copies_in_tiles(spark, monkeypatch):
    """A dense group of near copies, many of which do not link with one another directly."""
    monkeypatch.setattr(jaccard_join, "TILE", 400)
    r = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(w if r.random() > 0.02 else f"z{r.randrange(9999)}" for w in base)) for i in range(40)]
    found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in found) == sorted(groups(rows))


def test_keep_first(docs):
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    component = {d: c for d, _, c in groups(plain(docs))}
    assert len(ids) == len(set(ids)) and {str(i) for i in ids} >= {c for d, c in component.items() if c == d}
    assert all(component[str(i)] == str(i) for i in ids if i is not None)


def test_divide_skip_equals_counting():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(r.choice(pool, r.integers(20, 60))) for _ in range(60)]
    index = jaccard_join.Index(sets)
    for q in sets:
        true = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 85 * len(np.union1d(q, s))}
        assert set(index.linked(q, 1, lambda x: False, 85)) == true


def test_quality_statistics(docs, nothing):
    found = {(str(r.doc_id), r.text): r for r in quality_rules.base_statistics(docs).collect()}
    for doc_id, text in plain(docs):
        words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
        at: dict = {}
        for i in range(len(words) - 2):
            at.setdefault(tuple(words[i : i + 3]), []).append(i)
        repeated = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
        r = found[str(doc_id), text]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
    judged = quality_rules.judge(docs)
    assert judged.columns[: len(docs.columns)] == docs.columns
    assert all(r.kept == (not r.base_failed) for r in judged.collect())  # too few rows for an estimate
    assert quality_rules.judge(nothing).count() == 0


def test_quality_outliers(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("etaoinshr", k=r.randint(2, 9)))
    clean = [(i, " ".join(word() for _ in range(r.randint(60, 900)))) for i in range(150)]
    odd = [(1000 + i, " ".join(word() + "###" for _ in range(200))) for i in range(10)]
    rows = [(i, t, "en", "a") for i, t in clean + odd]
    kept = {x.doc_id for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert kept == {i for i, _ in clean}


def test_mixing(docs, nothing):
    found = source_mixing.mix_by_source(docs)
    rows = found.collect()
    assert found.columns == [*docs.columns, "mix"]
    assert all(r.mix.taken == r.mix.times * r.mix.size and 0 <= r.mix.times <= 3 for r in rows)
    assert all(r.mix.size == len(WORD.findall(r.text or "")) for r in rows)
    assert sorted((str(r.doc_id), r.mix.times) for r in rows) == sorted((str(r.doc_id), r.mix.times) for r in source_mixing.mix_by_source(docs.repartition(7)).collect())
    assert source_mixing.mix_by_source(nothing).count() == 0


def test_mixing_meets_targets(spark):
    r = random.Random(4)
    rows = [(i, f"s{min(i % 7, 3)}" if i % 11 else None, r.randint(1, 300)) for i in range(600)]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    mixed = source_mixing.mix(docs, F.array("source"), F.col("n"), [F.col("doc_id")]).collect()
    taken: dict = {}
    for x in mixed:
        taken[x.source] = taken.get(x.source, 0) + x.mix.taken
    sizes = {s: sum(n for _, t, n in rows if t == s) for s in taken}
    weights = {s: source_mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    targets = source_mixing.water_fill(sizes, weights)
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    for s in taken:
        assert targets[s] <= 3 * sizes[s] and abs(taken[s] - targets[s]) < 20


def test_flow_is_cheapest():
    """Two overlapping sources: the flow's cost equals the best of all integer splits."""
    patterns = {("a",): 4, ("a", "b"): 5, ("b",): 2}
    flows = source_mixing.route(patterns, {"a": 7.0, "b": 8.0})
    assert sum(f for (_, s), f in flows.items() if s == "a") == 7 and sum(f for (_, s), f in flows.items() if s == "b") == 8
    cost = lambda used, size: sum((k // size + 1) ** 2 for k in range(used))
    own = {p: sum(f for (q, _), f in flows.items() if q == p) for p in patterns}
    best = min(
        cost(7 - x, 4) + cost(x + y, 5) + cost(8 - y, 2)
        for x in range(8) for y in range(9) if 7 - x <= 12 and x + y <= 15 and 8 - y <= 6
    )
    assert sum(cost(own[p], patterns[p]) for p in patterns) == best


def reference_encoder():
    import tiktoken

    path, pattern = byte_bpe.tokenizer()
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def test_byte_bpe(docs, nothing, spark):
    ordinary = reference_encoder().encode_ordinary
    odd = ["a  b \n\n c\t\td  ", "x\u00a0 \u00a0y \u3000z", "<|endoftext|> I'm 12345 !!??\r\n ok", "ab" * 400, "   ", "\x1c \x85 q", "e\u0301\u00e9 \U0001f600"]
    more = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    want = ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")
    for frame in (docs, more):
        coded = byte_bpe.encode(frame, *byte_bpe.tokenizer(), want)
        assert coded.columns == [*frame.columns, "encoded"]
        for r in coded.collect():
            ids, raw = ordinary(r.text or ""), (r.text or "").encode()
            assert r.encoded.ids == ids and r.encoded.n_tokens == len(ids) and bytes(r.encoded.decoded) == raw
            assert r.encoded.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.encoded.decoded_sha256 == hashlib.sha256(raw).hexdigest()
    assert byte_bpe.encode(nothing, *byte_bpe.tokenizer()).count() == 0


def test_packing(docs, nothing):
    ordinary, length = reference_encoder().encode_ordinary, 256
    rows = packing.pack(docs, *byte_bpe.tokenizer(), length).collect()
    pieces: dict = {}
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == length and r.cu_seqlens[-1] == r.n_tokens <= length and set(ids[r.n_tokens :]) <= {packing.PAD}
        for doc_id, k, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces.setdefault(doc_id, []).append((k, ids[a:b].tolist()))
            assert positions[a:b].tolist() == list(range(b - a))
    want: dict = {}
    for doc_id, text in plain(docs):
        ids = ordinary(text or "")
        for k, a in enumerate(range(0, len(ids), length)):
            want.setdefault(doc_id, []).append((k, ids[a : a + length]))
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in want.items()}
    assert packing.pack(nothing, *byte_bpe.tokenizer()).count() == 0


def test_best_fit_decreasing():
    r = random.Random(6)
    sizes = [r.randint(1, 100) for _ in range(500)]
    rooms: list[int] = []
    for size in sorted(sizes, reverse=True):  # the same rule, searched one by one
        fitting = [i for i, room in enumerate(rooms) if room >= size]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= size
        else:
            rooms.append(100 - size)
    packed = packing.best_fit_decreasing(sizes, 100)
    assert sorted(i for s in packed for i in s) == list(range(500))
    assert sorted(100 - sum(sizes[i] for i in s) for s in packed) == sorted(rooms)


def test_chat_round_trip(spark):
    texts_ = [None, "", "plain", r"\### Assistant: </turn> ok", "### User: hi</turn>\n### Assistant: x", "\\\\</turn>", "### =a%20b: ", "é\n\n"]
    rows = [(1, i, ["user", "assistant", None, "System X", "tool\n:"][i % 5], t) for i, t in enumerate(texts_)]
    rows += [(2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, None, None, None), (3, 1, "user", "later"), (3, 0, "user", "first")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = {r.conv_id: r for r in chat_format.format_conversations(frame).collect()}
    assert set(found) == {1, 2, 3, None}
    for conv_id, r in found.items():
        own = sorted(((t is not None, t or 0), (ro is not None, ro or ""), (x is not None, x or "")) for c, t, ro, x in rows if c == conv_id)
        turns = [(ro[1], x[1]) for _, ro, x in own]
        assert chat_format.recovered(r.formatted) == turns and r.n_turns == len(turns) and r.formatted_chars == len(r.formatted)
        learnt = "".join(x for ro, x in turns if ro == "assistant")
        assert "".join(chat_format.unescape(r.formatted[a:b]) for a, b in r.loss_spans) == learnt and r.loss_chars == len(learnt)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for ro, x in turns).encode()).hexdigest()
    assert chat_format.format_conversations(frame.limit(0)).count() == 0


def test_url_filter(spark):
    hosts = ["example.com", "www.example.com", "a.www.EXAMPLE.com", "other.com", "x.net", "net", "comb", "com", "", "example.com:80"]
    paths = ["", "/", "/en/", "/en/a?b#c", "/en", "/es/1", "/fr/", "?q=/en/", "#x", "/EN/", "//en/"]
    urls = [f"{s}{h}{p}" for s, h, p in itertools.product(("http://", "x://", ""), hosts, paths)] + [None, "", "a://b://c.com/en/"]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_filter.filter_urls(frame).collect():
        host, path = "", ""
        if r.url and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.lower()
        fits = [(len(h), len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = (max(fits)[2:]) if fits else (None, url_filter.DEFAULT)
        assert (r.judged.host, r.judged.path, r.judged.rule, r.judged.verdict) == (host, path, rule, verdict), r.url
    assert url_filter.filter_urls(frame.limit(0)).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + r.normal(size=16) * (0.05 if i % 4 else 0.6)], i % 3) for i in range(400)]
    rows += [(400, rows[5][1], 2), (401, rows[5][1], 2), (402, None, 1), (403, [0.0] * 16, 1), (404, [float("nan")] * 16, 1), (405, [None] * 16, 1), (406, rows[5][1], None)]
    rows += [(407, [2 * x for x in rows[5][1]], 2), (408, rows[5][1][:8], 2), (409, [], 2), (400, rows[5][1], 2)]
    frame = spark.createDataFrame([(*x, "e") for x in rows], "vec_id long, embedding array<float>, label int, component_id string")
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    parent = list(range(len(rows)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    links = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = rows[a], rows[b]
        if x[2] is not None and x[2] == y[2] and ok(x[1]) and ok(y[1]) and len(x[1]) == len(y[1]):
            u, v = (np.array(z[1], np.float32).astype(float) for z in (x, y))
            if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least: dict = {}
    for i, x in enumerate(rows):
        least[root(i)] = min(x[0], least.get(root(i), x[0]))
    want = sorted((x[0], links[i], least[root(i)], x[0] == least[root(i)]) for i, x in enumerate(rows))
    found = embedding_dedup.near_duplicates(frame).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in found) == want
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_range_search_finds_dense_groups():
    r = np.random.default_rng(9)
    unit = np.concatenate([r.normal(size=(300, 12)), r.normal(size=(1, 12)) + r.normal(size=(150, 12)) * 0.03])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    lists = embedding_dedup.robust_pruned(unit, 1)
    back = [np.flatnonzero([i in own for own in lists]) for i in range(len(unit))]
    lists = [np.union1d(a, b) for a, b in zip(lists, back)]
    true = unit @ unit.T >= 0.98
    found = sum(len(embedding_dedup.range_search(unit, lists, q, embedding_dedup.medoid(unit), 32, 0.98)) for q in range(len(unit)))
    assert found >= 0.95 * true.sum()


def test_components_of_chains_stars_and_repeated_edges(spark):
    from pairpref.llm.components import Forest, components

    chain = [((i * 7) % 401, ((i + 1) * 7) % 401) for i in range(400)]
    edges = chain + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (-3, 2000), (2000, -3), (-3, 2000)]
    forest = Forest()
    for u, v in edges:
        forest.union(u, v)
    expected = {(x, forest.root(x)) for pair in edges for x in pair if forest.root(x) != x}
    table = spark.createDataFrame(edges, "u long, v long").repartition(5)
    for edges_a_task in (50, 300, 200_000):
        found = components(table, edges_a_task).collect()
        assert len(found) == len(expected) and set(map(tuple, found)) == expected
    assert components(table.limit(0), 50).count() == 0
