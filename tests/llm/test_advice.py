"""Cases of the second review: each failed before its finding was settled."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
import numpy as np
from pairpref.llm import byte_bpe, chat_format, embedding_dedup, packing
from tests.llm.test_operators import WORD


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def shingled(text, width):
    parts = words(text)
    return frozenset(tuple(parts[i : i + width]) for i in range(max(1, len(parts) - width + 1))) if parts else frozenset()


def near_groups(rows, width, percent):
    """Smallest doc_id of each row's group, by comparing all pairs."""
    sets, parent = [shingled(t, width) for _, t in rows], list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    return [min(d for j, (d, _) in enumerate(rows) if root(j) == root(i)) for i in range(len(rows))]


def test_pipeline_near_duplicates_by_five_words_and_four_fifths(spark):
    r = random.Random(11)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base = say(100)
    rows = [(0, " ".join(base)), (1, " ".join(base[:40] + say(1) + base[41:80] + say(1) + base[81:])), (2, " ".join(base[:70] + say(30)))]
    rows += [(3 + i, " ".join(say(60))) for i in range(3)]
    assert near_groups(rows, 5, 80) != near_groups(rows, 4, 85)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == sorted(set(near_groups(rows, 5, 80)))


def test_pipeline_near_duplicates_of_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == sorted(set(near_groups(rows, 5, 80)))


def test_chat_texts_that_end_in_backslashes(spark):
    ends = ["C:" + "\\" * k for k in (1, 2, 3)] + ["\\", "</turn>\\", "</turn>\\\\</turn>", "x\\</turn>\n### User: y", "</turn>\n\\", "### User: \\\\"]
    rows = [(c, i, role, t) for c, order in enumerate(itertools.permutations(ends, 2)) for i, (role, t) in enumerate(zip(("user", "assistant"), order))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat_format.format_conversations(frame).collect()}
    assert len(found) == len(rows) // 2
    for c, r in found.items():
        own = [(role, t) for conv_id, _, role, t in rows if conv_id == c]
        assert chat_format.recovered(r.formatted) == own
        # The SQL's length: what is escaped costs one character a control string, a backslash at the end nothing.
        assert r.formatted_chars == sum(len(chat_format.header(role)) + len(chat_format.escape(t)) + len("</turn>\n") for role, t in own)


def test_chat_renderings_are_unambiguous():
    parts, seen = ["\\", "</turn>", "\n", "### User: ", "a"], {}
    bodies = ["".join(x) for n in range(5) for x in itertools.product(parts, repeat=n)]
    r = random.Random(3)
    some = [[("user", t)] for t in bodies] + [[("user", r.choice(bodies)), ("assistant", r.choice(bodies)), ("user", r.choice(bodies))] for _ in range(5000)]
    for turns in some:
        text, _ = chat_format.format_turns(turns)
        assert chat_format.recovered(text) == turns and seen.setdefault(text, turns) == turns


def brute(rows, cosine=0.98):
    """(vec_id, links, smallest linked id) of (vec_id, vector, label) rows of one label."""
    unit = np.array([v for _, v, _ in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= cosine
    low = np.arange(len(rows))
    while not np.array_equal(low, now := np.where(close, low[None, :], len(rows)).min(1)):
        low = now
    return sorted((rows[i][0], int(close[i].sum()) - 1, rows[low[i]][0]) for i in range(len(rows)))


def vectors_with_a_dense_group(dense, pairs):
    r = np.random.default_rng(12)
    centre, alone = r.normal(size=24), r.normal(size=(pairs, 24))
    vectors = [centre + r.normal(size=24) * 0.05 for _ in range(dense)] + [v + r.normal(size=24) * 0.02 for v in alone for _ in range(2)]
    return [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]


VECTOR = "vec_id long, embedding array<float>, label int"


def test_embeddings_of_a_dense_group(spark, monkeypatch):
    """A group that pivots do not split stays in few shards and is compared in blocks of bounded size."""
    for name, value in (("SHARD", 60), ("PIECE", 50)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = vectors_with_a_dense_group(300, 100)
    frame = spark.createDataFrame(rows, VECTOR)
    homes = embedding_dedup.shards(embedding_dedup.classes(frame)[1], 2).groupBy("rep").count()
    dense = homes.where("rep < 300").agg({"count": "avg"}).first()[0]
    assert dense <= 4, dense
    found = embedding_dedup.near_duplicates(frame).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in found) == brute(rows)


def test_embedding_audit_sees_small_groups(spark):
    rows = vectors_with_a_dense_group(60, 60)
    found = embedding_dedup.classes(spark.createDataFrame(rows, VECTOR))[1]
    true = brute(rows)
    links = lambda keep: spark.createDataFrame([(i, n if i < keep else 0) for i, n, _ in true], "rep long, links long")
    assert embedding_dedup.audit(found, links(len(rows)), 0.98) == 1.0
    assert embedding_dedup.audit(found, links(60), 0.98) < embedding_dedup.RECALL


def test_embedding_search_that_fails_is_replaced_by_exact_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PIECE", 50)
    lossy = lambda found, *_: found.selectExpr("rep", "0L as links", "rep as root")
    monkeypatch.setattr(embedding_dedup, "searched", lossy)
    rows = vectors_with_a_dense_group(80, 40)
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTOR)).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in found) == brute(rows) and {x.audit_recall for x in found} == {1.0}


def test_packing_does_not_depend_on_the_session(spark, sf, monkeypatch):
    """Slightly more characters than a shard holds make two shards, whatever the number of shuffle partitions."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    chars = docs.selectExpr("sum(length(text))").first()[0]
    monkeypatch.setattr(packing, "SHARD_CHARS", chars - 1)
    rows, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in (3, 20):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows.append(sorted((r.shard, r.sequence, r.doc_ids, r.pieces) for r in packing.pack(docs, *byte_bpe.tokenizer()).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows[0] == rows[1] and {r[0] for r in rows[0]} == {0, 1}
