"""The pipeline stage by stage on the small tables, each stage against a plain restatement on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from pairpref.llm.queries import QUERIES
from tests.llm.test_operators import groups, later, plain, reference_encoder


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns or name == "byte_bpe"
    after = lambda name: spark.read.parquet(str(tmp_path / name))
    ids = lambda frame: Counter(r.doc_id for r in frame.select("doc_id").collect())
    judged = QUERIES["op7_quality_rules"](spark, sf)
    assert ids(after("quality_rules")) == ids(judged.where("kept"))
    rows = plain(seen["line_dedup"])
    split = lambda t: [] if t is None else t.split("\n")
    left = {d: "\n".join(x for i, x in enumerate(split(t)) if i not in gone) for (d, t), gone in zip(rows, later(rows, split, 3))}
    assert dict(plain(after("line_dedup"))) == {d: t for d, t in left.items() if t.strip(" \t\n\x0b\x0c\r") or t == dict(rows)[d]}
    assert sorted(ids(after("jaccard_join"))) == sorted(int(c) for d, _, c in groups(plain(seen["jaccard_join"])) if c == d)
    used = ids(after("source_mixing"))
    assert set(used) <= set(ids(seen["source_mixing"])) and max(used.values()) <= 3
    ordinary, texts = reference_encoder().encode_ordinary, dict(plain(seen["byte_bpe"]))
    for r in docs.collect():
        assert r.ids == ordinary(texts[r.doc_id])
