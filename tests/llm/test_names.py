"""Columns of any name, many equal rows, rules that tie, and link counts, each against what must come out."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from pairpref.llm import jaccard_join, line_dedup, url_filter
from tests.llm.test_advice import shingled

NAMES = "kept int, lines int, mix int, encoded int, judged int, n_words int, one int, two int, use int, __n_removed int, distance int"
DOC = f"doc_id long, text string, lang string, source string, n_chars long, {NAMES}"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    say = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    rows = [(i, say(60 + i), "en", f"s{i % 2}", 100, *range(11)) for i in range(20)]
    return spark.createDataFrame(rows, DOC)


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_columns_of_any_name(spark, docs, stage):
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, docs, "")
    rows = out.collect()
    assert len(rows) >= 15
    if stage < 4:
        assert out.columns == docs.columns and all(tuple(r)[5:] == tuple(range(11)) for r in rows)


def test_urls_with_a_column_of_the_results_name(spark, docs):
    found = url_filter.filter_urls(docs.selectExpr("doc_id as page_id", "'http://a.com/' as url", "judged"), result="verdicts")
    assert found.columns == ["page_id", "url", "judged", "verdicts"] and {r.judged for r in found.collect()} == {4}


def test_allow_and_block_for_one_place_and_letters_beyond_ascii(spark):
    for rules in ([("allow", "a.com", "/x"), ("block", "a.com", "/x")], [("block", "a.com", "/x"), ("allow", "a.com", "/x")]):
        assert url_filter.judge(url_filter.build(rules), "a.com", "/xy")[1] == "block"
    trie = url_filter.build([("block", "É.com", "/")])
    assert url_filter.judge(trie, *url_filter.split_url("http://É.COM/"))[1] == "block"
    assert url_filter.judge(trie, *url_filter.split_url("http://é.com/")) is None


def test_ten_thousand_equal_rows_share_their_cuts(spark):
    text = "\n".join(["a b", "c d", "e f"] * 3 + ["tail"])
    rows = spark.range(10_000).selectExpr("7L as doc_id", f"'{text}' as text".replace("\n", "\\n"))
    rows = rows.unionByName(spark.createDataFrame([(3, text)], "doc_id long, text string"))
    out = line_dedup.remove_lines(rows).groupBy("doc_id", "text", "lines").count().collect()
    found = {r.doc_id: (r["count"], r.text, r.lines.n_removed) for r in out}
    assert len(out) == 2 and found[7] == (10_000, "", 10) and found[3][0] == 1 and found[3][1] == "a b\nc d\ne f\ntail"


@pytest.mark.parametrize("tile", [500_000, 400])
def test_links_of_every_document(spark, monkeypatch, tile):
    """A group of near copies holds a third of the rows; copies, chains and lone texts beside it."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    r = random.Random(8)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base, rows = say(90), []
    for _ in range(40):
        words = list(base)
        for at in r.sample(range(90), r.choice([0, 1, 1, 2])):
            words[at] = say(1)[0]
        rows.append(" ".join(words))
    rows += [" ".join(say(50)) for _ in range(40)] + rows[:3] + ["one two"] * 2 + ["", None]
    sets = [shingled(t, 4) for t in rows]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    expected = [sum(near(sets[i], sets[j]) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {x.doc_id: x.n_links for x in jaccard_join.link_components(frame, count=True).collect()}
    assert [found[i] for i in range(len(rows))] == expected and max(expected) > 20
