"""Populations, views, descriptive aggregates and topics."""

from __future__ import annotations

import pytest
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer
from pyspark.sql import functions as F

from pairpref import session
from pairpref.catalog import tables
from pairpref.fixtures import PROVENANCE, battles_raw
from pairpref.operators import charts, topics
from pairpref.operators.canonical import canonicalize
from pairpref.operators.classify import report, stratified_split, train_preference_model
from pairpref.operators.leaderboard import model_statistics, topic_by_vote
from pairpref.operators.population import (
    BASE_RESEARCH,
    JUDGE_CLUSTER_RESEARCH,
    LEGACY_SCORE,
    PopulationSpec,
    apply_population,
)
from pairpref.operators.topics import OTHER_TOPIC, add_kmeans_topics, rule_topic
from pairpref.operators.views import (
    NO_REPEATED_QUESTIONS,
    apply_view,
    language_view,
    pair_support_view,
    register_view,
    view_by_id,
)
from pairpref.session import stored
from tests.test_canonical import TALK, battle, frame


@pytest.fixture(scope="module")
def canonical(spark, sf):
    return stored(canonicalize(battles_raw(spark, sf), PROVENANCE).drop("conversation_a", "conversation_b"))


def reasons(spark, spec=BASE_RESEARCH, **changes):
    rows = apply_population(canonicalize(frame(spark, battle(1, **changes)), PROVENANCE), spec)
    return rows.audit.first()["exclusion_reasons"]


def test_reason_hierarchy(spark):
    assert reasons(spark) == []
    assert reasons(spark, model_a=" ") == ["SOURCE_RECORD_INVALID", "INVALID_MODEL_FIELDS"]
    assert reasons(spark, model_a="beta") == ["SOURCE_RECORD_INVALID", "SAME_MODEL"]
    assert reasons(spark, conversation_a=None) == ["SOURCE_RECORD_INVALID", "INVALID_CONVERSATION_A"]
    assert reasons(spark, conversation_b=TALK[1:]) == ["SOURCE_RECORD_INVALID", "MISSING_USER_TURN_B"]
    other = [{"role": "user", "content": "Ho"}, TALK[1]]
    assert reasons(spark, conversation_b=other) == ["SOURCE_RECORD_INVALID", "PROMPT_PAIR_MISMATCH"]
    assert reasons(spark, anony="yes") == ["INVALID_ANONY_FLAG"]
    assert reasons(spark, anony="false") == ["NON_ANONYMOUS_BATTLE"]
    assert reasons(spark, winner="?", tstamp="x", anony="false") == [
        "SOURCE_RECORD_INVALID", "INVALID_OUTCOME", "INVALID_TIMESTAMP", "NON_ANONYMOUS_BATTLE", "OUTCOME_NOT_ALLOWED",
    ]
    assert reasons(spark, LEGACY_SCORE, winner="tie (bothbad)") == ["OUTCOME_NOT_ALLOWED"]
    assert reasons(spark, JUDGE_CLUSTER_RESEARCH, judge=" ") == ["MISSING_JUDGE"]


def test_specs_are_checked():
    with pytest.raises(ValueError):
        PopulationSpec(" ")
    with pytest.raises(ValueError):
        PopulationSpec("x", population_spec_version=0)


def test_empty_population_has_rate_zero(spark):
    summary = apply_population(canonicalize(frame(spark, battle(1)).where("false"), PROVENANCE), BASE_RESEARCH).summary.first()
    assert (summary["input_rows"], summary["eligibility_rate"]) == (0, 0.0)


def test_anchor_sizes(canonical):
    base = apply_population(canonical, BASE_RESEARCH)
    summary = base.summary.first()
    assert (summary["input_rows"], summary["eligible_rows"]) == (2663, 1814)
    assert base.eligible.count() == base.marked.where("eligible").count() == 1814
    assert apply_population(canonical, JUDGE_CLUSTER_RESEARCH).eligible.count() == 1778
    audit = apply_view(base, NO_REPEATED_QUESTIONS).support_audit.first()
    assert (audit["repeated_group_count"], audit["rows_excluded"]) == (47, 135)
    assert apply_view(base, pair_support_view(10)).support_audit.first()["qualifying_pair_count"] == 42


def test_repeated_questions_keep_blanks_and_do_not_trim(spark):
    ids = ["q", "q", " q", None, None, " ", " "]
    rows = frame(spark, *[battle(i, question_id=q) for i, q in enumerate(ids)])
    view = apply_view(apply_population(canonicalize(rows, PROVENANCE), BASE_RESEARCH), NO_REPEATED_QUESTIONS)
    assert sorted(r["source_row_index"] for r in view.eligible.collect()) == [2, 3, 4, 5, 6]
    assert view.summary.first()["excluded_rows"] == 2


def test_pair_support_is_unordered(spark):
    rows = [battle(i) for i in range(6)] + [battle(10 + i, model_a="beta", model_b="alpha") for i in range(4)]
    rows += [battle(20, model_b="gamma")]
    view = apply_view(apply_population(canonicalize(frame(spark, *rows), PROVENANCE), BASE_RESEARCH), pair_support_view(10))
    assert view.eligible.count() == 10 and view.audit.where("view_eligible").count() == 10


def test_view_registry(canonical):
    base = apply_population(canonical, BASE_RESEARCH)
    with pytest.raises(KeyError):
        view_by_id("nope")
    with pytest.raises(ValueError):
        register_view(language_view("French", "en"))
    altered = language_view("French", "en")
    with pytest.raises(ValueError):
        apply_view(base, altered)
    with pytest.raises(ValueError):
        apply_view(apply_population(canonical, LEGACY_SCORE), NO_REPEATED_QUESTIONS)


def test_model_statistics(spark):
    rows = [("a", "b", o) for o in ("model_a_win", "model_b_win", "tie", "tie_bothbad", "invalid_unknown")]
    rows.append((" ", "b", "model_b_win"))
    found = {r["model_name"]: r for r in model_statistics(spark.createDataFrame(rows, "model_a string, model_b string, winner string")).collect()}
    assert set(found) == {"a", "b"}
    assert (found["a"]["battle_count"], found["a"]["score"], found["a"]["score_rate"]) == (3, 1.5, 0.5)


def test_topic_rules(spark):
    prompts = ["Write a poem", "debug my PYTHON code", "", None, "please explain why", "翻译这句话", "solve the essay"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, p string")
    found = [r[0] for r in rows.orderBy("i").select(rule_topic(F.col("p"))).collect()]
    assert found == ["写作创作", "编程开发", OTHER_TOPIC, OTHER_TOPIC, "知识问答", "翻译语言", "写作创作"]


def test_kmeans_topics_separate_two_vocabularies(spark):
    words = ["red green blue paint", "disk memory cpu cache"]
    rows = spark.createDataFrame([(i, words[i % 2] + f" {words[i % 2].split()[i % 4]}") for i in range(40)], "i int, prompt_text string")
    labelled, keywords = add_kmeans_topics(rows, clusters=2)
    groups = {frozenset(r["i"] % 2 for r in labelled.where(F.col("topic_cluster") == k).collect()) for k in (0, 1)}
    assert groups == {frozenset({0}), frozenset({1})}
    assert keywords.count() == 2 and all(r["keywords"] for r in keywords.collect())


def _repeated_prompts(spark):
    """Prompts of two vocabularies, each many times, among them none and an empty one."""
    times = {"Red blue": 300, "red green": 90, "green red red": 40, "disk cache": 200, "disk Memory cpu": 100, "cpu disk once": 4, "": 3, None: 5}
    rows = [(prompt, n) for prompt, n in times.items()]
    repeated = spark.createDataFrame(rows, "prompt_text string, n int").withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    return times, repeated.select(F.struct("prompt_text", "copy").alias("i.d"), "prompt_text")


def test_kmeans_topics_handle_a_prompt_once_however_many_rows_have_it(spark, monkeypatch):
    times, rows = _repeated_prompts(spark)
    kept = []
    monkeypatch.setattr(topics, "stored", lambda df, **options: kept.append(stored(df, **options)) or kept[-1])
    found = {}
    for limit in (session.BROADCAST_BYTES, 0):  # labels by prompt, or of each row
        monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
        labelled, keywords = topics.add_kmeans_topics(rows, clusters=2)
        assert labelled.columns == ["i.d", "prompt_text", "topic_cluster"] and keywords.count() == 2
        found[limit] = {(r.prompt_text, r.topic_cluster): r.n for r in labelled.groupBy("prompt_text", "topic_cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
        groups = {prompt: cluster for prompt, cluster in found[limit]}
        assert {prompt: n for (prompt, _), n in found[limit].items()} == times and set(groups.values()) == {0, 1}
        assert groups["Red blue"] == groups["red green"] == groups["green red red"] != groups["disk cache"] == groups["disk Memory cpu"]
        terms = {r.topic_cluster: r.keywords.split(", ") for r in keywords.collect()}[groups["Red blue"]]
        assert terms.index("blue") < terms.index("green")  # of the 430 rows 300 have the one, 130 the other
    assert found[0] == found[session.BROADCAST_BYTES] and max(frame.count() for frame in kept) <= len(times)


def test_terms_are_counted_by_rows_as_the_library_does(spark):
    times, rows = _repeated_prompts(spark)
    words = RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"(?U)\w+", gaps=False)
    for limit in (2, 3000):
        texts = rows.select(F.coalesce("prompt_text", F.lit("")).alias("__text"))
        counts = CountVectorizer(inputCol="__words", outputCol="__tf", vocabSize=limit, minDF=2.0, maxDF=0.95)
        fitted = Pipeline(stages=[words, counts, IDF(inputCol="__tf", outputCol="__idf")]).fit(texts)
        different = texts.groupBy("__text").agg(F.count(F.lit(1)).alias("__weight"))
        mine = topics._vocabulary(words.transform(different), sum(times.values()), limit)
        assert {t.term: t.df for t in mine} == dict(zip(fitted.stages[1].vocabulary, fitted.stages[2].docFreq))
    assert [t.term for t in mine][:2] == ["red", "disk"]
    with pytest.raises(IllegalArgumentException):
        topics.add_kmeans_topics(rows.where("prompt_text = ''"))


def test_prompts_are_those_of_the_cleaned_rows(spark, sf):
    mine, theirs = tables.prompts(spark, sf), tables.cleaned_texts(spark, sf).select("source_row_index", "prompt_text")
    assert mine.schema.simpleString() == theirs.schema.simpleString() and mine.count() == theirs.count() > 0
    assert mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()


def test_histogram_covers_all_rows(spark):
    rows = spark.range(101).select(F.col("id").cast("int").alias("prompt_len"))
    bins = charts.length_histogram(rows).orderBy("bin").collect()
    assert len(bins) == 30 and sum(b["count"] for b in bins) == 101
    flat = charts.length_histogram(rows.where("prompt_len = 5"))
    assert [b["count"] for b in flat.orderBy("bin").collect()][15] == 1


def test_crosstab_has_every_outcome(spark):
    rows = spark.createDataFrame([("t", "tie"), ("t", "tie"), ("u", "model_a_win")], "topic_name string, winner string")
    found = {r["topic_name"]: r for r in topic_by_vote(rows).collect()}
    assert (found["t"]["tie"], found["t"]["model_b_win"], found["u"]["model_a_win"]) == (2, 0, 1)


def test_classifier_learns_and_skips(spark):
    rows = spark.range(400).select(
        F.col("id").alias("source_row_index"), F.lit("a").alias("model_a"), F.lit("b").alias("model_b"),
        F.lit("English").alias("language"), F.lit("t").alias("topic_name"), F.lit(10).alias("prompt_len"),
        F.col("id").cast("int").alias("response_a_len"), F.lit(200).alias("response_b_len"),
        (F.col("id") - 200).cast("int").alias("len_diff"),
        F.when(F.col("id") > 200, "model_a_win").otherwise("model_b_win").alias("winner"),
    )
    found = train_preference_model(rows, trees=10)
    scores = {r["label"]: r for r in found.report.collect()}
    assert found.status == "ok" and scores["accuracy"]["f1_score"] > 0.95
    assert 40 <= found.test_rows <= 120 and found.train_rows + found.test_rows == 400
    split = stratified_split(rows, "winner", "source_row_index", 1)
    assert split.count() == 400
    assert train_preference_model(rows.limit(50), trees=5).status == "skipped"


def test_report_has_zero_for_unpredicted(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "a")], "label string, prediction string")
    found = {r["label"]: r for r in report(rows).collect()}
    assert found["b"]["precision"] == found["b"]["f1_score"] == 0.0 and found["accuracy"]["recall"] == 0.5
