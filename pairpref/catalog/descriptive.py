"""Descriptive aggregates, chart data, topics and classification."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairpref.catalog import query
from pairpref.catalog.tables import CLEANED, LEADERBOARD, cleaned, population, population_sql, prompts
from pairpref.operators import charts
from pairpref.operators import leaderboard as boards
from pairpref.operators.classify import balanced_weights, confusion, load_preference_model, report, train_preference_model
from pairpref.operators.graph import language_support
from pairpref.operators.population import LEGACY_SCORE
from pairpref.operators.topics import add_kmeans_topics
from pairpref.schema import A_WIN, B_WIN, OUTCOMES, TIE
from pairpref.session import ensure_checkpoint_dir

BASE = population_sql()


def statistics(spark, sf):
    eligible = population(spark, sf, LEGACY_SCORE).eligible
    named = eligible.withColumns({"model_a": F.col("model_a_id"), "model_b": F.col("model_b_id")})
    return boards.model_statistics(named)


def _rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


def _counts(name: str) -> str:
    return f'select "{name}", count(*) "count" from cleaned where "{name}" is not null group by 1'


def _shares(name: str) -> str:
    return f'select "{name}", count(*) "count", round(count(*) / sum(count(*)) over (), 6) proportion from cleaned group by 1'


@query("a01_model_statistics", LEADERBOARD + """
select model_name, battle_count, win_count, lose_count, tie_count, round(win_rate, 6) win_rate,
  round(tie_rate, 6) tie_rate, score, round(score_rate, 6) score_rate from leaderboard""")
def model_statistics(spark, sf):
    return _rounded(boards.ranked(statistics(spark, sf)), "win_rate", "tie_rate", "score_rate")


@query("a02_vote_shares", CLEANED + _shares("winner"))
def vote_shares(spark, sf):
    return _rounded(boards.proportions(cleaned(spark, sf), "winner"), "proportion")


@query("a02_language_shares", CLEANED + _shares("language"))
def language_shares(spark, sf):
    return _rounded(boards.proportions(cleaned(spark, sf), "language"), "proportion")


@query("a02_topic_shares", CLEANED + _shares("topic_name"))
def topic_shares(spark, sf):
    return _rounded(boards.proportions(cleaned(spark, sf), "topic_name"), "proportion")


@query("a03_daily", CLEANED + """
select strftime(battle_date, '%Y-%m-%d') battle_date, count(*) "count" from cleaned
where battle_date is not null group by 1""")
def daily(spark, sf):
    rows = boards.value_counts(cleaned(spark, sf), "battle_date", keep_missing=False)
    return rows.withColumn("battle_date", F.col("battle_date").cast("string"))


@query("a03_hourly", CLEANED + """
select battle_hour::int battle_hour, count(*) "count" from cleaned where battle_hour is not null group by 1""")
def hourly(spark, sf):
    return boards.value_counts(cleaned(spark, sf), "battle_hour", keep_missing=False)


TOPIC_VOTE = CLEANED + "select topic_name, " + ", ".join(
    f"count(*) filter (winner = '{o}') {o}" for o in OUTCOMES
) + " from cleaned group by 1"


@query("a04_topic_vote", TOPIC_VOTE)
def topic_vote(spark, sf):
    return boards.topic_by_vote(cleaned(spark, sf))


def _example(spark, sf, sql):
    """The stored example queries run unchanged over views named like the stored tables."""
    cleaned(spark, sf).createOrReplaceTempView("arena_battle")
    statistics(spark, sf).createOrReplaceTempView("model_statistics")
    return spark.sql(sql)


@query("a05_outcome_distribution", CLEANED + 'select winner, count(*) "count" from cleaned group by winner')
def outcome_distribution(spark, sf):
    return _example(spark, sf, "select winner, count(*) as count from arena_battle group by winner order by count desc")


@query("a06_leaderboard_top10", LEADERBOARD + """
select model_name, battle_count, win_count, tie_count, round(score_rate, 6) score_rate from leaderboard
where battle_count >= 100 order by leaderboard.score_rate desc, battle_count desc, model_name limit 10""")
def leaderboard_top10(spark, sf):
    top = boards.top_by_score(statistics(spark, sf), min_battles=100, limit=10)
    return _rounded(top.select("model_name", "battle_count", "win_count", "tie_count", "score_rate"), "score_rate")


@query("a07_language_counts", CLEANED + 'select "language", count(*) "count" from cleaned group by 1')
def language_counts(spark, sf):
    return _example(spark, sf, "select language, count(*) as count from arena_battle group by language order by count desc")


@query("a07_topic_counts", CLEANED + _counts("topic_name"))
def topic_counts(spark, sf):
    return _example(spark, sf, "select topic_name, count(*) as count from arena_battle group by topic_name order by count desc")


@query("a07_daily_counts", CLEANED + """
select strftime(battle_date, '%Y-%m-%d') battle_date, count(*) "count" from cleaned
where battle_date is not null group by 1""")
def daily_counts(spark, sf):
    rows = _example(
        spark,
        sf,
        "select battle_date, count(*) as count from arena_battle where battle_date is not null"
        " group by battle_date order by battle_date",
    )
    return rows.withColumn("battle_date", F.col("battle_date").cast("string"))


@query("a08_overview", CLEANED + """
select count(*) "rows", (select count(*) from (select model_a m from cleaned where model_a is not null
    union select model_b from cleaned where model_b is not null)) models,
  count(distinct "language") languages, count(distinct topic_name) topics from cleaned""")
def overview(spark, sf):
    return boards.overview(cleaned(spark, sf))


@query("a09_min_battles", LEADERBOARD + """
select model_name, battle_count, round(score_rate, 6) score_rate from leaderboard where battle_count >= 50""")
def min_battles(spark, sf):
    kept = statistics(spark, sf).where(F.col("battle_count") >= 50)
    return _rounded(kept.select("model_name", "battle_count", "score_rate"), "score_rate")


@query("a09_topic_filter", CLEANED + """
select topic_name, count(*) "count" from cleaned where topic_name in ('学习辅导', '知识问答', '其他主题') group by 1""")
def topic_filter(spark, sf):
    chosen = cleaned(spark, sf).where(F.col("topic_name").isin("学习辅导", "知识问答", "其他主题"))
    return boards.value_counts(chosen, "topic_name")


@query("a09_sample_rows", CLEANED + """
select question_id, model_a, model_b, winner, "language", topic_name, prompt_len, response_a_len, response_b_len
from cleaned order by source_row_index limit 200""")
def sample_rows(spark, sf):
    """The first 200 rows as shown to a reader; the limit is the feature."""
    first = cleaned(spark, sf).orderBy("source_row_index").limit(200)
    lengths = [F.col(n).cast("bigint").alias(n) for n in ("prompt_len", "response_a_len", "response_b_len")]
    return first.select("question_id", "model_a", "model_b", "winner", "language", "topic_name", *lengths)


@query("a10_outcome_counts", BASE + """
select canonical_outcome, count(*) population_rows,
  case when canonical_outcome <> 'tie_bothbad' then count(*) else 0 end likelihood_rows,
  case when canonical_outcome = 'tie_bothbad' then count(*) else 0 end excluded_rows
from eligible group by 1""")
def outcome_counts(spark, sf):
    return boards.outcome_counts(population(spark, sf).eligible, (A_WIN, B_WIN, TIE))


@query("a11_language_support", BASE + """,
reach as (
  with recursive edges as (
    select distinct language_canonical lang, model_a_id a, model_b_id b from eligible where language_canonical is not null
    union select distinct language_canonical, model_b_id, model_a_id from eligible where language_canonical is not null),
  walk as (
    select lang, min(a) node from edges group by lang
    union select e.lang, e.b from edges e join walk w on e.lang = w.lang and e.a = w.node)
  select lang, count(*) reached from walk group by lang),
models as (
  select lang, count(*) models from (
    select language_canonical lang, model_a_id m from eligible union select language_canonical, model_b_id from eligible)
  group by lang)
select language_canonical, count(*) "rows", max(models) models,
  count(distinct least(model_a_id, model_b_id) || '|' || greatest(model_a_id, model_b_id)) pairs,
  max(reached) = max(models) connected, count(distinct nullif(trim(judge_cluster_id), '')) judges,
  count(*) filter (canonical_outcome = 'model_a_win') model_a_win,
  count(*) filter (canonical_outcome = 'model_b_win') model_b_win,
  count(*) filter (canonical_outcome = 'tie') tie, count(*) filter (canonical_outcome = 'tie_bothbad') tie_bothbad
from eligible left join reach on reach.lang = language_canonical left join models on models.lang = language_canonical
where language_canonical is not null group by 1""")
def language_audit(spark, sf):
    return language_support(population(spark, sf).eligible)


@query("v01_top_battles", LEADERBOARD + """
select model_name, battle_count from leaderboard order by battle_count desc, model_name limit 10""")
def top_battles(spark, sf):
    return charts.top_by_battles(statistics(spark, sf)).select("model_name", "battle_count")


@query("v02_top_score_rate", LEADERBOARD + """,
t as (select greatest(10, trunc(median(battle_count) * 0.5)::int) threshold from leaderboard)
select model_name, battle_count, threshold, round(score_rate, 6) score_rate from leaderboard, t
where battle_count >= threshold order by leaderboard.score_rate desc, battle_count desc, model_name limit 10""")
def top_score_rate(spark, sf):
    top = charts.top_by_score_rate(statistics(spark, sf))
    return _rounded(top.select("model_name", "battle_count", "threshold", "score_rate"), "score_rate")


@query("v03_top_languages", CLEANED + """
select "language", count(*) "count" from cleaned where "language" is not null group by 1
order by 2 desc, 1 limit 10""")
def top_languages(spark, sf):
    return charts.top_values(cleaned(spark, sf), "language")


@query("v04_topic_vote_heatmap", TOPIC_VOTE)
def topic_vote_heatmap(spark, sf):
    return boards.topic_by_vote(cleaned(spark, sf))


@query("v05_length_box", CLEANED + """,
b as (select quantile_cont(len_diff, 0.01) lo, quantile_cont(len_diff, 0.99) hi from cleaned)
select winner, count(*) "rows", min(len_diff) lowest, round(quantile_cont(len_diff, 0.25), 6) q1,
  round(quantile_cont(len_diff, 0.5), 6) median, round(quantile_cont(len_diff, 0.75), 6) q3, max(len_diff) highest
from cleaned, b where len_diff between lo and hi group by 1""")
def length_box(spark, sf):
    box = charts.length_difference_box(cleaned(spark, sf))
    box = box.withColumns({n: F.col(n).cast("bigint") for n in ("lowest", "highest")})
    return _rounded(box, "q1", "median", "q3")


@query("v06_prompt_histogram", CLEANED + """,
e as (select min(prompt_len) lo, max(prompt_len) hi from cleaned),
f as (select least(floor((prompt_len - lo) / ((hi - lo) / 30.0::double)), 29)::int bin, count(*) "count"
  from cleaned, e group by 1)
select g.bin::int bin, round(lo + g.bin * ((hi - lo) / 30.0::double), 6) bin_start, coalesce("count", 0) "count"
from (select unnest(range(30)) bin) g left join f on f.bin = g.bin, e""")
def prompt_histogram(spark, sf):
    return _rounded(charts.length_histogram(cleaned(spark, sf)), "bin_start")


@query("v07_score_bars", LEADERBOARD + """
select model_name, round(leaderboard.score_rate, 3) score_rate from leaderboard
order by leaderboard.score_rate desc, battle_count desc, model_name limit 10""")
def score_bars(spark, sf):
    return charts.score_bars(statistics(spark, sf))


@query("v07_battles_against_score", LEADERBOARD + """
select model_name, battle_count, round(score_rate, 6) score_rate from leaderboard
order by battle_count desc, model_name limit 30""")
def battles_against_score(spark, sf):
    return _rounded(charts.battles_against_score(statistics(spark, sf)), "score_rate")


@query("m01_rule_topic", CLEANED + "select source_row_index, topic_name from cleaned")
def rule_topics(spark, sf):
    return cleaned(spark, sf).select("source_row_index", "topic_name")


def _document_topics():
    from pairpref.catalog.tables import topic_sql

    return f"select doc_id, {topic_sql('text')} topic_name from documents"


@query("m02_document_topics", _document_topics())
def document_topics(spark, sf):
    from pairpref.fixtures import table
    from pairpref.operators.topics import add_rule_topics

    documents = table(spark, sf, "documents").withColumnRenamed("text", "prompt_text")
    return add_rule_topics(documents).select("doc_id", "topic_name")


@query("m03_kmeans_topics")
def kmeans_topics(spark, sf):
    """Rows per cluster and its ten heaviest terms."""
    rows, keywords = add_kmeans_topics(prompts(spark, sf))
    sizes = rows.groupBy("topic_cluster").agg(F.count(F.lit(1)).alias("rows"))
    return keywords.join(sizes, "topic_cluster")


_COMPLETE = CLEANED + """,
complete as (select winner from cleaned where winner is not null and model_a is not null and model_b is not null and "language" is not null
  and topic_name is not null and prompt_len is not null and response_a_len is not null and response_b_len is not null and len_diff is not null)
"""


@query("m04_preference_model", _COMPLETE + """
select 'ok' status, count(*) "rows", true near_four_fifths, true accuracy_is_a_share, list_sort(list(distinct winner)) labels, true same_after_loading
from complete""")
def preference_model(spark, sf):
    """The vote classifier: every complete row is in one of the parts, and the saved pipeline predicts what the fitted one does.
    (Trees are bounded here to keep the query short.)"""
    rows = cleaned(spark, sf)
    fitted = train_preference_model(rows, trees=20, depth=8)
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/model-{uuid.uuid4().hex}"
    fitted.save(place)
    some = rows.na.drop(subset=["model_a", "model_b", "language", "topic_name"])
    one, two = (m.transform(some).select("source_row_index", "prediction") for m in (fitted.model, load_preference_model(place)))
    total = F.col("train_size") + F.col("test_size")
    return fitted.metrics.select(
        "status", total.alias("rows"), (F.abs(F.col("train_size") / total - 0.8) < 0.02).alias("near_four_fifths"),
        F.col("accuracy").between(0, 1).alias("accuracy_is_a_share"), F.array_sort("labels").alias("labels"), F.lit(one.exceptAll(two).isEmpty()).alias("same_after_loading"),
    )


@query("m05_class_weights", CLEANED + """
select winner, count(*) "rows", round(sum(count(*)) over () / (count(*) over () * count(*)), 6) weight
from cleaned where winner is not null group by 1""")
def class_weights(spark, sf):
    return _rounded(balanced_weights(cleaned(spark, sf), "winner"), "weight")


# A prediction that SQL can make as well: the longer answer wins, equal lengths tie.
_PREDICTED = CLEANED + """,
p as (select winner label, case when len_diff > 0 then 'model_a_win' when len_diff < 0 then 'model_b_win' else 'tie' end
  prediction from cleaned),
labels as (select distinct label from p),
per as (
  select l.label, count(*) filter (p.label = l.label) support, count(*) filter (p.prediction = l.label) predicted,
    count(*) filter (p.label = l.label and p.prediction = l.label) hits from labels l, p group by 1),
scored as (
  select label, support, coalesce(hits / nullif(predicted, 0), 0) prec, coalesce(hits / nullif(support, 0), 0) rec,
    coalesce(2.0::double * hits / nullif(predicted + support, 0), 0) f1, hits from per)
"""


def _predicted(spark, sf):
    rows = cleaned(spark, sf)
    longer = F.when(F.col("len_diff") > 0, A_WIN).when(F.col("len_diff") < 0, B_WIN).otherwise(TIE)
    return rows.select(F.col("winner").alias("label"), longer.alias("prediction"))


@query("m06_classification_report", _PREDICTED + """
select label, round(prec, 6) "precision", round(rec, 6) recall, round(f1, 6) f1_score, support from scored
union all select 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
  round(sum(hits) / sum(support), 6), sum(support)::bigint from scored
union all select 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), sum(support)::bigint from scored
union all select 'weighted avg', round(sum(prec * support) / sum(support), 6), round(sum(rec * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from scored""")
def classification_report(spark, sf):
    return _rounded(report(_predicted(spark, sf)), "precision", "recall", "f1_score")


@query("m07_confusion_matrix", _PREDICTED + "select label, " + ", ".join(
    f"count(*) filter (prediction = '{o}') {o}" for o in OUTCOMES) + " from p group by 1")
def confusion_matrix(spark, sf):
    return confusion(_predicted(spark, sf), list(OUTCOMES))
