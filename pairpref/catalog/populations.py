"""Populations and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairpref.catalog import query
from pairpref.catalog.tables import canonical_table, population, population_sql
from pairpref.operators.population import (
    BASE_RESEARCH,
    JUDGE_CLUSTER_RESEARCH,
    LANGUAGE_RESEARCH,
    LEGACY_SCORE,
    POPULATIONS,
    PopulationSpec,
    apply_population,
)
from pairpref.operators.views import (
    NO_REPEATED_QUESTIONS,
    REGISTRY,
    apply_view,
    language_view,
    pair_support_audit,
    pair_support_view,
    register_view,
)
from pairpref.schema import TIE

BASE = population_sql()
WITHOUT_COPIES = PopulationSpec("base_without_copies", require_anonymous=True, exclude_exact_duplicates=True)
STRICT = PopulationSpec(
    "strict_decisive_or_tie",
    require_anonymous=True,
    require_judge=True,
    require_language=True,
    allowed_outcomes=frozenset(("model_a_win", "model_b_win", TIE)),
    exclude_exact_duplicates=True,
)
NATION = register_view(language_view("NATION_7", "nation_7"))
REPEATED_SQL = f"""{BASE},
repeated as (select question_id_raw from eligible where trim(question_id_raw) <> ''
  group by 1 having count(*) > 1)
"""
SUPPORT_SQL = f"""{BASE},
support as (select least(model_a_id, model_b_id) l, greatest(model_a_id, model_b_id) g, count(*) n
  from eligible group by 1, 2)
"""


def _reasons():
    return F.array_join("exclusion_reasons", ",").alias("reasons")


@query("p02_invalid_reasons", BASE + """
select source_row_index, array_to_string(reasons, ',') reasons from audit where len(reasons) > 0""")
def invalid_reasons(spark, sf):
    return population(spark, sf).audit.where(~F.col("eligible")).select("source_row_index", _reasons())


@query("p03_audit", BASE + """
select source_row_index, 'base_research' population_id, len(reasons) = 0 eligible,
  array_to_string(reasons, ',') reasons from audit""")
def audit(spark, sf):
    return population(spark, sf).audit.select("source_row_index", "population_id", "eligible", _reasons())


@query("p03_eligible", BASE + "select source_row_index, model_a_id, model_b_id, canonical_outcome from eligible")
def eligible(spark, sf):
    rows = population(spark, sf).eligible
    return rows.select("source_row_index", "model_a_id", "model_b_id", "canonical_outcome")


def summary_sql(name: str, **options: bool) -> str:
    return f"""{population_sql(**options)}
select '{name}' population_id, 2 population_spec_version, count(*) input_rows,
  count(*) filter (len(reasons) = 0) eligible_rows, count(*) filter (len(reasons) > 0) excluded_rows,
  round(count(*) filter (len(reasons) = 0) / count(*), 6) eligibility_rate from audit"""


def _summary(spark, sf, spec):
    summary = population(spark, sf, spec).summary.drop("exclusion_reason_counts")
    return summary.withColumn("eligibility_rate", F.round("eligibility_rate", 6))


@query("p04_base_research", summary_sql("base_research"))
def base_research(spark, sf):
    return _summary(spark, sf, BASE_RESEARCH)


@query("p04_legacy_score", summary_sql("legacy_score", legacy=True))
def legacy_score(spark, sf):
    return _summary(spark, sf, LEGACY_SCORE)


@query("p04_judge_cluster_research", summary_sql("judge_cluster_research", judge=True))
def judge_cluster_research(spark, sf):
    return _summary(spark, sf, JUDGE_CLUSTER_RESEARCH)


@query("p04_language_research", summary_sql("language_research", language=True))
def language_research(spark, sf):
    return _summary(spark, sf, LANGUAGE_RESEARCH)


@query("p05_policies", f"""{population_sql(judge=True, language=True, legacy=True, copies=True)}
select source_row_index, array_to_string(reasons, ',') reasons from audit""")
def policies(spark, sf):
    return population(spark, sf, STRICT).audit.select("source_row_index", _reasons())


@query("p05_without_copies", f"""{population_sql(copies=True)}
select model_a_id, model_b_id, count(*) battles from eligible group by 1, 2""")
def without_copies(spark, sf):
    rows = population(spark, sf, WITHOUT_COPIES).eligible
    return rows.groupBy("model_a_id", "model_b_id").agg(F.count(F.lit(1)).alias("battles"))


@query("p06_reason_counts", BASE + """
select reason, count(*) "rows" from (select unnest(reasons) reason from audit) group by 1""")
def reason_counts(spark, sf):
    return population(spark, sf).reason_counts


@query("p06_summary_counts", BASE + """
select reason, count(*) "rows" from (select unnest(reasons) reason from audit) group by 1""")
def summary_counts(spark, sf):
    return population(spark, sf).summary.select(F.explode("exclusion_reason_counts").alias("reason", "rows"))


@query("p07_no_repeated_questions", REPEATED_SQL + """
select source_row_index, question_id_raw from eligible
where question_id_raw is null or question_id_raw not in (select question_id_raw from repeated)""")
def no_repeated_questions(spark, sf):
    return apply_view(population(spark, sf), NO_REPEATED_QUESTIONS).eligible.select("source_row_index", "question_id_raw")


@query("p08_pair_support", SUPPORT_SQL + """
select e.source_row_index, e.model_a_id, e.model_b_id from eligible e
join support on l = least(model_a_id, model_b_id) and g = greatest(model_a_id, model_b_id) where n >= 50""")
def pair_support(spark, sf):
    view = apply_view(population(spark, sf), pair_support_view(50))
    return view.eligible.select("source_row_index", "model_a_id", "model_b_id")


@query("p09_language", BASE + """
select source_row_index, language_canonical from eligible where language_canonical = 'NATION_7'""")
def language(spark, sf):
    return apply_view(population(spark, sf), NATION).eligible.select("source_row_index", "language_canonical")


@query("p10_pair_support_audit", SUPPORT_SQL + """
select (select count(*) from eligible) eligible_rows, (select count(*) from support) qualifying_pair_count,
  (select count(*) from (select l from support union select g from support)) model_count""")
def support(spark, sf):
    return pair_support_audit(population(spark, sf))


@query("p11_repeated_audit", REPEATED_SQL + """
select (select count(*) from repeated) repeated_group_count,
  (select count(*) from eligible where question_id_raw in (select question_id_raw from repeated)) rows_excluded,
  (select max(n) from (select count(*) n from eligible where trim(question_id_raw) <> ''
    group by question_id_raw)) max_group_size""")
def repeated_audit(spark, sf):
    return apply_view(population(spark, sf), NO_REPEATED_QUESTIONS).support_audit


@query("p11_support_audit", " union all ".join(f"""
select * from ({SUPPORT_SQL} select {t} threshold, count(*) filter (n >= {t}) qualifying_pair_count,
  count(*) filter (n < {t}) excluded_pair_count, sum(n)::bigint eligible_rows,
  (select count(*) from (select l from support union select g from support)) model_count from support)"""
    for t in (10, 20, 50)))
def support_audits(spark, sf):
    base = population(spark, sf)
    first, *rest = [apply_view(base, pair_support_view(t)).support_audit for t in (10, 20, 50)]
    for frame in rest:
        first = first.unionByName(frame)
    return first


@query("p11_language_audit", BASE + """
select count(*) eligible_rows, (select count(*) from (
    select model_a_id from eligible where language_canonical = 'NATION_7'
    union select model_b_id from eligible where language_canonical = 'NATION_7')) model_count
from eligible where language_canonical = 'NATION_7'""")
def language_audit(spark, sf):
    return apply_view(population(spark, sf), NATION).support_audit


@query("p12_view_audit", REPEATED_SQL + """
select source_row_index, len(reasons) = 0 eligible, v.ok view_eligible,
  case when v.ok then '' else 'exclude_repeated_question_groups' end view_exclusion_reason
from (select *, len(reasons) = 0 and (question_id_raw is null
  or question_id_raw not in (select question_id_raw from repeated)) ok from audit) v""")
def view_audit(spark, sf):
    rows = apply_view(population(spark, sf), NO_REPEATED_QUESTIONS).audit
    return rows.select("source_row_index", "eligible", "view_eligible", "view_exclusion_reason")


@query("p12_view_summary", SUPPORT_SQL + """
select 'base_research_pair_support_ge50' population_id, 1 population_spec_version, 1 population_view_schema_version,
  'base_research' base_population_id, 2 base_population_spec_version,
  '{"pair_definition":"canonical_unordered_model_pair","support_count_stage":"before_estimator_outcome_filter",' ||
  '"support_measure":"eligible_battle_count","support_population":"base_research","threshold":50,"threshold_operator":">=",' ||
  '"view_type":"unordered_pair_support_threshold"}' "view", sum(n)::bigint input_rows,
  coalesce(sum(n) filter (n >= 50), 0)::bigint eligible_rows,
  coalesce(sum(n) filter (n < 50), 0)::bigint excluded_rows,
  round(coalesce(sum(n) filter (n >= 50), 0) / sum(n), 6) eligibility_rate from support""")
def view_summary(spark, sf):
    summary = apply_view(population(spark, sf), pair_support_view(50)).summary
    return summary.withColumn("eligibility_rate", F.round("eligibility_rate", 6))


@query("p13_registry", SUPPORT_SQL + """
select 'base_research_pair_support_ge10' population_id, coalesce(sum(n) filter (n >= 10), 0)::bigint "rows" from support
union all select 'base_research_pair_support_ge20', coalesce(sum(n) filter (n >= 20), 0)::bigint from support
union all select 'base_research_pair_support_ge50', coalesce(sum(n) filter (n >= 50), 0)::bigint from support
union all select 'base_research_no_repeated_qid', (select count(*) from eligible where question_id_raw is null
  or question_id_raw not in (select question_id_raw from eligible where trim(question_id_raw) <> ''
    group by 1 having count(*) > 1))
union all select 'base_research_language_en', (select count(*) from eligible where language_canonical = 'English')
union all select 'base_research_language_nation_7',
  (select count(*) from eligible where language_canonical = 'NATION_7')""")
def registry(spark, sf):
    """Rows of every registered view: all of them in one pass over the base population."""
    base = population(spark, sf)
    frames = [
        apply_view(base, view).summary.select("population_id", F.col("eligible_rows").alias("rows"))
        for view in REGISTRY.values()
    ]
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


_SIZES = " union all ".join(
    f"select '{name}' population_id, eligible_rows from ({summary_sql(name, **options)})"
    for name, options in (
        ("base_research", {}),
        ("legacy_score", {"legacy": True}),
        ("judge_cluster_research", {"judge": True}),
        ("language_research", {"language": True}),
    )
)


@query("p01_required_columns", f"select population_id, eligible_rows, true refuses_missing_columns from ({_SIZES})")
def required_columns(spark, sf):
    """Applying a population to a table without its flags fails; every registered population accepts ours."""
    rows = canonical_table(spark, sf)
    try:
        apply_population(rows.drop("timestamp_valid"), BASE_RESEARCH)
        refused = False
    except ValueError:
        refused = True
    marked = [apply_population(rows, spec).summary for spec in POPULATIONS.values()]
    first, *rest = marked
    for frame in rest:
        first = first.unionByName(frame)
    return first.select("population_id", "eligible_rows", F.lit(refused).alias("refuses_missing_columns"))
