"""Paired-comparison estimation.

A fit is checked by its optimum: expected points and ties of every model equal the observed ones exactly when
the gradient is zero, and the observed ones are plain SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairpref.catalog import query
from pairpref.catalog.descriptive import statistics
from pairpref.catalog.tables import CANONICAL, LEADERBOARD, canonical_table, population, population_sql
from pairpref.operators.estimate import (
    outcome_counts,
    POLICIES,
    EstimatorConfig,
    count_cells,
    dense_ranks,
    diagnostics,
    dropped_models,
    expected_points,
    fit,
    gauge_check,
    input_violations,
    likelihood_rows,
    tie_support,
)
from pairpref.operators.graph import graph_facts, strongly_connected
from pairpref.operators.largefit import fit_large
from pairpref.session import cut

BASE = population_sql()
DAVIDSON = EstimatorConfig("davidson")
COALESCED = EstimatorConfig("davidson_coalesced_ties")
DECISIVE = EstimatorConfig("bradley_terry_decisive")
LANGUAGE = ("language_canonical",)


def _eligible(spark, sf):
    return population(spark, sf).eligible


def _by_language(spark, sf):
    return _eligible(spark, sf).where(F.col("language_canonical").isNotNull())


def observed_sql(outcomes: str, stratum: str = "") -> str:
    """Points W + T/2 per model and the ties of all models, optionally per stratum."""
    key = f"{stratum}, " if stratum else ""
    where = f"where canonical_outcome in ({outcomes})" + (f" and {stratum} is not null" if stratum else "")
    return f"""{BASE},
sides as (
  select {key}model_a_id model_id, canonical_outcome = 'model_a_win' won, canonical_outcome like 'tie%' tied
  from eligible {where}
  union all
  select {key}model_b_id, canonical_outcome = 'model_b_win', canonical_outcome like 'tie%' from eligible {where})
select {key}model_id, (sum(won::int) + 0.5 * sum(tied::int))::double points from sides group by {key}model_id
union all
select {key}'(all ties)', (sum(tied::int) / 2)::double from sides {f"group by {stratum}" if stratum else ""}"""


def _points(battles, fits, config, by=(), digits=3):
    """Expected points of every model and, under a name of their own, all expected ties."""
    points = expected_points(count_cells(battles, by), fits, config, by)
    ties = points.groupBy(*by).agg((F.sum("ties") / 2).alias("points"))
    ties = ties.select(*by, F.lit("(all ties)").alias("model_id"), "points")
    rows = points.drop("ties").unionByName(ties)
    return rows.withColumn("points", F.round("points", digits))


@query("e01_input_check", CANONICAL + """
select count(*) filter (not model_fields_valid) invalid_model_ids,
  count(*) filter (model_a_id = model_b_id) self_comparisons,
  count(*) filter (canonical_outcome = 'invalid_unknown') invalid_outcomes,
  case when count(*) filter (not model_fields_valid) > 0 then 'INVALID_MODEL_ID'
    when count(*) filter (model_a_id = model_b_id) > 0 then 'SELF_COMPARISON'
    when count(*) filter (canonical_outcome = 'invalid_unknown') > 0 then 'INVALID_OUTCOME' else 'OK' end code
from canon""")
def input_check(spark, sf):
    return input_violations(canonical_table(spark, sf))


_POLICY_SQL = " union all ".join(
    f"select '{name}' estimator, '{policy}' outcome_policy,"
    f" case when canonical_outcome = 'tie_bothbad' then 'tie' else canonical_outcome end outcome, count(*) \"rows\""
    f" from eligible where canonical_outcome in ({', '.join(repr(o) for o in outcomes)}) group by 1, 2, 3"
    for name, (policy, outcomes) in POLICIES.items()
)


@query("e02_outcome_policies", BASE + _POLICY_SQL)
def outcome_policies(spark, sf):
    cells = count_cells(_eligible(spark, sf))
    frames = []
    for name, (policy, _) in POLICIES.items():
        counts = likelihood_rows(cells, EstimatorConfig(name)).groupBy(F.col("canonical_outcome").alias("outcome"))
        frames.append(counts.agg(F.sum("n").alias("rows")).select(
            F.lit(name).alias("estimator"), F.lit(policy).alias("outcome_policy"), "outcome", "rows"))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("e03_cells", BASE + """
select model_a_id, model_b_id, canonical_outcome, count(*) n from eligible group by 1, 2, 3""")
def cells(spark, sf):
    return count_cells(_eligible(spark, sf))


# A stratum small enough that a policy can lose a model: one month of one language.
_MONTHLY = ("stratum",)


def _monthly(spark, sf):
    stratum = F.concat_ws("/", "language_canonical", "battle_month_utc")
    return _by_language(spark, sf).withColumn("stratum", stratum)


@query("e04_dropped_models", BASE + """,
s as (select *, language_canonical || '/' || strftime(timestamp_utc, '%Y-%m') stratum from eligible
  where language_canonical is not null)
select stratum, model_id from (
  select stratum, model_a_id model_id from s union select stratum, model_b_id from s)
except
select stratum, model_id from (
  select stratum, model_a_id model_id from s where canonical_outcome in ('model_a_win', 'model_b_win')
  union select stratum, model_b_id from s where canonical_outcome in ('model_a_win', 'model_b_win'))""")
def guards(spark, sf):
    return dropped_models(count_cells(_monthly(spark, sf), _MONTHLY), DECISIVE, _MONTHLY)


_MONTH_GRAPH = BASE + """,
s as (select *, language_canonical || '/' || strftime(timestamp_utc, '%Y-%m') stratum from eligible
  where language_canonical is not null),
nodes as (select stratum, model_a_id node from s union select stratum, model_b_id from s),
"""


@query("e05_components", _MONTH_GRAPH + """
edges as (select stratum, model_a_id u, model_b_id v from s union select stratum, model_b_id, model_a_id from s),
reached as (
  with recursive walk as (
    select stratum, node, node origin from nodes
    union select e.stratum, e.v, w.origin from walk w join edges e on e.stratum = w.stratum and e.u = w.node)
  select stratum, node, min(origin) component from walk group by 1, 2)
select stratum, count(*) node_count, (select count(*) // 2 from edges e where e.stratum = r.stratum) edge_count,
  count(distinct component) component_count from reached r group by stratum""")
def connected_components(spark, sf):
    return graph_facts(count_cells(_monthly(spark, sf), _MONTHLY), list(_MONTHLY))


def _strong_sql(arcs: str) -> str:
    return _MONTH_GRAPH.replace("nodes as (", "l as (" + arcs + "),\nnodes as (").replace(
        "select stratum, model_a_id node from s union select stratum, model_b_id from s",
        "select stratum, u node from l union select stratum, v from l") + """
starts as (select stratum, min(node) node from nodes group by 1),
forward as (
  with recursive walk as (select stratum, node from starts
    union select a.stratum, a.v from walk w join l a on a.stratum = w.stratum and a.u = w.node)
  select stratum, count(*) n from walk group by 1),
backward as (
  with recursive walk as (select stratum, node from starts
    union select a.stratum, a.u from walk w join l a on a.stratum = w.stratum and a.v = w.node)
  select stratum, count(*) n from walk group by 1)
select stratum, count(*) node_count, max(f.n) forward_count, max(b.n) backward_count,
  max(f.n) = count(*) and max(b.n) = count(*) strongly_connected
from nodes join forward f using (stratum) join backward b using (stratum) group by stratum"""


_DECISIVE_ARCS = """
select distinct stratum, case canonical_outcome when 'model_a_win' then model_a_id else model_b_id end u,
  case canonical_outcome when 'model_a_win' then model_b_id else model_a_id end v from s
where canonical_outcome in ('model_a_win', 'model_b_win')"""
_TIE_ARCS = _DECISIVE_ARCS + """
union select stratum, model_a_id, model_b_id from s where canonical_outcome = 'tie'
union select stratum, model_b_id, model_a_id from s where canonical_outcome = 'tie'"""


@query("e06_strong_decisive", _strong_sql(_DECISIVE_ARCS))
def strong_decisive(spark, sf):
    used = likelihood_rows(count_cells(_monthly(spark, sf), _MONTHLY), DECISIVE)
    return strongly_connected(used, list(_MONTHLY), ties=False)


@query("e07_strong_davidson", _strong_sql(_TIE_ARCS))
def strong_davidson(spark, sf):
    used = likelihood_rows(count_cells(_monthly(spark, sf), _MONTHLY), DAVIDSON)
    return strongly_connected(used, list(_MONTHLY), ties=True)


@query("e08_tie_identifiable", BASE + """,
s as (select *, language_canonical || '/' || strftime(timestamp_utc, '%Y-%m') stratum from eligible
  where language_canonical is not null and canonical_outcome <> 'tie_bothbad')
select stratum, count(*) filter (canonical_outcome = 'tie') ties, count(*) filter (canonical_outcome <> 'tie') decisive,
  count(*) filter (canonical_outcome = 'tie') > 0 and count(*) filter (canonical_outcome <> 'tie') > 0 identifiable
from s group by 1""")
def tie_identifiable(spark, sf):
    return tie_support(count_cells(_monthly(spark, sf), _MONTHLY), DAVIDSON, _MONTHLY)


@query("e09_bradley_terry", observed_sql("'model_a_win', 'model_b_win'"))
def bradley_terry(spark, sf):
    battles = _eligible(spark, sf)
    return _points(battles, fit(battles, DECISIVE), DECISIVE)


@query("e10_davidson", observed_sql("'model_a_win', 'model_b_win', 'tie'"))
def davidson(spark, sf):
    battles = _eligible(spark, sf)
    return _points(battles, fit(battles, DAVIDSON), DAVIDSON)


@query("e10_davidson_coalesced", observed_sql("'model_a_win', 'model_b_win', 'tie', 'tie_bothbad'"))
def davidson_coalesced(spark, sf):
    battles = _eligible(spark, sf)
    return _points(battles, fit(battles, COALESCED), COALESCED)


@query("e11_gauge", BASE + """
select language_canonical, 0.0::double score_sum from eligible where language_canonical is not null group by 1""")
def gauge(spark, sf):
    sums = gauge_check(fit(_by_language(spark, sf), DAVIDSON, LANGUAGE), LANGUAGE)
    return sums.withColumn("score_sum", F.abs(F.round("score_sum", 9)))


@query("e12_fit_by_language", observed_sql("'model_a_win', 'model_b_win', 'tie'", "language_canonical"))
def fit_by_language(spark, sf):
    battles = _by_language(spark, sf)
    return _points(battles, fit(battles, DAVIDSON, LANGUAGE), DAVIDSON, LANGUAGE)


@query("e13_large_bradley_terry", observed_sql("'model_a_win', 'model_b_win'"))
def large_bradley_terry(spark, sf):
    battles = _eligible(spark, sf)
    return _points(battles, fit_large(cut(count_cells(battles)), DECISIVE, {}), DECISIVE, digits=2)


@query("e13_large_davidson", observed_sql("'model_a_win', 'model_b_win', 'tie'"))
def large_davidson(spark, sf):
    battles = _eligible(spark, sf)
    return _points(battles, fit_large(cut(count_cells(battles)), DAVIDSON, {}), DAVIDSON, digits=2)


@query("e14_dense_ranks", LEADERBOARD + """
select model_name model_id, round(score_rate, 6) score, dense_rank() over (order by leaderboard.score_rate desc)::int "rank"
from leaderboard""")
def ranks(spark, sf):
    scores = statistics(spark, sf).select(F.col("model_name").alias("model_id"), F.col("score_rate").alias("score"))
    return dense_ranks(scores).withColumn("score", F.round("score", 6))


@query("e15_diagnostics", BASE + """,
u as (select language_canonical, model_a_id m from eligible where canonical_outcome <> 'tie_bothbad'
  union select language_canonical, model_b_id from eligible where canonical_outcome <> 'tie_bothbad')
select language_canonical, 'SUCCESS' status, (select count(*) from u where u.language_canonical = e.language_canonical) models,
  count(*) "rows", count(*) filter (canonical_outcome <> 'tie_bothbad') likelihood_rows,
  count(distinct least(model_a_id, model_b_id) || '|' || greatest(model_a_id, model_b_id))
    filter (canonical_outcome <> 'tie_bothbad') edges, 1 components
from eligible e where language_canonical is not null group by 1""")
def fit_diagnostics(spark, sf):
    fits = fit(_by_language(spark, sf), DAVIDSON, LANGUAGE)
    rows = diagnostics(fits, LANGUAGE).drop("iterations", "objective", "tie_parameter")
    return rows.withColumns({"models": F.col("models").cast("bigint"), "edges": F.col("edges").cast("bigint")})


@query("e15_outcome_counts", BASE + """
select language_canonical, outcome, count(*) filter (canonical_outcome = outcome) population,
  count(*) filter (case when canonical_outcome = 'tie_bothbad' then 'tie' else canonical_outcome end = outcome) likelihood, 0::bigint excluded
from eligible, (select unnest(['model_a_win', 'model_b_win', 'tie', 'tie_bothbad']) outcome)
where language_canonical is not null group by 1, 2""")
def counted_outcomes(spark, sf):
    """What each fit was handed, used and left out, by outcome, where all ties are one."""
    cells = cut(count_cells(_by_language(spark, sf), LANGUAGE))
    return outcome_counts(cells, EstimatorConfig("davidson_coalesced_ties"), LANGUAGE)
