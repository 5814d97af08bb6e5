"""Bootstrap.

Draws are hashes, so SQL recomputes every resample. Summaries that need fitted scores are checked on score
rates instead, which SQL can compute per replicate; they take the same long table.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairpref.catalog import query
from pairpref.catalog.tables import once, population, population_sql
from pairpref.operators.bootstrap import (
    BootstrapConfig,
    absent_models,
    failure_counts,
    formal_score_intervals,
    gate,
    hashed_cells,
    model_positions,
    pairwise_stability,
    rank_summary,
    resample,
    run_bootstrap,
    tie_interval,
    with_codes,
    with_names,
)
from pairpref.operators.estimate import POLICIES, count_cells, expected_points, likelihood_rows
from pairpref.operators.largefit import fit_many
from pairpref.operators.population import JUDGE_CLUSTER_RESEARCH
from pairpref.operators.resample import (
    blocked_multiplicities,
    cluster_violations,
    hashed_draws,
    multiplicities,
    numbered_units,
    unit_cells,
)
from pairpref.schema import A_WIN, B_WIN, BOTH_BAD, FORMAL_REPLICATES, TIE
from pairpref.session import stored

SEED, REPLICATES, FORMAL = 42, 20, FORMAL_REPLICATES
CONFIG = BootstrapConfig(REPLICATES, SEED, draws="hashed")
JUDGED = population_sql(judge=True)
PRIMARY = "primary"
# Runs of the checked study: the same resamples under the three outcome policies.
RUNS = {PRIMARY: "davidson", "s1": "davidson_coalesced_ties", "s2": "bradley_terry_decisive"}

DRAWS = f"""{JUDGED},
clusters as (select judge_cluster_id unit, row_number() over (order by judge_cluster_id) - 1 unit_no
  from (select distinct judge_cluster_id from eligible)),
g as (select count(*) n from clusters),
grid as (select r replicate, unnest(range(n)) d, n from g, (select unnest(range(1, {REPLICATES + 1})) r)),
draws as (select replicate, ('0x' || substr(md5('{SEED}|' || replicate || '|' || d), 1, 15))::bigint % n unit_no from grid),
mult as (select replicate, unit_no, count(*) multiplicity from draws group by 1, 2)
"""
DRAWN = f"""{DRAWS},
unit_cells as (select unit_no, model_a_id, model_b_id, canonical_outcome, count(*) n
  from eligible join clusters on unit = judge_cluster_id group by 1, 2, 3, 4),
drawn as (select replicate, model_a_id, model_b_id, canonical_outcome, sum(n * multiplicity)::bigint n
  from mult join unit_cells using (unit_no) group by 1, 2, 3, 4)
"""
_RUN_OUTCOMES = " union all ".join(
    f"select '{run}' run_id, unnest([{', '.join(repr(o) for o in POLICIES[e][1])}]) outcome" for run, e in RUNS.items()
)
SCORES = f"""{DRAWN},
policies as ({_RUN_OUTCOMES}),
all_cells as (select * from drawn union all
  select 0, model_a_id, model_b_id, canonical_outcome, count(*) from eligible group by 2, 3, 4),
sides as (
  select run_id, replicate, model_a_id model_id, n, case when canonical_outcome = 'model_a_win' then 1.0
    when canonical_outcome like 'tie%' then 0.5 else 0.0 end p from all_cells join policies on outcome = canonical_outcome
  union all
  select run_id, replicate, model_b_id, n, case when canonical_outcome = 'model_b_win' then 1.0
    when canonical_outcome like 'tie%' then 0.5 else 0.0 end from all_cells join policies on outcome = canonical_outcome),
rates as (select run_id, replicate, model_id, sum(n * p)::double / sum(n)::double score from sides group by 1, 2, 3),
ranked as (select *, row_number() over (partition by run_id, replicate order by score desc, model_id)::int "rank" from rates),
scores as (select * from ranked where replicate > 0),
points as (select run_id, model_id, score, "rank" from ranked where replicate = 0)
"""


def judged(spark, sf):
    return population(spark, sf, JUDGE_CLUSTER_RESEARCH).eligible


def drawn_cells(spark, sf):
    return once(spark, sf, "hashed-cells", lambda: hashed_cells(judged(spark, sf), CONFIG))


def ranked_rates(spark, sf):
    """(run_id, replicate, model_id, score, rank); replicate 0 is the full sample."""

    def build():
        whole = count_cells(judged(spark, sf)).withColumn("replicate", F.lit(0).cast("bigint"))
        cells = drawn_cells(spark, sf).unionByName(whole)
        runs = F.array(*[
            F.struct(F.lit(run).alias("run_id"), F.array(*[F.lit(o) for o in POLICIES[e][1]]).alias("outcomes"))
            for run, e in RUNS.items()
        ])
        per_run = cells.select("*", F.inline(runs)).where(F.array_contains("outcomes", F.col("canonical_outcome")))
        outcome = F.col("canonical_outcome")
        side = lambda model, win: F.struct(
            F.col(model).alias("model_id"),
            F.when(outcome == win, 1.0).when(outcome.isin(TIE, BOTH_BAD), 0.5).otherwise(0.0).alias("p"),
        )
        sides = per_run.select(
            "run_id", "replicate", "n", F.inline(F.array(side("model_a_id", A_WIN), side("model_b_id", B_WIN)))
        )
        rates = sides.groupBy("run_id", "replicate", "model_id").agg(
            (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("score")
        )
        best = Window.partitionBy("run_id", "replicate").orderBy(F.desc("score"), "model_id")
        return rates.withColumn("rank", F.row_number().over(best))

    return once(spark, sf, "ranked-rates", build)


def scores(spark, sf):
    return ranked_rates(spark, sf).where(F.col("replicate") > 0)


def points(spark, sf):
    return ranked_rates(spark, sf).where(F.col("replicate") == 0).drop("replicate")


def rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


@query("b01_unit_order", DRAWS + 'select unit, unit_no from clusters')
def unit_order(spark, sf):
    return numbered_units(unit_cells(judged(spark, sf), "judge_cluster"))


@query("b02_judge_check", population_sql() + """
select count(*) "rows", count(*) filter (coalesce(trim(judge_cluster_id), '') = '') invalid_judges from eligible""")
def judge_check(spark, sf):
    return cluster_violations(population(spark, sf).eligible)


@query("b03_cluster_cells", JUDGED + """
select judge_cluster_id unit, model_a_id, model_b_id, canonical_outcome, count(*) n from eligible group by 1, 2, 3, 4""")
def cluster_cells(spark, sf):
    return unit_cells(judged(spark, sf), "judge_cluster")


@query("b04_cluster_multiplicity", DRAWS + "select replicate, unit_no, multiplicity from mult")
def cluster_multiplicity(spark, sf):
    units = unit_cells(judged(spark, sf), "judge_cluster").select("unit").distinct().count()
    return multiplicities(hashed_draws(spark, units, REPLICATES, SEED))


@query("b04_cluster_resample", DRAWN + "select replicate, model_a_id, model_b_id, canonical_outcome, n from drawn")
def cluster_resample(spark, sf):
    return hashed_cells(judged(spark, sf), CONFIG)


@query("b04_blocked_draws", JUDGED + f"""
select r replicate, count(distinct judge_cluster_id) draws, 0::bigint differing_cells from eligible, (select unnest(range(1, {REPLICATES + 1})) r)
group by 1""")
def blocked_draws(spark, sf):
    """Blocks spend exactly G draws per replicate, and the cells of whole battles are those that the drawn judges have:
    both sides of a full join of the resample with a recomputation from the multiplicities."""
    battles = judged(spark, sf)
    ids = model_positions(count_cells(battles))
    cells = unit_cells(battles, "judge_cluster")
    coded = stored(with_codes(cells, ids))
    times = stored(blocked_multiplicities(coded, REPLICATES, SEED))
    again = times.join(coded, "unit").groupBy("replicate", "code").agg(F.sum(F.col("n") * F.col("multiplicity")).alias("again"))
    both = resample(battles, BootstrapConfig(REPLICATES, SEED), ids).join(again, ["replicate", "code"], "full_outer")
    wrong = both.groupBy("replicate").agg(F.count_if(~F.col("n").eqNullSafe(F.col("again"))).alias("differing_cells"))
    return times.groupBy("replicate").agg(F.sum("multiplicity").alias("draws")).join(wrong, "replicate", "left")


@query("b05_row_resample", JUDGED.rstrip() + f""",
n as (select battle, row_number() over (order by battle) - 1 unit_no, model_a_id, model_b_id, canonical_outcome
  from (select source_row_index battle, * from eligible)),
g as (select count(*) n from n),
grid as (select r replicate, unnest(range(n)) d, n from g, (select unnest(range(1, 4)) r)),
draws as (select replicate, ('0x' || substr(md5('{SEED}|' || replicate || '|' || d), 1, 15))::bigint % n unit_no from grid)
select replicate, count(*) draws, count(distinct unit_no) distinct_rows from draws group by 1""")
def row_resample(spark, sf):
    battles = judged(spark, sf).count()
    draws = multiplicities(hashed_draws(spark, battles, 3, SEED))
    return draws.groupBy("replicate").agg(F.sum("multiplicity").alias("draws"), F.count(F.lit(1)).alias("distinct_rows"))


@query("b05_row_cells", JUDGED + f""",
placed as (select model_a_id, model_b_id, canonical_outcome,
  row_number() over (order by model_a_id, model_b_id, canonical_outcome) - 1 unit_no from eligible),
g as (select count(*) n from eligible),
grid as (select r replicate, unnest(range(n)) d, n from g, (select unnest(range(1, 4)) r)),
draws as (select replicate, ('0x' || substr(md5('{SEED}|' || replicate || '|' || d), 1, 15))::bigint % n unit_no from grid)
select replicate, model_a_id, model_b_id, canonical_outcome, count(*) n from draws join placed using (unit_no) group by 1, 2, 3, 4""")
def row_cells(spark, sf):
    """Row resamples by recomputable draws, cell by cell: each draw is looked up in the prefix sums of the cells."""
    return hashed_cells(judged(spark, sf), BootstrapConfig(3, SEED, "battle_row", "hashed"))


@query("b05_row_multinomial", JUDGED + f"""
select r replicate, count(*) draws, true only_known_cells, true near_expected
from eligible, (select unnest(range(1, {REPLICATES + 1})) r) group by 1""")
def row_multinomial(spark, sf):
    """Cells of the blocked row bootstrap: N draws a replicate, in cells that exist, none far from its own count
    (six standard deviations of its binomial share)."""
    battles = judged(spark, sf)
    ids = model_positions(count_cells(battles))
    own = stored(with_codes(count_cells(battles), ids)).withColumnRenamed("n", "own")
    total = own.agg(F.sum("own").alias("total"))
    drawn = resample(battles, BootstrapConfig(REPLICATES, SEED, "battle_row"), ids)
    joined = drawn.join(own, "code", "left").withColumn("total", total.scalar())
    off = F.abs(F.col("n") - F.col("own")) <= 6 * F.sqrt(F.col("own") * (1 - F.col("own") / F.col("total"))) + 6
    return joined.groupBy("replicate").agg(
        F.sum("n").alias("draws"), F.bool_and(F.col("own").isNotNull()).alias("only_known_cells"), F.bool_and(off).alias("near_expected")
    )


@query("b06_absent_models", DRAWN + """,
small as (select * from drawn where canonical_outcome = 'tie_bothbad' and n > 3)
select r.replicate, m.model_id from (select unnest(range(1, 21)) replicate) r,
  (select model_a_id model_id from eligible union select model_b_id from eligible) m
except
select replicate, unnest([model_a_id, model_b_id]) from small""")
def absent(spark, sf):
    """Models a resample lost, on the thin part of it (cells of more than three bad ties)."""
    drawn = drawn_cells(spark, sf).where((F.col("canonical_outcome") == BOTH_BAD) & (F.col("n") > 3))
    return absent_models(drawn, count_cells(judged(spark, sf)), REPLICATES)


_EVERY_MODEL = f"""
select r.replicate, m.model_id from (select unnest(range(1, {REPLICATES + 1})) replicate) r,
  (select model_a_id model_id from eligible union select model_b_id from eligible) m"""


@query("b07_bootstrap", JUDGED + "select replicate, model_id, 0.0::double gradient from (" + _EVERY_MODEL + ")")
def bootstrap(spark, sf):
    """Every replicate is fitted and optimal: expected minus observed points vanish for each model."""
    boot = run_bootstrap(judged(spark, sf), CONFIG)
    return _gradients(drawn_cells(spark, sf), boot.fits, CONFIG.estimator)


def _gradients(cells, fits, estimator):
    """|expected - observed| points per (replicate, model) of fits over (replicate, cell, n)."""
    expected = expected_points(cells, fits, estimator, ("replicate",)).select("replicate", "model_id", "points")
    used, outcome = likelihood_rows(cells, estimator), F.col("canonical_outcome")
    side = lambda model, win: F.struct(
        F.col(model).alias("model_id"),
        (F.col("n") * F.when(outcome == win, 1.0).when(outcome == TIE, 0.5).otherwise(0.0)).alias("p"),
    )
    sides = used.select("replicate", F.inline(F.array(side("model_a_id", A_WIN), side("model_b_id", B_WIN))))
    observed = sides.groupBy("replicate", "model_id").agg(F.sum("p").alias("observed"))
    gap = F.abs(F.round(F.col("points") - F.col("observed"), 3)).alias("gradient")
    return expected.join(observed, ["replicate", "model_id"]).select("replicate", "model_id", gap)


@query("b07_blocked_bootstrap", JUDGED + "select replicate, model_id, 0.0::double gradient from (" + _EVERY_MODEL + ")")
def blocked_bootstrap(spark, sf):
    """The default engine end to end: every replicate of its draws is fitted and optimal."""
    battles, config = judged(spark, sf), BootstrapConfig(REPLICATES, SEED)
    boot = run_bootstrap(battles, config)
    ids = model_positions(count_cells(battles))
    return _gradients(stored(with_names(resample(battles, config, ids), ids)), boot.fits, config.estimator)


@query("b07_large_fits", JUDGED + "select replicate, model_id, 0.0::double gradient from (" + _EVERY_MODEL.replace(f"{REPLICATES + 1}", "3") + ")")
def large_fits(spark, sf):
    """Replicates fitted by the loop for many models, all in one, whatever the number of models here."""
    cells = stored(drawn_cells(spark, sf).where("replicate <= 2"))
    return _gradients(cells, fit_many(cells, CONFIG.estimator, ("replicate",)), CONFIG.estimator)


@query("b07_formal_bootstrap", JUDGED + f"""
select {FORMAL}::bigint attempted, {FORMAL}::bigint successful, 0::bigint failed, true formal_target_met, true formal_ci_valid, count(*) models
from (select model_a_id from eligible union select model_b_id from eligible)""")
def formal_bootstrap(spark, sf):
    """The formal number of attempts: none fails, the gate opens, and every model has an interval."""
    boot = run_bootstrap(judged(spark, sf), BootstrapConfig(FORMAL, SEED))
    found = formal_score_intervals(boot.scores, boot.statuses, FORMAL).where("score_ci_low <= score_ci_high")
    return boot.summary.withColumn("models", found.agg(F.count(F.lit(1)).alias("models")).scalar())


@query("b08_failure_counts", DRAWN + """,
lost as (
  select distinct replicate from (
    select r.replicate, m.model_id from (select unnest(range(1, 21)) replicate) r,
      (select model_a_id model_id from eligible union select model_b_id from eligible) m
    except select replicate, unnest([model_a_id, model_b_id]) from drawn
      where canonical_outcome = 'tie_bothbad' and n > 3))
select case when lost.replicate is null then 'SUCCESS' else 'MODEL_ABSENT' end status, count(*) replicates
from (select unnest(range(1, 21)) replicate) r left join lost using (replicate) group by 1""")
def failures(spark, sf):
    return failure_counts(_thin_statuses(spark, sf))


def _thin_statuses(spark, sf):
    """Statuses of the thin resamples of b06: some lose a model."""
    lost = absent(spark, sf).select("replicate").distinct().withColumn("lost", F.lit(True))
    every = spark.range(1, REPLICATES + 1).select(F.col("id").alias("replicate")).join(lost, "replicate", "left")
    status = F.when(F.col("lost"), "MODEL_ABSENT").otherwise("SUCCESS")
    return every.select("replicate", status.alias("status"))


@query("b09_formal_gate", DRAWN + f"""
select {REPLICATES}::bigint attempted, count(distinct replicate) successful, {REPLICATES} - count(distinct replicate) failed,
  false formal_target_met, false formal_ci_valid from drawn""")
def formal_gate(spark, sf):
    seen = drawn_cells(spark, sf).select("replicate").distinct().withColumn("status", F.lit("SUCCESS"))
    return gate(seen, REPLICATES)


@query("b10_score_intervals", SCORES + """
select run_id, model_id, round(quantile_cont(score, 0.025), 6) score_ci_low, round(quantile_cont(score, 0.975), 6) score_ci_high
from scores group by 1, 2""")
def intervals(spark, sf):
    rows = scores(spark, sf)
    statuses = rows.select("run_id", "replicate").distinct().withColumn("status", F.lit("SUCCESS"))
    found = formal_score_intervals(rows, statuses, REPLICATES, by=("run_id",))
    return rounded(found, "score_ci_low", "score_ci_high")


@query("b11_rank_summary", SCORES + """
select run_id, model_id, round(quantile_cont("rank", 0.025), 6) lower_rank_quantile, round(quantile_cont("rank", 0.5), 6) median_rank,
  round(quantile_cont("rank", 0.975), 6) upper_rank_quantile, round(avg(("rank" = 1)::int), 6) probability_rank_1
from scores group by 1, 2""")
def ranks(spark, sf):
    found = rank_summary(scores(spark, sf), by=("run_id",))
    return rounded(found, "lower_rank_quantile", "median_rank", "upper_rank_quantile", "probability_rank_1")


PAIRS = SCORES + """,
duels as (select l.run_id, l.model_id left_model_id, r.model_id right_model_id, count(*) filter (l.score - r.score > 1e-10) gt_count,
  count(*) filter (abs(l.score - r.score) <= 1e-10) eq_count, count(*) filter (l.score - r.score < -1e-10) lt_count,
  count(*) successful_replicates
  from scores l join scores r on l.run_id = r.run_id and l.replicate = r.replicate and l.model_id < r.model_id group by 1, 2, 3)
"""


@query("b12_pairwise_stability", PAIRS + """
select run_id, left_model_id, right_model_id, round(gt_count / successful_replicates, 6) gt_frequency,
  round(eq_count / successful_replicates, 6) eq_frequency, round(lt_count / successful_replicates, 6) lt_frequency from duels""")
def stability(spark, sf):
    return rounded(pairwise_stability(scores(spark, sf), ("run_id",)), "gt_frequency", "eq_frequency", "lt_frequency")


@query("b13_tie_interval", DRAWN + """,
t as (select replicate, sum(n) filter (canonical_outcome = 'tie')::double / sum(n)::double tie_parameter from drawn group by 1)
select round(quantile_cont(tie_parameter, 0.025), 6) tie_ci_low, round(quantile_cont(tie_parameter, 0.975), 6) tie_ci_high from t""")
def tie_parameter(spark, sf):
    """On the share of ties per replicate, which SQL has as well."""
    ties = F.sum(F.when(F.col("canonical_outcome") == TIE, F.col("n")).otherwise(0))
    shares = drawn_cells(spark, sf).groupBy("replicate").agg((ties / F.sum("n")).alias("tie_parameter"))
    return rounded(tie_interval(shares.withColumn("status", F.lit("SUCCESS"))), "tie_ci_low", "tie_ci_high")
