"""Ranking robustness, run comparison and result tables.

All take long tables of replicate scores; the registered ones use score rates of hashed resamples, which SQL
computes too. Map columns are printed as text for the comparison.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairpref.catalog import query
from pairpref.catalog.storage import FILES_DIGEST, digest_of_page_files
from pairpref.catalog.uncertainty import PAIRS, PRIMARY, RUNS, SCORES, points, rounded, scores
from pairpref.fixtures import PROVENANCE
from pairpref.functions.identity import canonical_json
from pairpref.operators import compare, presentation, robustness
from pairpref.operators.bootstrap import rank_summary, score_intervals
from pairpref.operators.estimate import POLICIES

RUN_IDS = sorted(RUNS)
SIZES = SCORES + """,
sizes as (select run_id, count(distinct model_id) models, count(distinct replicate) n from scores group by 1)
"""
# A scores table with every fault the contract names, made from the good one.
_FAULTS = """,
faulty as (
  select run_id, replicate, model_id, case when replicate = 2 and model_id = (select min(model_id) from scores) then 'NaN'::double
      else score end score,
    case when replicate = 3 and "rank" = 1 then 0 when replicate = 4 and "rank" = 2 then 3 else "rank" end "rank"
  from scores)
"""


@query("r01_contract", SIZES + _FAULTS + """
select run_id, replicate, case when count(*) filter (isnan(score)) > 0 then 'IMPROPER_VALUE'
  when min("rank") <> 1 or max("rank") <> max(models) then 'RANK_OUT_OF_RANGE'
  when count(distinct "rank") <> max(models) then 'NOT_A_PERMUTATION' end violation
from faulty join sizes using (run_id) group by 1, 2 having violation is not null""")
def contract(spark, sf):
    rows = scores(spark, sf)
    first = rows.agg(F.min("model_id")).scalar()
    faulty = rows.withColumns({
        "score": F.when((F.col("replicate") == 2) & (F.col("model_id") == first), float("nan")).otherwise(F.col("score")),
        "rank": F.when((F.col("replicate") == 3) & (F.col("rank") == 1), 0)
        .when((F.col("replicate") == 4) & (F.col("rank") == 2), 3)
        .otherwise(F.col("rank")),
    })
    return robustness.contract_violations(faulty)


DISTRIBUTION = SIZES + """,
every as (select s.run_id, m.model_id, unnest(range(1, models + 1))::int "rank", n
  from sizes s join (select distinct run_id, model_id from scores) m using (run_id)),
dist as (select e.run_id, e.model_id, e."rank", count(s.model_id) "count", max(n) successful_replicates,
    count(s.model_id) / max(n) frequency
  from every e left join scores s on s.run_id = e.run_id and s.model_id = e.model_id and s."rank" = e."rank" group by 1, 2, 3)
"""


@query("r02_rank_distribution", DISTRIBUTION + """
select run_id, model_id, "rank", "count", successful_replicates, round(frequency, 6) frequency from dist""")
def distribution(spark, sf):
    return rounded(robustness.rank_distribution(scores(spark, sf)), "frequency")


TOPK = SIZES + """,
top as (select run_id, model_id, k, count(*) filter ("rank" <= k) included_count, count(*) successful_replicates
  from scores, (select unnest([1, 3, 5])::int k) group by 1, 2, 3)
"""


@query("r03_top_k", TOPK + """
select *, round(included_count / successful_replicates, 6) frequency from top""")
def top_k(spark, sf):
    return rounded(robustness.top_k_inclusion(scores(spark, sf)), "frequency")


@query("r03_too_few_models", SIZES + "select run_id, models from sizes where models < 30")
def too_few_models(spark, sf):
    return robustness.too_few_models(scores(spark, sf), 30)


@query("r04_pairwise_ordering", PAIRS + """
select *, round(gt_count / successful_replicates, 6) gt_frequency, round(eq_count / successful_replicates, 6) eq_frequency,
  round(lt_count / successful_replicates, 6) lt_frequency from duels""")
def pairwise(spark, sf):
    return rounded(robustness.pairwise_ordering(scores(spark, sf)), "gt_frequency", "eq_frequency", "lt_frequency")


INTERVALS = SIZES + """,
intervals as (select run_id, model_id, quantile_cont("rank", 0.025) lower_rank_quantile, quantile_cont("rank", 0.5) median_rank,
    quantile_cont("rank", 0.975) upper_rank_quantile, avg(("rank" = 1)::int) probability_rank_1 from scores group by 1, 2)
"""


@query("r05_rank_intervals", INTERVALS + """
select run_id, model_id, round(lower_rank_quantile, 6) lower_rank_quantile, round(median_rank, 6) median_rank,
  round(upper_rank_quantile, 6) upper_rank_quantile, round(probability_rank_1, 6) probability_rank_1 from intervals""")
def intervals(spark, sf):
    return rounded(robustness.rank_intervals(scores(spark, sf)), *robustness.INTERVAL_FIELDS)


@query("r05_interval_bounds", INTERVALS + """
select run_id, model_id from intervals where upper_rank_quantile > 10""")
def interval_bounds(spark, sf):
    """Against a too small model count the intervals that reach beyond it are reported."""
    found = robustness.rank_intervals(scores(spark, sf))
    sizes = found.select("run_id").distinct().withColumn("models", F.lit(10))
    return robustness.interval_violations(found, sizes)


ADJACENT = SCORES + """,
near as (select "rank" hi, model_id h, lead(model_id) over (order by "rank") l from points where run_id = 'primary'),
adjacent as (select hi primary_rank_higher, hi + 1 primary_rank_lower, h higher_model_id, l lower_model_id,
    count(*) filter (a."rank" < b."rank") support_count, count(*) filter (b."rank" < a."rank") reversal_count,
    count(*) successful_replicates
  from near join scores a on a.run_id = 'primary' and a.model_id = h
    join scores b on b.run_id = 'primary' and b.model_id = l and b.replicate = a.replicate group by 1, 2, 3, 4)
"""


@query("r06_adjacent_reversals", ADJACENT + """
select *, round(support_count / successful_replicates, 6) support_frequency,
  round(reversal_count / successful_replicates, 6) reversal_frequency from adjacent""")
def adjacent(spark, sf):
    rows = robustness.adjacent_reversals(points(spark, sf), scores(spark, sf), PRIMARY)
    return rounded(rows, "support_frequency", "reversal_frequency")


CROSS = SCORES + """,
firsts as (select model_id, "rank" primary_rank from points where run_id = 'primary'),
crossed as (select model_id, primary_rank, string_agg(run_id || ':' || "rank", ',' order by run_id) rank_by_run,
    string_agg(run_id || ':' || ("rank" - primary_rank), ',' order by run_id) primary_relative_shift_by_run,
    min("rank") minimum_observed_rank, max("rank") maximum_observed_rank,
    max(abs("rank" - primary_rank)) maximum_absolute_rank_shift, count(*) filter ("rank" <= 1) top_1_specification_count,
    count(*) filter ("rank" <= 3) top_3_specification_count, count(*) filter ("rank" <= 5) top_5_specification_count,
    count(*) specification_count from points join firsts using (model_id) group by 1, 2)
"""


def _printed_map(name):
    entry = lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))
    return F.array_join(F.transform(F.map_entries(name), entry), ",")


def _printed(df, *names):
    return df.withColumns({name: _printed_map(name) for name in names})


@query("r07_cross_specification", CROSS + "select * from crossed")
def cross(spark, sf):
    return _printed(robustness.cross_specification(points(spark, sf), PRIMARY), "rank_by_run", "primary_relative_shift_by_run")


def _identity_sql() -> str:
    """Both ids written out as the canonical JSON they hash, with the digest of the study's files in its place."""
    mark = "@" * 64
    derivation = robustness.Derivation(PROVENANCE.snapshot_id, "study", mark, tuple(RUN_IDS), PRIMARY)
    spec = "sha256('" + canonical_json(derivation.payload(), ascii_only=True).replace(mark, "' || digest || '") + "')"
    instance = canonical_json(robustness.instance_payload(mark, "a" * 40), ascii_only=True).replace(mark, "' || spec || '")
    return FILES_DIGEST + f"""
select spec derivation_spec_id, sha256('{instance}') artifact_instance_id from (select {spec} spec from digests)"""


@query("r08_identities", _identity_sql())
def identities(spark, sf):
    """Derivation and artifact ids of a study whose payload are files written from the pages."""
    digest = digest_of_page_files(spark, sf).first()["digest"]
    derivation = robustness.Derivation(PROVENANCE.snapshot_id, "study", digest, tuple(RUN_IDS), PRIMARY)
    ids = [(derivation.derivation_spec_id, derivation.artifact_instance_id("a" * 40))]
    return spark.createDataFrame(ids, "derivation_spec_id string, artifact_instance_id string")


_COUNTED = """
select 'rank_distributions' metric, sum(models * models)::bigint "rows" from sizes
union all select 'top_k', sum(models * 3)::bigint from sizes
union all select 'pairwise_ordering', sum(models * (models - 1) // 2)::bigint from sizes
union all select 'rank_intervals', sum(models)::bigint from sizes
union all select 'adjacent_reversals', (models - 1)::bigint from sizes where run_id = 'primary'
union all select 'cross_specification', models::bigint from sizes where run_id = 'primary'"""


def _union(frames):
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


@query("r09_all_metrics", SIZES + _COUNTED)
def all_metrics(spark, sf):
    metrics = robustness.derive_metrics(points(spark, sf), scores(spark, sf), PRIMARY)
    return _union([
        frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("metric"), "rows")
        for name, frame in metrics.items()
    ])


@query("r10_completeness", SIZES + f"""
select metric, "rows" expected_keys, "rows", 0::bigint missing, 0::bigint unexpected, 0::bigint repeated from ({_COUNTED})""")
def complete(spark, sf):
    where = points(spark, sf)
    metrics = robustness.derive_metrics(where, scores(spark, sf), PRIMARY)
    return _union([
        robustness.completeness(
            robustness.expected_keys(where, name, PRIMARY), frame, robustness.METRIC_KEYS[name]
        ).withColumn("metric", F.lit(name))
        for name, frame in metrics.items()
    ])


@query("r11_record_checks", TOPK + """
select run_id, model_id, k from top where k = 3 and included_count > 0""")
def record_checks(spark, sf):
    """Shares of k = 3 halved: just those records contradict their counts."""
    rows = robustness.top_k_inclusion(scores(spark, sf))
    bent = rows.withColumn("frequency", F.when(F.col("k") == 3, F.col("frequency") / 2).otherwise(F.col("frequency")))
    return robustness.record_violations("top_k", bent).select("run_id", "model_id", "k")


@query("r11_all_records_consistent", SIZES + """
select metric, 0::bigint violations from (""" + _COUNTED + ")")
def records_consistent(spark, sf):
    metrics = robustness.derive_metrics(points(spark, sf), scores(spark, sf), PRIMARY)
    return _union([
        robustness.record_violations(name, frame).agg(F.count(F.lit(1)).alias("violations")).withColumn("metric", F.lit(name))
        for name, frame in metrics.items()
    ])


@query("r12_summary_agreement", INTERVALS + """
select run_id, model_id, round(probability_rank_1, 6) frequency from intervals where probability_rank_1 > 0""")
def summary_agreement(spark, sf):
    """Against a summary whose probabilities were set to zero, every model with a first place disagrees."""
    rows = scores(spark, sf)
    zeroed = robustness.rank_intervals(rows).withColumn("probability_rank_1", F.lit(0.0))
    found = robustness.summary_disagreements(robustness.top_k_inclusion(rows), zeroed)
    return rounded(found.select("run_id", "model_id", "frequency"), "frequency")


@query("r13_recomputation", TOPK + """
select side, run_id, model_id, k, included_count + case side when 'right' then 1 else 0 end included_count
from top, (select unnest(['left', 'right']) side) where k = 5 and run_id = 's2'""")
def recomputation(spark, sf):
    """Two tables that differ in the k = 5 counts of one run: both versions of those rows come out."""
    rows = robustness.top_k_inclusion(scores(spark, sf)).select("run_id", "model_id", "k", "included_count")
    touched = (F.col("k") == 5) & (F.col("run_id") == "s2")
    other = rows.withColumn("included_count", F.col("included_count") + F.when(touched, 1).otherwise(0))
    return robustness.differences(rows, other)


BESIDE = SCORES + """,
beside as (select p.run_id, p.model_id, p."rank", p.score, b."rank" b, b.score bs from points p
  join points b on b.run_id = 'primary' and b.model_id = p.model_id where p.run_id <> 'primary')
"""


@query("k01_displacement", BESIDE + """
select run_id, max(abs("rank" - b)) max_absolute_displacement, round(avg(abs("rank" - b)), 6) mean_absolute_displacement
from beside group by 1""")
def displacement(spark, sf):
    return rounded(compare.displacement(points(spark, sf), PRIMARY), "mean_absolute_displacement")


@query("k02_spearman", BESIDE + """select run_id, round(corr("rank"::double, b::double), 6) spearman_rho from beside group by 1""")
def spearman(spark, sf):
    return rounded(compare.spearman(points(spark, sf), PRIMARY), "spearman_rho")


@query("k03_top_agreement", BESIDE + """
select run_id, bool_or("rank" = 1 and b = 1) same_top_1, count(*) filter ("rank" <= 4 and b <= 4) top_4_overlap,
  bool_and("rank" = b) filter (b <= 4) top_4_order_preserved from beside group by 1""")
def top_agreement(spark, sf):
    return compare.top_agreement(points(spark, sf), PRIMARY)


@query("k04_score_shift", BESIDE + """
select run_id, model_id, case run_id when 's1' then 'same_estimator_parameterization_only'
    else 'latent_scores_not_comparable_with_primary' end comparability,
  case run_id when 's1' then round(score - bs, 6) end score_shift from beside""")
def score_shift(spark, sf):
    """The second run is declared to share the primary's scale, the third is not."""
    described = [(PRIMARY, "rate", "p"), ("s1", "rate", "p"), ("s2", "rate", POLICIES["bradley_terry_decisive"][0])]
    runs = spark.createDataFrame(described, "run_id string, estimator string, outcome_policy string")
    return rounded(compare.score_shift(points(spark, sf), runs, PRIMARY), "score_shift")


@query("k05_pairwise_change", PAIRS + """
select d.run_id, d.left_model_id, d.right_model_id,
  round(d.gt_count / d.successful_replicates - b.gt_count / b.successful_replicates, 6) gt_frequency_change,
  round(d.eq_count / d.successful_replicates - b.eq_count / b.successful_replicates, 6) eq_frequency_change,
  round(d.lt_count / d.successful_replicates - b.lt_count / b.successful_replicates, 6) lt_frequency_change
from duels d join duels b on b.run_id = 'primary' and b.left_model_id = d.left_model_id and b.right_model_id = d.right_model_id
where d.run_id <> 'primary'""")
def pairwise_change(spark, sf):
    change = compare.pairwise_change(robustness.pairwise_ordering(scores(spark, sf)), PRIMARY)
    return rounded(change, *[c for c in change.columns if c.endswith("_change")])


@query("k05_distribution_change", DISTRIBUTION + """
select d.run_id, d.model_id, d."rank", round(d.frequency - b.frequency, 6) frequency_change from dist d
join dist b on b.run_id = 'primary' and b.model_id = d.model_id and b."rank" = d."rank" where d.run_id <> 'primary'""")
def distribution_change(spark, sf):
    change = compare.distribution_change(robustness.rank_distribution(scores(spark, sf)), PRIMARY)
    return rounded(change, "frequency_change")


RESULTS = INTERVALS + """,
bounds as (select run_id, model_id, quantile_cont(score, 0.025) lo, quantile_cont(score, 0.975) hi from scores group by 1, 2),
results as (select run_id, model_id, p."rank" point_rank, p.score point_score, lo score_ci_low, hi score_ci_high,
    median_rank rank_median, lower_rank_quantile rank_ci_low, upper_rank_quantile rank_ci_high, probability_rank_1
  from points p join bounds using (run_id, model_id) join intervals using (run_id, model_id))
"""
_NUMBERS = ("point_score", "score_ci_low", "score_ci_high", "rank_median", "rank_ci_low", "rank_ci_high", "probability_rank_1")


def results(spark, sf):
    rows = scores(spark, sf)
    by = ("run_id",)
    return presentation.model_results(points(spark, sf), score_intervals(rows, by=by), rank_summary(rows, by=by))


@query("t01_model_results", RESULTS + "select run_id, model_id, point_rank, "
       + ", ".join(f"round({n}, 6) {n}" for n in _NUMBERS) + " from results")
def model_results(spark, sf):
    return rounded(results(spark, sf), *_NUMBERS)


@query("t01_result_bounds", RESULTS + """
select run_id, model_id from results where score_ci_low + 0.05::double > score_ci_high""")
def result_bounds(spark, sf):
    """With the lower bounds raised, the narrow intervals cross and are reported."""
    bent = results(spark, sf).withColumn("score_ci_low", F.col("score_ci_low") + 0.05)
    return presentation.result_violations(bent)


ROWS = CROSS + """,
rows_ as (select run_id, primary_rank, model_id, "rank" point_rank, "rank" - primary_rank rank_delta_vs_primary
  from points join firsts using (model_id))
"""


@query("t02_robustness_rows", ROWS + "select * from rows_")
def robustness_rows(spark, sf):
    return presentation.robustness_rows(points(spark, sf), PRIMARY)


@query("t02_model_universe", SCORES + """
select run_id, model_id, 'missing' difference from points where run_id = 's2' and "rank" > 20""")
def model_universe(spark, sf):
    thinned = points(spark, sf).where((F.col("run_id") != "s2") | (F.col("rank") <= 20))
    return presentation.universe_differences(thinned, PRIMARY)


@query("t03_subgroup_rows", ROWS + """
select primary_rank, model_id, point_rank s6_rank, rank_delta_vs_primary rank_delta from rows_ where run_id = 's2'""")
def subgroup_rows(spark, sf):
    return presentation.subgroup_rows(points(spark, sf), PRIMARY, "s2")


def _provenance(spark, sf):
    run = scores(spark, sf).where(F.col("run_id") == PRIMARY).agg(
        F.count(F.lit(1)).alias("score_rows"), F.count_distinct("model_id").alias("models")
    )
    run = run.withColumns({"run_id": F.lit(PRIMARY), "estimator": F.lit(RUNS[PRIMARY])})
    return presentation.provenance_rows(run, ["run_id", "estimator", "models", "score_rows"])


@query("t04_provenance", SIZES + """
select 'run_id' field, 'primary' "value" from sizes where run_id = 'primary' union all select 'estimator', 'davidson' from sizes where run_id = 'primary'
union all select 'models', models::varchar from sizes where run_id = 'primary'
union all select 'score_rows', (models * n)::varchar from sizes where run_id = 'primary'""")
def provenance(spark, sf):
    return _provenance(spark, sf)


@query("t05_delta_matrix", ROWS + "select model_id, primary_rank, " + ", ".join(
    f"max(rank_delta_vs_primary) filter (run_id = '{r}') \"{r}\"" for r in RUN_IDS) + " from rows_ group by 1, 2")
def delta_matrix(spark, sf):
    return presentation.delta_matrix(presentation.robustness_rows(points(spark, sf), PRIMARY), RUN_IDS)


@query("t06_table_checks", ROWS + "select distinct run_id from rows_ where run_id = 's1'")
def table_checks(spark, sf):
    """One run with deltas off by one is the one reported."""
    rows = presentation.robustness_rows(points(spark, sf), PRIMARY)
    shift = F.when(F.col("run_id") == "s1", 1).otherwise(0)
    return presentation.table_violations(rows.withColumn("rank_delta_vs_primary", F.col("rank_delta_vs_primary") + shift))


def _published_provenance(spark, sf):
    """Every field of the published provenance table; identities of stored files stand for those of one study."""
    run = scores(spark, sf).where(F.col("run_id") == PRIMARY).agg(F.count(F.lit(1)).alias("score_rows"))
    digest = lambda name: F.sha2(F.concat_ws("|", F.lit(name), F.col("score_rows").cast("string")), 256)
    known = {
        "source_dataset": F.lit(PROVENANCE.source_dataset), "source_revision": F.lit(PROVENANCE.source_revision),
        "source_snapshot_id": F.lit(PROVENANCE.snapshot_id), "bundle_name": F.lit("study"), "primary_run_id": F.lit(PRIMARY), "s6_run_id": F.lit("s2"),
    }
    fields = [name for names in presentation.PROVENANCE_FIELDS.values() for name in names]
    return presentation.provenance_rows(run.withColumns({name: known.get(name, digest(name)) for name in fields}), fields)


def publication(spark, sf):
    where = points(spark, sf)
    labels = spark.createDataFrame(
        [(run, i, label) for i, (run, label) in enumerate((("primary", "Primary"), ("s1", "S1"), ("s2", "S2")))],
        "run_id string, analysis_no int, analysis_label string",
    )
    return presentation.publication_tables(
        results(spark, sf),
        presentation.robustness_rows(where, PRIMARY),
        presentation.subgroup_rows(where, PRIMARY, "s2"),
        _published_provenance(spark, sf),
        labels,
        PRIMARY,
    )


_LABEL = "case run_id when 'primary' then 'Primary' else upper(run_id) end"


@query("t07_publication_tables", ROWS + f"""
select {_LABEL} analysis_label, primary_rank, model_id, point_rank from rows_""")
def publication_tables(spark, sf):
    return publication(spark, sf)["robustness-ranks"]


@query("t08_display", RESULTS + """
select point_rank::varchar point_rank, model_id, """ + ", ".join(
    f"round_even({n}::varchar::decimal(38, 18), 6)::decimal(38, 6)::varchar {n}" for n in _NUMBERS
) + " from results where run_id = 'primary'")
def display(spark, sf):
    return presentation.displayed("primary-results", publication(spark, sf)["primary-results"])


_CROSS_CELLS = ROWS + f""",
cells as (select 'robustness.point_ranks' claim_id, 'robustness-ranks' table_id, {_LABEL} || ':model:' || model_id row_id,
  unnest(['analysis_label', 'primary_rank', 'model_id', 'point_rank']) column_id,
  unnest([{_LABEL}, primary_rank::varchar, model_id, point_rank::varchar]) expected_value from rows_)
"""


@query("t09_cell_lineage", _CROSS_CELLS + "select * from cells")
def lineage(spark, sf):
    return presentation.cell_lineage(publication(spark, sf)).where("claim_id = 'robustness.point_ranks'")


@query("t09_lineage_counts", SIZES + """
select claim_id, n::bigint cells from (
  select 'primary.top_three' claim_id, 6 n from sizes where run_id = 'primary'
  union all select 'primary.score_uncertainty', models * 4 from sizes where run_id = 'primary'
  union all select 'primary.rank_uncertainty', models * 6 from sizes where run_id = 'primary'
  union all select 'robustness.point_ranks', sum(models) * 4 from sizes
  union all select 's6.rank_comparison', models * 3 from sizes where run_id = 's2'
  union all select unnest(['provenance.e0_identity', 'provenance.e1_identity', 'provenance.e2_identity']), unnest([8, 8, 6])
    from sizes where run_id = 'primary')""")
def lineage_counts(spark, sf):
    return presentation.cell_lineage(publication(spark, sf)).groupBy("claim_id").agg(F.count(F.lit(1)).alias("cells"))


@query("t10_lineage_check", _CROSS_CELLS + """
select claim_id, row_id, column_id, expected_value from cells where column_id = 'point_rank' and expected_value = '1'""")
def lineage_check(spark, sf):
    """A printed table with every first rank changed: just those bound cells no longer hold."""
    tables = publication(spark, sf)
    bound = presentation.cell_lineage(tables)
    tables["robustness-ranks"] = tables["robustness-ranks"].withColumn(
        "point_rank", F.when(F.col("point_rank") == 1, 99).otherwise(F.col("point_rank")))
    wrong = presentation.lineage_mismatches(bound, presentation.table_cells(tables))
    return wrong.select("claim_id", "row_id", "column_id", "expected_value")


@query("t10_row_claims", RESULTS + """
select 'model:' || model_id row_id, case when point_rank <= 3 then 'primary.rank_uncertainty,primary.score_uncertainty,primary.top_three'
  else 'primary.rank_uncertainty,primary.score_uncertainty' end claims from results where run_id = 'primary'""")
def row_claims(spark, sf):
    claims = presentation.row_claims(presentation.cell_lineage(publication(spark, sf)))
    return claims.where("table_id = 'primary-results'").select("row_id", "claims")


@query("t11_selections", ROWS + """
select 'top 5' selection, model_id, point_rank from rows_ where run_id = 'primary' and point_rank <= 5
union all select 'one model', model_id, point_rank from rows_ where model_id = 'Brand#1'
union all select 'one run', model_id, point_rank from rows_ where run_id = 's1'""")
def selections(spark, sf):
    main = results(spark, sf).where(F.col("run_id") == PRIMARY)
    rows = presentation.robustness_rows(points(spark, sf), PRIMARY)
    named = lambda df, name: df.select(F.lit(name).alias("selection"), "model_id", "point_rank")
    return _union([
        named(presentation.select_primary_rows(main, top_n=5), "top 5"),
        named(presentation.select_robustness_rows(rows, model_id="Brand#1"), "one model"),
        named(presentation.select_robustness_rows(rows, run_id="s1"), "one run"),
    ])


@query("t12_markdown", ROWS + f"""
select '| ' || {_LABEL} || ' | ' || primary_rank || ' | ' || model_id || ' | ' || point_rank || ' |' line from rows_""")
def markdown(spark, sf):
    return presentation.markdown_lines("robustness-ranks", publication(spark, sf)["robustness-ranks"])
