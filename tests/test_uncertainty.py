"""Bootstrap, robustness metrics, run store and report."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairpref.operators import presentation, robustness
from pairpref.operators.bootstrap import (
    BootstrapConfig,
    failure_counts,
    formal_score_intervals,
    gate,
    pairwise_counts,
    rank_summary,
    resample,
    run_bootstrap,
    score_intervals,
)
from pairpref.operators.canonical import Provenance
from pairpref.operators.estimate import EstimatorConfig
from pairpref.operators.population import BASE_RESEARCH
from pairpref.operators.resample import BootstrapError, numbered_units, unit_cells
from pairpref.plans.formal import RunConfig, canonical_snapshot, robustness_of, run_analysis, write_analysis
from pairpref.plans.legacy import descriptive_report, write_report
from pairpref.fixtures import PROVENANCE, battles_raw
from pairpref.schema import A_WIN, B_WIN, TIE
from pairpref.sources.files import compare_inventories, inventory, inventory_digest, read_csv
from pairpref.sources.runs import Manifest, RunError, load_runs, manifest_violations, read_runs, verify_runs

BATTLE = "battle_id string, judge_cluster_id string, model_a_id string, model_b_id string, canonical_outcome string"


def judged(spark, judges=6):
    rows = []
    for j in range(judges):
        for k, outcome in enumerate((A_WIN, A_WIN, B_WIN, TIE)):
            rows.append((f"{j}-{k}", f"judge-{j}", "alpha", "beta", outcome))
    return spark.createDataFrame(rows, BATTLE)


@pytest.mark.parametrize("draws", ["blocked", "hashed"])
def test_whole_clusters_are_drawn(spark, draws):
    cells = resample(judged(spark), BootstrapConfig(40, 5, draws=draws), ["alpha", "beta"])
    by = {}
    for row in cells.collect():
        by.setdefault(row["replicate"], {})[row["code"] % 4] = row["n"]
    assert len(by) == 40
    for counts in by.values():
        assert counts == {0: 12, 1: 6, 2: 6}  # six draws of a judge with 2 wins, 1 loss, 1 tie


@pytest.mark.parametrize(("unit", "draws"), [("judge_cluster", "blocked"), ("judge_cluster", "hashed"), ("battle_row", "blocked")])
def test_row_order_and_partitions_do_not_matter(spark, unit, draws):
    rows = judged(spark, 12)
    config = BootstrapConfig(15, 9, unit, draws)
    first, second = (
        {tuple(r) for r in resample(df, config, ["alpha", "beta"]).collect()}
        for df in (rows, rows.orderBy(F.desc("battle_id")).repartition(7))
    )
    assert first == second
    other = {tuple(r) for r in resample(rows, BootstrapConfig(15, 10, unit, draws), ["alpha", "beta"]).collect()}
    assert unit == "judge_cluster" or other != first


def test_row_resample_has_multinomial_moments(spark):
    rows = judged(spark, 50)
    cells = resample(rows, BootstrapConfig(400, 3, "battle_row"), ["alpha", "beta"]).collect()
    wins = np.array([r["n"] for r in cells if r["code"] % 4 == 0])
    assert len(wins) == 400 and abs(wins.mean() - 100) < 1.5
    assert 5.5 < wins.std() < 8.7  # sqrt(200 * .5 * .5) = 7.07


def test_blocked_multiplicities_have_the_right_spread(spark):
    rows = spark.range(300).select(
        F.col("id").cast("string").alias("battle_id"), F.concat(F.lit("j"), F.col("id")).alias("judge_cluster_id"),
        F.lit("alpha").alias("model_a_id"), F.lit("beta").alias("model_b_id"),
        F.when(F.col("id") < 150, A_WIN).otherwise(B_WIN).alias("canonical_outcome"),
    )
    cells = resample(rows, BootstrapConfig(400, 8), ["alpha", "beta"]).collect()
    wins = np.array([r["n"] for r in cells if r["code"] % 4 == 0])
    assert abs(wins.mean() - 150) < 1.7 and 7.2 < wins.std() < 10.2  # sqrt(75) = 8.66


def test_units_are_numbered_in_order(spark):
    rows = spark.range(1000).select(
        F.format_string("j%05d", F.col("id") * 7 % 1000).alias("judge_cluster_id"), F.lit("a").alias("model_a_id"),
        F.lit("b").alias("model_b_id"), F.lit(TIE).alias("canonical_outcome"),
    )
    found = numbered_units(unit_cells(rows, "judge_cluster")).orderBy("unit").collect()
    assert [r["unit_no"] for r in found] == list(range(1000))


def test_lost_models_fail_without_redraw(spark):
    rare = spark.createDataFrame([("x-0", "judge-x", "alpha", "gamma", A_WIN), ("x-1", "judge-x", "gamma", "alpha", A_WIN)], BATTLE)
    boot = run_bootstrap(judged(spark).unionByName(rare), BootstrapConfig(60, 1))
    counts = {r["status"]: r["replicates"] for r in failure_counts(boot.statuses).collect()}
    assert set(counts) == {"SUCCESS", "MODEL_ABSENT"} and sum(counts.values()) == 60
    summary = boot.summary.first()
    assert summary["failed"] == counts["MODEL_ABSENT"] and not summary["formal_ci_valid"]
    interval = formal_score_intervals(boot.scores, boot.statuses, 60).first()
    assert interval["score_ci_low"] is None
    assert score_intervals(boot.scores).first()["score_ci_low"] is not None


def test_bad_bootstrap_input(spark):
    with pytest.raises(BootstrapError) as error:
        run_bootstrap(judged(spark).drop("judge_cluster_id"), BootstrapConfig(3, 1))
    assert error.value.code == "MISSING_JUDGE_CLUSTER"
    with pytest.raises(BootstrapError) as error:
        run_bootstrap(judged(spark).withColumn("judge_cluster_id", F.lit(" ")), BootstrapConfig(3, 1))
    assert error.value.code == "INVALID_JUDGE_CLUSTER"
    with pytest.raises(BootstrapError) as error:
        run_bootstrap(judged(spark).where("false"), BootstrapConfig(3, 1))
    assert error.value.code == "BOOTSTRAP_INPUT_ERROR"
    with pytest.raises(BootstrapError) as error:
        run_bootstrap(judged(spark).where(F.col("canonical_outcome") == A_WIN), BootstrapConfig(3, 1))
    assert error.value.code == "POINT_ESTIMATE_FAILED" and "UNIDENTIFIABLE" in str(error.value)


def test_gate(spark):
    ok = spark.range(2000).select(F.lit("SUCCESS").alias("status"))
    assert gate(ok, 2000).first()["formal_ci_valid"]
    assert not gate(ok.limit(1999), 2000).first()["formal_ci_valid"]
    assert not gate(ok.limit(10), 10).first()["formal_target_met"]


SCORES = "run_id string, replicate long, model_id string, score double, rank int"


def ranks_of(spark, matrix, names="abcde"):
    rows = [("p", i + 1, names[j], float(-r), r) for i, row in enumerate(matrix) for j, r in enumerate(row)]
    return spark.createDataFrame(rows, SCORES)


def test_rank_summary_uses_linear_quantiles(spark):
    matrix = [[1, 2, 3], [1, 3, 2], [2, 1, 3], [1, 2, 2]]
    found = {r["model_id"]: r for r in rank_summary(ranks_of(spark, matrix)).collect()}
    for j, name in enumerate("abc"):
        low, mid, high = np.quantile([row[j] for row in matrix], [0.025, 0.5, 0.975])
        assert [found[name][k] for k in ("lower_rank_quantile", "median_rank", "upper_rank_quantile")] == pytest.approx([low, mid, high])
    assert found["a"]["probability_rank_1"] == 0.75


def test_pairwise_tolerance(spark):
    gaps = [0.0, 1e-10, -1e-10, 2e-10, -2e-10]
    rows = [("p", i, m, s, 1) for i, g in enumerate(gaps) for m, s in (("a", g), ("b", 0.0))]
    found = pairwise_counts(spark.createDataFrame(rows, SCORES), ("run_id",)).first()
    assert (found["gt_count"], found["eq_count"], found["lt_count"]) == (1, 3, 1)


PERMUTATIONS = [[1, 2, 3, 4, 5], [2, 1, 3, 4, 5], [1, 2, 3, 5, 4]]


def test_metrics_of_three_replicates(spark):
    scores = ranks_of(spark, PERMUTATIONS)
    points = scores.where("replicate = 1").drop("replicate")
    points = points.unionByName(ranks_of(spark, [[5, 4, 3, 2, 1]]).withColumn("run_id", F.lit("q")).drop("replicate"))
    metrics = robustness.derive_metrics(points, scores, "p")
    top = {(r["model_id"], r["k"]): r["included_count"] for r in metrics["top_k"].collect()}
    assert (top["a", 1], top["b", 1], top["e", 5], top["e", 3]) == (2, 1, 3, 0)
    adjacent = {r["primary_rank_higher"]: r["reversal_count"] for r in metrics["adjacent_reversals"].collect()}
    assert adjacent == {1: 1, 2: 0, 3: 0, 4: 1}
    cross = {r["model_id"]: r for r in metrics["cross_specification"].collect()}
    assert cross["a"]["rank_by_run"] == {"p": 1, "q": 5} and cross["a"]["maximum_absolute_rank_shift"] == 4
    assert metrics["rank_distributions"].count() == 25
    for name, frame in metrics.items():
        assert robustness.record_violations(name, frame).isEmpty(), name
    assert robustness.contract_violations(scores).isEmpty()
    bad = ranks_of(spark, [[1, 1, 3, 4, 5]])
    assert robustness.contract_violations(bad).first()["violation"] == "NOT_A_PERMUTATION"
    assert robustness.differences(metrics["top_k"], metrics["top_k"]).isEmpty()


def test_derivation_identity():
    one = robustness.Derivation("a" * 64, "b", "c" * 64, ("r1", "r2"), "r1")
    same = robustness.Derivation("a" * 64, "b", "c" * 64, ("r1", "r2"), "r1")
    other = robustness.Derivation("a" * 64, "b", "c" * 64, ("r2", "r1"), "r1")
    assert one.derivation_spec_id == same.derivation_spec_id != other.derivation_spec_id
    assert one.artifact_instance_id("d" * 40) != one.artifact_instance_id("e" * 40)
    with pytest.raises(ValueError):
        robustness.Derivation("a", "b", "c", ("r1",), "r9").payload()


def test_display_rounds_half_to_even_and_escapes(spark):
    values = [0.0000005, 0.0000015, 1.5, -0.1234565, 1e-9]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = [r[0] for r in rows.orderBy("i").select(presentation.display(F.col("v"), presentation.DECIMAL)).collect()]
    assert found == ["0.000000", "0.000002", "1.500000", "-0.123456", "0.000000"]
    text = spark.createDataFrame([("a|b",)], "v string")
    assert text.select(presentation.display(F.col("v"), presentation.TEXT)).first()[0] == "a\\|b"


def test_runs_are_stored_verified_and_tamper_evident(spark, sf):
    root = tempfile.mkdtemp(prefix="pairpref-runs-")
    snapshot = f"{root}/raw"
    battles_raw(spark, sf).write.parquet(snapshot)
    canonical = canonical_snapshot(spark, snapshot, PROVENANCE)
    config = BootstrapConfig(6, 11, "battle_row", estimator=EstimatorConfig("davidson_coalesced_ties"))
    runs = []
    for label in ("primary", "again"):
        run = run_analysis(canonical, PROVENANCE, RunConfig(label, config, BASE_RESEARCH), commit="c" * 40, branch="main")
        write_analysis(run, f"{root}/runs")
        runs.append(run.run_id)
    report = verify_runs(spark, f"{root}/runs", runs)
    assert report.where("status <> 'ok'").isEmpty() and report.select("run_id").distinct().count() == 2
    with pytest.raises(RunError) as error:
        write_analysis(run, f"{root}/runs")
    assert error.value.code == "RUN_ALREADY_EXISTS"
    tables = load_runs(spark, f"{root}/runs", runs)
    assert tables["scores"].select("run_id").distinct().count() == 2
    metrics = robustness_of(spark, f"{root}/runs", runs, runs[0])
    assert metrics["cross_specification"].where("maximum_absolute_rank_shift <> 0").isEmpty()
    with pytest.raises(RunError) as error:
        load_runs(spark, f"{root}/runs", runs[:1])
    assert error.value.code == "RUN_SET_MISMATCH"
    folder = f"{root}/runs/scores/run_id={runs[1]}"
    victim = next(name for name in os.listdir(folder) if name.endswith(".parquet"))
    with open(f"{folder}/{victim}", "ab") as handle:
        handle.write(b"x")
    with pytest.raises(RunError) as error:
        load_runs(spark, f"{root}/runs", runs)
    assert error.value.code == "ARTIFACT_CONSISTENCY_ERROR"
    plan = read_runs(spark, f"{root}/runs", runs[:1], "scores")._jdf.queryExecution().executedPlan().toString()
    assert f"run_id" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_manifests(spark):
    manifest = Manifest.of(Provenance("d", "é", None), BASE_RESEARCH, "c" * 40, "main", {"seed": 42, "nested": {"b": [1.5, None]}})
    frame = manifest.frame(spark)
    assert manifest_violations(frame).isEmpty()
    for name, value, code in (
        ("source_revision", "x", "SNAPSHOT_MISMATCH"),
        ("analysis_config", '{"seed":43}', "RUN_ID_MISMATCH"),
        ("manifest_schema_version", 9, "UNSUPPORTED_VERSION"),
    ):
        assert manifest_violations(frame.withColumn(name, F.lit(value))).first()["violation"] == code


def test_inventories(spark):
    root = tempfile.mkdtemp(prefix="pairpref-files-")
    for name, text in (("a.txt", "one"), ("sub/b.txt", "two")):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as handle:
            handle.write(text)
    files = inventory(spark, root)
    assert sorted(r["path"] for r in files.collect()) == ["a.txt", "sub/b.txt"]
    assert inventory_digest(files).first()["files"] == 2
    declared = files.where("path = 'a.txt'").unionByName(
        spark.createDataFrame([("gone.txt", 3, "x")], files.schema))
    status = {r["path"]: r["status"] for r in compare_inventories(declared, files).collect()}
    assert status == {"a.txt": "ok", "sub/b.txt": "extra", "gone.txt": "missing"}


def test_descriptive_report(spark, sf):
    report = descriptive_report(battles_raw(spark, sf), PROVENANCE)
    assert report.cleaning.first()["cleaned_rows"] == 2663 and report.statistics.count() == 25
    path = tempfile.mkdtemp(prefix="pairpref-report-")
    write_report(report, path)
    back = read_csv(spark, f"{path}/vote_statistics")
    assert {r["winner"] for r in back.collect()} >= {"model_a_win", "tie_bothbad"}
    assert read_csv(spark, f"{path}/cleaned").count() == 2663
