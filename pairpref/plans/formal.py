"""A formal run: population or view, point fit, bootstrap, result tables. Many runs share one canonical table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairpref.operators.bootstrap import (
    Bootstrap,
    BootstrapConfig,
    formal_score_intervals,
    pairwise_stability,
    rank_summary,
    run_bootstrap,
)
from pairpref.operators.canonical import Provenance, canonicalize, store_canonical
from pairpref.operators.estimate import diagnostics, scores_long
from pairpref.operators.population import BASE_RESEARCH, PopulationSpec, apply_population
from pairpref.operators.robustness import derive_metrics
from pairpref.operators.views import ViewSpec, apply_view
from pairpref.sources.files import check_source, read_parquet
from pairpref.sources.runs import Manifest, load_runs, write_run


@dataclass(frozen=True)
class RunConfig:
    """One run: a population (or a view of the base population) and how it is fitted and resampled."""

    label: str
    bootstrap: BootstrapConfig
    population: PopulationSpec = BASE_RESEARCH
    view: ViewSpec | None = None

    def to_dict(self) -> dict[str, Any]:
        config: dict[str, Any] = {"analysis": self.label, "bootstrap": self.bootstrap.to_dict()}
        if self.view is not None:
            config["view"] = self.view.to_dict()
        return config


@dataclass(frozen=True)
class Run:
    run_id: str
    manifest: DataFrame
    bootstrap: Bootstrap

    @property
    def tables(self) -> dict[str, DataFrame]:
        boot, confidence = self.bootstrap, self.bootstrap.config.confidence
        return {
            "manifest": self.manifest,
            "point": boot.point,
            "fits": diagnostics(boot.fits, ("replicate",)),
            "scores": boot.scores,
            "statuses": boot.statuses,
            "score_intervals": formal_score_intervals(boot.scores, boot.statuses, boot.config.replicates, confidence),
            "rank_summary": rank_summary(boot.scores, confidence),
            "pairwise": pairwise_stability(boot.scores),
        }


def canonical_snapshot(
    spark: SparkSession, path: str, provenance: Provenance, *, index_column: str = "source_row_index"
) -> DataFrame:
    """Read one Parquet snapshot, gated by its declared hash if there is one, and store it canonically."""
    if provenance.source_file_sha256 is not None:
        check_source(spark, path, provenance.source_file_sha256)
    raw = read_parquet(spark, path).withColumnRenamed(index_column, "source_row_index")
    rows = canonicalize(raw, provenance, check_index=True, measured=True)
    return store_canonical(rows.drop("conversation_a", "conversation_b"), provenance)


def run_analysis(canonical: DataFrame, provenance: Provenance, config: RunConfig, *, commit: str, branch: str) -> Run:
    base = apply_population(canonical, config.population)
    population = base if config.view is None else apply_view(base, config.view).population
    manifest = Manifest.of(provenance, population.spec, commit, branch, config.to_dict())
    boot = run_bootstrap(population.eligible, config.bootstrap)
    return Run(manifest.run_id, manifest.frame(canonical.sparkSession), boot)


def write_analysis(run: Run, root: str) -> str:
    return write_run(run.manifest.sparkSession, root, run.run_id, run.tables)


def robustness_of(spark: SparkSession, root: str, run_ids: list[str], primary: str) -> Mapping[str, DataFrame]:
    """The robustness metrics of stored runs."""
    tables = load_runs(spark, root, run_ids)
    points = scores_long(tables["point"], ("run_id",))
    scores = tables["scores"].select("run_id", "replicate", "model_id", "score", F.col("rank").cast("int").alias("rank"))
    return derive_metrics(points, scores, primary)
