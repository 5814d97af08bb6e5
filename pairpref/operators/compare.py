"""Comparison of runs with a primary run, over point tables (run_id, model_id, rank, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def against_primary(points: DataFrame, primary: str) -> DataFrame:
    """Every other run's model next to the primary's."""
    base = points.where(F.col("run_id") == primary).select(
        "model_id", F.col("rank").alias("primary_rank"), F.col("score").alias("primary_score")
    )
    return points.where(F.col("run_id") != primary).join(base, "model_id")


def displacement(points: DataFrame, primary: str) -> DataFrame:
    moved = F.abs(F.col("rank") - F.col("primary_rank"))
    return against_primary(points, primary).groupBy("run_id").agg(
        F.max(moved).alias("max_absolute_displacement"), F.avg(moved).alias("mean_absolute_displacement")
    )


def spearman(points: DataFrame, primary: str) -> DataFrame:
    """Rank correlation; ranks are permutations, so it is the correlation of the ranks."""
    rho = F.corr(F.col("rank").cast("double"), F.col("primary_rank").cast("double"))
    return against_primary(points, primary).groupBy("run_id").agg(rho.alias("spearman_rho"))


def top_agreement(points: DataFrame, primary: str, k: int = 4) -> DataFrame:
    """Same first model, size of the common top k, and whether the top k comes in the same order."""
    rank, base = F.col("rank"), F.col("primary_rank")
    return against_primary(points, primary).groupBy("run_id").agg(
        (F.count_if((rank == 1) & (base == 1)) == 1).alias("same_top_1"),
        F.count_if((rank <= k) & (base <= k)).alias(f"top_{k}_overlap"),
        (F.count_if((base <= k) & (rank == base)) == F.count_if(base <= k)).alias(f"top_{k}_order_preserved"),
    )


def score_shift(points: DataFrame, runs: DataFrame, primary: str) -> DataFrame:
    """Score differences where estimator and outcome policy are the primary's; scales differ otherwise."""
    base = runs.where(F.col("run_id") == primary)
    estimator, policy = (base.select(name).scalar() for name in ("estimator", "outcome_policy"))
    same = (F.col("estimator") == estimator) & (F.col("outcome_policy") == policy)
    labelled = against_primary(points, primary).join(F.broadcast(runs.withColumn("comparable", same)), "run_id")
    return labelled.select(
        "run_id",
        "model_id",
        F.when(F.col("comparable"), "same_estimator_parameterization_only")
        .otherwise("latent_scores_not_comparable_with_primary")
        .alias("comparability"),
        F.when(F.col("comparable"), F.col("score") - F.col("primary_score")).alias("score_shift"),
    )


def pairwise_change(ordering: DataFrame, primary: str) -> DataFrame:
    """Change of pairwise frequencies from the primary run."""
    keys = ["left_model_id", "right_model_id"]
    names = ("gt_frequency", "eq_frequency", "lt_frequency")
    base = ordering.where(F.col("run_id") == primary).select(*keys, *[F.col(n).alias(f"primary_{n}") for n in names])
    changes = [(F.col(n) - F.col(f"primary_{n}")).alias(f"{n}_change") for n in names]
    return ordering.where(F.col("run_id") != primary).join(base, keys).select("run_id", *keys, *changes)


def distribution_change(distribution: DataFrame, primary: str) -> DataFrame:
    base = distribution.where(F.col("run_id") == primary).select(
        "model_id", "rank", F.col("frequency").alias("primary_frequency")
    )
    rows = distribution.where(F.col("run_id") != primary).join(base, ["model_id", "rank"])
    change = F.col("frequency") - F.col("primary_frequency")
    return rows.select("run_id", "model_id", "rank", change.alias("frequency_change"))
