"""Ranking-robustness metrics over long tables.

``scores`` is (run_id, replicate, model_id, score, rank) of successful replicates and ``points`` is
(run_id, model_id, rank[, score]) of the full samples. All runs are handled in one job per metric.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairpref.functions.identity import sha256_of
from pairpref.operators.bootstrap import pairwise_counts, rank_summary
from pairpref.schema import ARTIFACT_VERSION, DERIVATION_VERSION, METRIC_VERSION, RANK_TOLERANCE, TOP_K

RUN = ("run_id",)
INTERVAL_FIELDS = ("lower_rank_quantile", "median_rank", "upper_rank_quantile", "probability_rank_1")
# The key of every metric table.
METRIC_KEYS = {
    "rank_distributions": ("run_id", "model_id", "rank"),
    "top_k": ("run_id", "model_id", "k"),
    "pairwise_ordering": ("run_id", "left_model_id", "right_model_id"),
    "rank_intervals": ("run_id", "model_id"),
    "adjacent_reversals": ("primary_rank_higher", "primary_rank_lower"),
    "cross_specification": ("model_id",),
}


def _run_sizes(scores: DataFrame) -> DataFrame:
    """(run_id, models, replicates), from one row per (run, model)."""
    per_model = scores.groupBy("run_id", "model_id").agg(F.count_distinct("replicate").alias("r"))
    return per_model.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("models"), F.max("r").alias("successful_replicates")
    )


def contract_violations(scores: DataFrame) -> DataFrame:
    """Replicates whose ranks are not a permutation of 1 .. M or whose scores are not finite."""
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    facts = scores.groupBy("run_id", "replicate").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("model_id").alias("models_seen"),
        F.count_distinct("rank").alias("ranks"),
        F.min("rank").alias("lowest"),
        F.max("rank").alias("highest"),
        F.count_if(~finite | (F.col("rank") != F.floor("rank"))).alias("improper"),
    )
    sizes = _run_sizes(scores).select("run_id", "models")
    m = F.col("models")
    whole = (F.col("rows") == m) & (F.col("models_seen") == m) & (F.col("ranks") == m)
    bounded = (F.col("lowest") == 1) & (F.col("highest") == m)
    violation = (
        F.when(F.col("improper") > 0, "IMPROPER_VALUE")
        .when(~bounded, "RANK_OUT_OF_RANGE")
        .when(~whole, "NOT_A_PERMUTATION")
    )
    checked = facts.join(sizes, "run_id").select("run_id", "replicate", violation.alias("violation"))
    return checked.where(F.col("violation").isNotNull())


def rank_distribution(scores: DataFrame) -> DataFrame:
    """Count and frequency of every rank of every model, ranks never taken included."""
    counts = scores.groupBy("run_id", "model_id", F.col("rank").cast("int").alias("rank")).agg(
        F.count(F.lit(1)).alias("count")
    )
    models = counts.select("run_id", "model_id").distinct().join(_run_sizes(scores), "run_id")
    every = models.withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("models").cast("int"))))
    n = F.coalesce("count", F.lit(0))
    return every.join(counts, ["run_id", "model_id", "rank"], "left").select(
        "run_id", "model_id", "rank", n.alias("count"), "successful_replicates",
        (n / F.col("successful_replicates")).alias("frequency"),
    )


def top_k_inclusion(scores: DataFrame, ks: Sequence[int] = TOP_K) -> DataFrame:
    """How often a model is among the first k. All thresholds are counted in one grouping."""
    included = [F.struct(F.lit(k).alias("k"), F.count_if(F.col("rank") <= k).alias("included_count")) for k in ks]
    counts = scores.groupBy("run_id", "model_id").agg(
        F.count(F.lit(1)).alias("successful_replicates"), F.array(*included).alias("k")
    )
    rows = counts.select("run_id", "model_id", "successful_replicates", F.inline("k"))
    return rows.withColumn("frequency", F.col("included_count") / F.col("successful_replicates"))


def too_few_models(scores: DataFrame, least: int = max(TOP_K)) -> DataFrame:
    """Runs whose model set is too small for the formal top-k table."""
    return _run_sizes(scores).where(F.col("models") < least).select("run_id", "models")


def pairwise_ordering(scores: DataFrame) -> DataFrame:
    counts = pairwise_counts(scores, RUN)
    share = {f"{n}_frequency": F.col(f"{n}_count") / F.col("successful_replicates") for n in ("gt", "eq", "lt")}
    return counts.withColumns(share)


def rank_intervals(scores: DataFrame) -> DataFrame:
    return rank_summary(scores, by=RUN)


def interval_violations(intervals: DataFrame, sizes: DataFrame) -> DataFrame:
    """Intervals that are not ordered, leave 1 .. M, or carry an impossible probability."""
    low, mid, high, p = (F.col(name) for name in INTERVAL_FIELDS)
    fine = (low >= 1) & (low <= mid) & (mid <= high) & (high <= F.col("models")) & p.between(0, 1)
    return intervals.join(sizes, "run_id").where(~F.coalesce(fine, F.lit(False))).select("run_id", "model_id")


def adjacent_reversals(points: DataFrame, scores: DataFrame, primary: str) -> DataFrame:
    """How often neighbours of the primary ranking keep or swap their order in its replicates."""
    order = Window.partitionBy("run_id").orderBy("rank")  # one row per model of one run
    neighbours = points.where(F.col("run_id") == primary).select(
        F.col("rank").alias("primary_rank_higher"),
        F.col("model_id").alias("higher_model_id"),
        F.lead("model_id").over(order).alias("lower_model_id"),
    )
    neighbours = neighbours.where(F.col("lower_model_id").isNotNull())
    drawn = scores.where(F.col("run_id") == primary)
    side = lambda s: drawn.select("replicate", F.col("model_id").alias(f"{s}_model_id"), F.col("rank").alias(f"__{s}"))
    pairs = side("higher").join(neighbours, "higher_model_id").join(side("lower"), ["replicate", "lower_model_id"])
    counts = pairs.groupBy("primary_rank_higher", "higher_model_id", "lower_model_id").agg(
        F.count_if(F.col("__higher") < F.col("__lower")).alias("support_count"),
        F.count_if(F.col("__lower") < F.col("__higher")).alias("reversal_count"),
        F.count(F.lit(1)).alias("successful_replicates"),
    )
    return counts.select(
        "primary_rank_higher",
        (F.col("primary_rank_higher") + 1).alias("primary_rank_lower"),
        "higher_model_id",
        "lower_model_id",
        "support_count",
        "reversal_count",
        "successful_replicates",
        (F.col("support_count") / F.col("successful_replicates")).alias("support_frequency"),
        (F.col("reversal_count") / F.col("successful_replicates")).alias("reversal_frequency"),
    )


def cross_specification(points: DataFrame, primary: str) -> DataFrame:
    """Rank of every model in every run and how far it moves from the primary one."""
    base = points.where(F.col("run_id") == primary).select("model_id", F.col("rank").alias("primary_rank"))
    moved = points.join(base, "model_id").withColumn("shift", F.col("rank") - F.col("primary_rank"))
    by_run = lambda name: F.map_from_entries(F.array_sort(F.collect_list(F.struct("run_id", name))))
    return moved.groupBy("model_id", "primary_rank").agg(
        by_run("rank").alias("rank_by_run"),
        by_run("shift").alias("primary_relative_shift_by_run"),
        F.min("rank").alias("minimum_observed_rank"),
        F.max("rank").alias("maximum_observed_rank"),
        F.max(F.abs("shift")).alias("maximum_absolute_rank_shift"),
        *[F.count_if(F.col("rank") <= k).alias(f"top_{k}_specification_count") for k in TOP_K],
        F.count(F.lit(1)).alias("specification_count"),
    )


def derive_metrics(points: DataFrame, scores: DataFrame, primary: str) -> dict[str, DataFrame]:
    """The six metric tables of a set of runs."""
    return {
        "rank_distributions": rank_distribution(scores),
        "top_k": top_k_inclusion(scores),
        "pairwise_ordering": pairwise_ordering(scores),
        "rank_intervals": rank_intervals(scores),
        "adjacent_reversals": adjacent_reversals(points, scores, primary),
        "cross_specification": cross_specification(points, primary),
    }


def expected_keys(points: DataFrame, metric: str, primary: str) -> DataFrame:
    """The keys a complete metric table must have, from the models of each run."""
    sizes = points.groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("models"))
    models = points.select("run_id", "model_id")
    if metric == "rank_distributions":
        return models.join(sizes, "run_id").select(
            "run_id", "model_id", F.explode(F.sequence(F.lit(1), "models")).alias("rank")
        )
    if metric == "top_k":
        return models.withColumn("k", F.explode(F.array(*[F.lit(k) for k in TOP_K])))
    if metric == "pairwise_ordering":
        left, right = (models.withColumnRenamed("model_id", f"{s}_model_id") for s in ("left", "right"))
        return left.join(right, "run_id").where(F.col("left_model_id") < F.col("right_model_id"))
    if metric == "rank_intervals":
        return models
    if metric == "adjacent_reversals":
        first = sizes.where(F.col("run_id") == primary)
        ranks = first.select(F.explode(F.sequence(F.lit(1), F.col("models") - 1)).alias("primary_rank_higher"))
        return ranks.withColumn("primary_rank_lower", F.col("primary_rank_higher") + 1)
    return models.where(F.col("run_id") == primary).select("model_id")


def completeness(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: expected keys, found rows, and how many keys are missing, unexpected or repeated."""
    found = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = expected.select(*keys).withColumn("wanted", F.lit(1)).join(found, list(keys), "full_outer")
    return joined.agg(
        F.count("wanted").alias("expected_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("wanted").isNull()).alias("unexpected"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    )


def _close(left: Column, right: Column) -> Column:
    return F.abs(left - right) <= F.greatest(F.lit(1e-15), 1e-12 * F.greatest(F.abs(left), F.abs(right)))


def _at_most(k: int) -> Callable[[Column], Column]:
    return lambda rank: rank <= k


def record_violations(metric: str, records: DataFrame) -> DataFrame:
    """Records whose parts contradict each other (shares, bounds, shift arithmetic)."""
    c = F.col
    n = c("successful_replicates") if "successful_replicates" in records.columns else F.lit(1)
    share = lambda value, count: _close(c(value), c(count) / n) & c(value).between(0, 1)
    if metric == "rank_distributions":
        fine = (c("rank") >= 1) & c("count").between(0, n) & share("frequency", "count")
    elif metric == "top_k":
        fine = c("k").isin(*TOP_K) & c("included_count").between(0, n) & share("frequency", "included_count")
    elif metric == "pairwise_ordering":
        fine = (c("gt_count") + c("eq_count") + c("lt_count") == n) & (c("left_model_id") != c("right_model_id"))
        for name in ("gt", "eq", "lt"):
            fine = fine & share(f"{name}_frequency", f"{name}_count")
    elif metric == "rank_intervals":
        low, mid, high, p = (c(name) for name in INTERVAL_FIELDS)
        fine = (low >= 1) & (low <= mid) & (mid <= high) & p.between(0, 1)
    elif metric == "adjacent_reversals":
        fine = (c("primary_rank_lower") == c("primary_rank_higher") + 1) & (c("support_count") + c("reversal_count") == n)
        fine = fine & share("support_frequency", "support_count") & share("reversal_frequency", "reversal_count")
    elif metric == "cross_specification":
        ranks, shifts = F.map_values("rank_by_run"), F.map_values("primary_relative_shift_by_run")
        fine = (
            (shifts == F.transform(ranks, lambda r: r - c("primary_rank")))
            & (c("minimum_observed_rank") == F.array_min(ranks))
            & (c("maximum_observed_rank") == F.array_max(ranks))
            & (c("maximum_absolute_rank_shift") == F.array_max(F.transform(shifts, F.abs)))
            & (c("specification_count") == F.size(ranks))
        )
        for k in TOP_K:
            within = F.size(F.filter(ranks, _at_most(k)))
            fine = fine & (c(f"top_{k}_specification_count") == within)
    else:
        raise ValueError(f"unsupported metric {metric}")
    return records.where(~F.coalesce(fine, F.lit(False)))


def summary_disagreements(top_k: DataFrame, intervals: DataFrame) -> DataFrame:
    """Models whose top-1 frequency differs from the probability of rank 1 in the summary."""
    first = top_k.where(F.col("k") == 1).select("run_id", "model_id", "frequency")
    joined = first.join(intervals.select("run_id", "model_id", "probability_rank_1"), ["run_id", "model_id"], "full_outer")
    same = F.abs(F.col("frequency") - F.col("probability_rank_1")) <= 1e-15
    return joined.where(~F.coalesce(same, F.lit(False)))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, repeats counted: empty exactly when two tables are equal."""
    right = right.select(*left.columns)
    only_left = left.exceptAll(right).withColumn("side", F.lit("left"))
    return only_left.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


@dataclass(frozen=True)
class Derivation:
    """Identity of one derivation: what it is computed from and how."""

    source_snapshot_id: str
    bundle_name: str
    payload_inventory_sha256: str
    run_ids: tuple[str, ...]
    primary_run_id: str

    def payload(self) -> dict:
        """The keys, which are hashed with their contents."""
        if self.primary_run_id not in self.run_ids or len(set(self.run_ids)) != len(self.run_ids):
            raise ValueError("run ids must be unique and contain the primary run")
        return {
            "derivation_contract_version": DERIVATION_VERSION,
            "metric_schema_version": METRIC_VERSION,
            "source_snapshot_id": self.source_snapshot_id,
            "e1_bundle": {
                "bundle_name": self.bundle_name,
                "bundle_schema_version": 1,
                "payload_inventory_sha256": self.payload_inventory_sha256,
            },
            "ordered_run_ids": list(self.run_ids),
            "primary_run_id": self.primary_run_id,
            "top_k": list(TOP_K),
            "pairwise_ordering_tolerance": RANK_TOLERANCE,
        }

    @property
    def derivation_spec_id(self) -> str:
        return sha256_of(self.payload(), ascii_only=True)

    def artifact_instance_id(self, producer_commit: str) -> str:
        return sha256_of(instance_payload(self.derivation_spec_id, producer_commit), ascii_only=True)


def instance_payload(derivation_spec_id: str, producer_commit: str) -> dict:
    """What identifies one artifact of a derivation. The keys, which are hashed with their contents."""
    return {
        "derivation_spec_id": derivation_spec_id,
        "producer_git_sha": producer_commit,
        "artifact_schema_version": ARTIFACT_VERSION,
    }
