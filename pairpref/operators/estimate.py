"""Bradley-Terry and Davidson scores for one or many strata.

Battles are first reduced to counts per (stratum, model_a, model_b, outcome); every later step works on those.
Strata of up to ``DENSE_MODELS`` models are fitted in parallel, one group each; all larger ones are fitted together by
distributed gradients (``operators.largefit``). Both reach the same optimum; which one served is part of the identity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairpref.functions.text import present
from pairpref.operators.kernel import fit_counts
from pairpref.schema import A_WIN, B_WIN, BOTH_BAD, ESTIMATOR_VERSION, OUTCOMES, RANK_TOLERANCE, TIE, UNKNOWN
from pairpref.session import cut, stored

DENSE_MODELS = 500
CELL = ("model_a_id", "model_b_id", "canonical_outcome")
# Outcomes in the likelihood of each estimator, and the name of that policy.
POLICIES = {
    "davidson": ("ordinary_tie_only", (A_WIN, B_WIN, TIE)),
    "davidson_coalesced_ties": ("all_ties_coalesced", (A_WIN, B_WIN, TIE, BOTH_BAD)),
    "bradley_terry_decisive": ("decisive_only", (A_WIN, B_WIN)),
}
OUTCOME_CODES = {A_WIN: 0, B_WIN: 1, TIE: 2, BOTH_BAD: 3}
REQUIRED_COLUMNS = ("model_a_id", "model_b_id", "canonical_outcome", "battle_id")
RESULT = [
    ("status", "string"),
    ("models", "int"),
    ("rows", "bigint"),
    ("likelihood_rows", "bigint"),
    ("edges", "int"),
    ("components", "int"),
    ("iterations", "int"),
    ("objective", "double"),
    ("tie_parameter", "double"),
    ("model_ids", "array<string>"),
    ("scores", "array<double>"),
    ("ranks", "array<int>"),
]


class EstimationError(ValueError):
    def __init__(self, code: str, message: str = "") -> None:
        self.code = code
        super().__init__(f"{code}: {message}")


@dataclass(frozen=True)
class EstimatorConfig:
    estimator: str = "davidson"
    max_iterations: int = 1_000
    tolerance: float = 1e-9

    def __post_init__(self) -> None:
        if self.estimator not in POLICIES:
            raise ValueError(f"estimator must be one of {sorted(POLICIES)}")
        if isinstance(self.max_iterations, bool) or not isinstance(self.max_iterations, int) or self.max_iterations <= 0:
            raise ValueError("max_iterations must be a positive integer")
        if not math.isfinite(self.tolerance) or self.tolerance <= 0:
            raise ValueError("tolerance must be a finite positive number")

    @property
    def outcomes(self) -> tuple[str, ...]:
        return POLICIES[self.estimator][1]

    def to_dict(self) -> dict[str, Any]:
        return {
            "estimator": self.estimator,
            "estimator_version": ESTIMATOR_VERSION,
            "outcome_policy": POLICIES[self.estimator][0],
            "identifiability": "sum_to_zero",
            "optimizer": {"method": "newton", "models": DENSE_MODELS, "beyond": "l-bfgs"},
            "regularization": None,
            "max_iterations": self.max_iterations,
            "tolerance": self.tolerance,
        }


def input_violations(battles: DataFrame) -> DataFrame:
    """One row of violation counts and the code of the first kind found."""
    outcome = F.col("canonical_outcome")
    named = present(F.col("model_a_id")) & present(F.col("model_b_id"))
    counts = battles.agg(
        F.count_if(~named).alias("invalid_model_ids"),
        F.count_if(F.col("model_a_id") == F.col("model_b_id")).alias("self_comparisons"),
        F.count_if(outcome.isNull() | ~outcome.isin(*OUTCOMES) | (outcome == UNKNOWN)).alias("invalid_outcomes"),
    )
    code = (
        F.when(F.col("invalid_model_ids") > 0, "INVALID_MODEL_ID")
        .when(F.col("self_comparisons") > 0, "SELF_COMPARISON")
        .when(F.col("invalid_outcomes") > 0, "INVALID_OUTCOME")
        .otherwise("OK")
    )
    return counts.withColumn("code", code)


def require_valid_input(battles: DataFrame) -> None:
    missing = sorted(set(REQUIRED_COLUMNS) - set(battles.columns))
    if missing:
        raise EstimationError("MISSING_REQUIRED_COLUMNS", str(missing))
    code = input_violations(battles).first()["code"]
    if code != "OK":
        raise EstimationError(code)


def likelihood_rows(battles: DataFrame, config: EstimatorConfig) -> DataFrame:
    """Rows an estimator uses; a tie of two bad answers counts as a tie where the policy admits it."""
    kept = battles.where(F.col("canonical_outcome").isin(*config.outcomes))
    merged = F.when(F.col("canonical_outcome") == BOTH_BAD, TIE).otherwise(F.col("canonical_outcome"))
    return kept.withColumn("canonical_outcome", merged)


def count_cells(battles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Battles per (stratum, model_a, model_b, outcome): the sufficient statistics."""
    return battles.groupBy(*by, *CELL).agg(F.count(F.lit(1)).alias("n"))


def models_of(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return cells.select(*by, F.explode(F.array("model_a_id", "model_b_id")).alias("model_id")).distinct()


def dropped_models(cells: DataFrame, config: EstimatorConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """Population models that the outcome policy leaves without a battle."""
    used = models_of(likelihood_rows(cells, config), by)
    return models_of(cells, by).join(used, [*by, "model_id"], "left_anti")


def tie_support(cells: DataFrame, config: EstimatorConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """Ties and decisive battles per stratum; a tie parameter needs both."""
    tie = F.col("canonical_outcome") == TIE
    counts = likelihood_rows(cells, config).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(tie, F.col("n"))), F.lit(0)).alias("ties"),
        F.coalesce(F.sum(F.when(~tie, F.col("n"))), F.lit(0)).alias("decisive"),
    )
    return counts.withColumn("identifiable", (F.col("ties") > 0) & (F.col("decisive") > 0))


def outcome_counts(cells: DataFrame, config: EstimatorConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, outcome, population, likelihood, excluded): battles of every outcome, also of those that did not occur.

    ``population`` is what was handed in, ``likelihood`` what the fit uses under the name it uses it by (a coalesced tie of
    two bad answers counts as a tie), ``excluded`` what the policy leaves out.
    """
    known = F.explode(F.array(*[F.lit(outcome) for outcome in sorted(OUTCOME_CODES)])).alias("outcome")
    strata = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()
    grid = strata.select(*by, known)
    per = lambda rows, name: rows.groupBy(*by, F.col("canonical_outcome").alias("outcome")).agg(F.sum("n").alias(name))
    out = grid
    for name, rows in (
        ("population", cells), ("likelihood", likelihood_rows(cells, config)),
        ("excluded", cells.where(~F.col("canonical_outcome").isin(*config.outcomes))),
    ):
        counted = per(rows, name).alias("c")
        same = [F.col(f"g.{key}").eqNullSafe(F.col(f"c.{key}")) for key in (*by, "outcome")]
        condition = same[0]
        for more in same[1:]:
            condition = condition & more
        joined = out.alias("g").join(counted, condition, "left")
        out = joined.select(*[F.col(f"g.{key}").alias(key) for key in out.columns], F.coalesce(F.col(f"c.{name}"), F.lit(0)).cast("long").alias(name))
    return out


def fits_schema(cells: DataFrame, by: tuple[str, ...]) -> str:
    keys = [(name, cells.schema[name].dataType.simpleString()) for name in by]
    return ", ".join(f"`{name}` {kind}" for name, kind in [*keys, *RESULT])


def result_row(keys: dict[str, Any], model_ids: list[str], found: dict[str, Any]) -> pd.DataFrame:
    """One fit as a one-row frame with every result column, absent ones null."""
    row = {name: found.get(name) for name, _ in RESULT} | keys
    row["model_ids"] = list(model_ids)
    return pd.DataFrame({name: [value] for name, value in row.items()}, dtype=object)


def _dense_fit(cells: DataFrame, by: tuple[str, ...], config: EstimatorConfig) -> DataFrame:
    codes, options = OUTCOME_CODES, {
        "estimator": config.estimator, "max_iterations": config.max_iterations, "tolerance": config.tolerance,
    }

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, position = np.unique(
            np.concatenate([pdf["model_a_id"].to_numpy(str), pdf["model_b_id"].to_numpy(str)]), return_inverse=True
        )
        a, b = position[: len(pdf)], position[len(pdf):]
        outcome = pdf["canonical_outcome"].map(codes).to_numpy()
        found = fit_counts(len(ids), a, b, outcome, pdf["n"].to_numpy(), **options)
        return result_row(dict(zip(by, key)), ids.tolist(), found)

    if not by:
        return cells.withColumn("__all", F.lit("all")).groupBy("__all").applyInPandas(fit, fits_schema(cells, by))
    return cells.groupBy(*by).applyInPandas(fit, fits_schema(cells, by))


def fit_cells(cells: DataFrame, config: EstimatorConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per stratum: status, diagnostics, and scores and ranks in the order of ``model_ids``.

    A failed stratum keeps its row and its code. ``cells`` must be materialised: its strata are measured first.
    """
    sizes = models_of(cells, by).groupBy(*by).agg(F.count(F.lit(1)).alias("k"))
    large = bool(by) and not sizes.where(F.col("k") > DENSE_MODELS).isEmpty()
    if not by:
        total = sizes.first()
        if total is None or total["k"] == 0:
            raise EstimationError("ZERO_LIKELIHOOD_ROWS", "the population is empty")
        large = total["k"] > DENSE_MODELS
    if not large:
        return cut(_dense_fit(cells, by, config))
    from pairpref.operators.largefit import fit_many

    if not by:
        return cut(fit_many(cells, config))
    size = F.struct(*[F.col(name) for name in by])
    beyond = sizes.where(F.col("k") > DENSE_MODELS).select(F.xxhash64(size).alias("__size")).distinct()
    marked = cells.withColumn("__size", F.xxhash64(size))
    small = marked.join(beyond, "__size", "left_anti").drop("__size")
    fits = fit_many(cut(marked.join(beyond, "__size", "left_semi").drop("__size")), config, by)
    return cut(_dense_fit(small, by, config).unionByName(fits.select(*by, *[name for name, _ in RESULT])))


def fit(battles: DataFrame, config: EstimatorConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """Fit an explicit population, as a whole or per stratum."""
    missing = sorted(set(REQUIRED_COLUMNS) - set(battles.columns))
    if missing:
        raise EstimationError("MISSING_REQUIRED_COLUMNS", str(missing))
    cells = cut(count_cells(battles, by))
    code = input_violations(cells).first()["code"]
    if code != "OK":
        raise EstimationError(code)
    return fit_cells(cells, config, by)


def scores_long(fits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(stratum, model_id, score, rank) of the successful fits."""
    zipped = F.arrays_zip("model_ids", "scores", "ranks")
    rows = fits.where(F.col("status") == "SUCCESS").select(*by, F.explode(zipped).alias("m"))
    return rows.select(
        *by, F.col("m.model_ids").alias("model_id"), F.col("m.scores").alias("score"), F.col("m.ranks").alias("rank")
    )


def diagnostics(fits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    names = [name for name, _ in RESULT if name not in ("model_ids", "scores", "ranks")]
    return fits.select(*by, *names)


def expected_points(cells: DataFrame, fits: DataFrame, config: EstimatorConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """Expected points and ties per model under a fit; at the optimum they equal the observed ones."""
    scores = scores_long(fits, by).drop("rank")
    nu = fits.select(*by, F.coalesce("tie_parameter", F.lit(0.0)).alias("nu"))
    side = lambda s: scores.select(*by, F.col("model_id").alias(f"model_{s}_id"), F.exp("score").alias(f"e{s}"))
    pairs = likelihood_rows(cells, config).groupBy(*by, "model_a_id", "model_b_id").agg(F.sum("n").alias("n"))
    joined = pairs.join(side("a"), [*by, "model_a_id"]).join(side("b"), [*by, "model_b_id"])
    joined = joined.join(nu, list(by)) if by else joined.withColumn("nu", nu.select("nu").scalar())
    tie = F.col("nu") * F.sqrt(F.col("ea") * F.col("eb"))
    joined = joined.withColumn("d", F.col("ea") + F.col("eb") + tie)
    of = lambda s: F.struct(
        F.col(f"model_{s}_id").alias("model_id"),
        (F.col("n") * (F.col(f"e{s}") + tie / 2) / F.col("d")).alias("p"),
        (F.col("n") * tie / F.col("d")).alias("t"),
    )
    return joined.select(*by, F.inline(F.array(of("a"), of("b")))).groupBy(*by, "model_id").agg(
        F.sum("p").alias("points"), F.sum("t").alias("ties")
    )


def _next_heads(scores: np.ndarray, at: int) -> Iterator[int]:
    """Places of the heads of groups from ``at`` on; scores fall, a group ends beyond the tolerance from its head."""
    rising = -scores
    while at < len(scores):
        yield at
        after = max(int(np.searchsorted(rising, rising[at] + RANK_TOLERANCE, "right")), at + 1)
        while after - 1 > at and scores[at] - scores[after - 1] > RANK_TOLERANCE:  # rounding of the sum
            after -= 1
        while after < len(scores) and not scores[at] - scores[after] > RANK_TOLERANCE:
            after += 1
        at = after


def _slice_ends(rows: pa.Table) -> pa.Table:
    """What a slice does to a ranking that runs through it.

    For every score that can become the first head here (whatever the head before): the last head and the number of heads
    when it does. Only scores within the tolerance of the slice's first one, and the next, can.
    """
    rows = rows.sort_by([("__stratum", "ascending"), ("score", "descending")])
    names = rows.column("__stratum").to_pylist()
    first, last = names[0], names[-1]
    scores = rows.filter(pc.equal(rows.column("__stratum"), last)).column("score").to_numpy()
    starts = [0]
    if first == last:
        near = np.flatnonzero(scores[0] - scores <= RANK_TOLERANCE)
        starts = [i for i in range(len(near) + 1) if i < len(scores) and (i == 0 or scores[i] != scores[i - 1])]
    found = []
    for start in starts:
        heads = list(_next_heads(scores, start))
        found.append({"score": float(scores[start]), "head": float(scores[heads[-1]]), "heads": len(heads)})
    kind = pa.list_(pa.struct([("score", pa.float64()), ("head", pa.float64()), ("heads", pa.int64())]))
    return pa.table({"slice": rows.column("slice").slice(0, 1), "first": [first], "last": [last], "starts": pa.array([found], kind)})


def _slice_ranks(before: dict[int, tuple[float, int]], by: tuple[str, ...]):
    def rank(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("__stratum", "ascending"), ("score", "descending"), ("model_id", "ascending")])
        names, scores = rows.column("__stratum").to_numpy(zero_copy_only=False), rows.column("score").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
        ranks = np.empty(len(rows), np.int32)
        entry = before.get(rows.column("slice")[0].as_py())
        for a, b in zip(edges[:-1], edges[1:]):
            own, rank, at = scores[a:b], 0, 0
            if entry is not None and a == 0:
                head, rank = entry
                at = int(np.argmax(head - own > RANK_TOLERANCE)) if head - own[-1] > RANK_TOLERANCE else len(own)
                ranks[a : a + at] = rank
            heads = [*_next_heads(own, at), len(own)]
            for x, y in zip(heads[:-1], heads[1:]):
                rank += 1
                ranks[a + x : a + y] = rank
        return rows.select([*by, "model_id", "score"]).append_column("rank", pa.array(ranks))

    return rank


def dense_ranks(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranks 1, 2, ... per stratum. A score shares the rank of the head of its group when it lies within the
    tolerance of that head, which chains of close scores do not.

    Scores are dealt to slices in their order. What a slice makes of the head that comes into it is summed up in a few
    numbers; these are followed from slice to slice, one row each, and then all slices rank their scores at once.
    """
    stratum = F.to_json(F.struct(*[F.col(name) for name in by])) if by else F.lit("all")
    rows = scores.select(*by, stratum.alias("__stratum"), "model_id", F.col("score").cast("double").alias("score"))
    sliced = stored(rows.repartitionByRange("__stratum", F.desc("score"), "model_id").withColumn("slice", F.spark_partition_id()))
    kind = "slice int, first string, last string, starts array<struct<score: double, head: double, heads: long>>"
    entries: dict[int, tuple[float, int]] = {}
    running: tuple[str, float, int] | None = None
    for end in sorted(sliced.groupBy("slice").applyInArrow(_slice_ends, kind).collect(), key=lambda row: row["slice"]):
        chosen, head, rank = end["starts"][0], None, 0
        if running is not None and running[0] == end["first"]:
            _, head, rank = running
            entries[end["slice"]] = head, rank
        if end["first"] == end["last"] and head is not None:
            chosen = next((s for s in end["starts"] if head - s["score"] > RANK_TOLERANCE), None)
        elif end["first"] != end["last"]:
            rank = 0
        running = (end["last"], head, rank) if chosen is None else (end["last"], chosen["head"], rank + chosen["heads"])
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{name}` {fields[name]}" for name in [*by, "model_id", "score"]) + ", rank int"
    return sliced.groupBy("slice").applyInArrow(_slice_ranks(entries, by), schema)


def gauge_check(fits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    total = F.aggregate("scores", F.lit(0.0), lambda acc, score: acc + score)
    return fits.where(F.col("status") == "SUCCESS").select(*by, total.alias("score_sum"))


