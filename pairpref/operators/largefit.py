"""Fits with more models than a dense solve can hold, for any number of strata in one loop.

The optimizer's state is a table with one row per (stratum, model): position, gradient and the last MEMORY steps and gradient
changes; the log tie parameter is the row of the empty model id. A round is one grouped sum over model pairs for all
strata (objective and gradients at their trial points) and one for the inner products of the state's vectors. The
limited-memory direction is a combination of those vectors, whose coefficients follow from the inner products alone, so
what a stratum needs beyond its rows is a small matrix, and no vector or list of ids is ever on the driver.
Strata search their steps independently and leave the loop when they are done. Positions are measured in units that make
the curvature of every coordinate about one (two over the root of a model's battles), so that few rounds are needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairpref.operators.estimate import RESULT, EstimatorConfig, dense_ranks, dropped_models, likelihood_rows, models_of, tie_support
from pairpref.operators.graph import graph_facts, strongly_connected
from pairpref.schema import A_WIN, TIE
from pairpref.session import BROADCAST_ROWS, stored

MEMORY, HALVINGS = 6, 40
#: Scores tie within 1e-10, which a gradient within the tolerance does not settle: whole steps are taken down to this one.
EXACT = 1e-12
BASIS = 2 * MEMORY + 1  # steps, gradient changes, gradient
ENTRIES = [(i, j) for i in range(BASIS) for j in range(i + 1)]
NO_MODEL = ""  # the row of the log tie parameter
KEYS = "__stratum string, value double, total double, share double, iteration int, halvings int, history int, status string"


def _stratum(by: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*[F.col(name) for name in by])) if by else F.lit("all")


def _pairs(used: DataFrame) -> DataFrame:
    """(stratum, low, high, won, lost, tied) per unordered pair of cells named by ``__fit``; ``won`` counts for the smaller id."""
    low, high = F.least("model_a_id", "model_b_id"), F.greatest("model_a_id", "model_b_id")
    tie = F.col("canonical_outcome") == TIE
    low_won = ~tie & ((F.col("canonical_outcome") == A_WIN) == (F.col("model_a_id") == low))
    count = lambda chosen, name: F.sum(F.when(chosen, F.col("n")).otherwise(0)).cast("double").alias(name)
    return used.groupBy(F.col("__fit").alias("__stratum"), low.alias("low"), high.alias("high")).agg(
        count(low_won, "won"), count(~tie & ~low_won, "lost"), count(tie, "tied")
    )


def _slopes(pairs: DataFrame, trial: DataFrame) -> DataFrame:
    """(stratum, model, slope, value): gradient at the points ``trial`` (stratum, model, t), and shares of the objective."""
    side = lambda name: trial.where(F.col("model") != NO_MODEL).select("__stratum", F.col("model").alias(name), F.col("t").alias(f"t_{name}"))
    nu = trial.where(F.col("model") == NO_MODEL).select("__stratum", F.col("t").alias("log_nu"))
    at = pairs.join(side("low"), ["__stratum", "low"]).join(side("high"), ["__stratum", "high"]).join(nu, "__stratum", "left")
    a, b, n = F.col("t_low"), F.col("t_high"), F.col("won") + F.col("lost") + F.col("tied")
    at = at.withColumn("c", F.coalesce(F.col("log_nu") + 0.5 * (a + b), F.lit(float("-inf"))))
    at = at.withColumn("top", F.greatest(a, b, "c"))
    at = at.withColumn("ls", F.col("top") + F.log(F.exp(a - F.col("top")) + F.exp(b - F.col("top")) + F.exp(F.col("c") - F.col("top"))))
    tied = n * F.exp(F.col("c") - F.col("ls"))
    part = lambda model, slope, value: F.struct(model.alias("model"), slope.alias("slope"), value.alias("value"))
    chosen = F.col("won") * a + F.col("lost") * b + F.when(F.col("tied") > 0, F.col("tied") * F.col("c")).otherwise(0.0)
    parts = F.array(
        part(F.col("low"), n * F.exp(a - F.col("ls")) + 0.5 * tied - F.col("won") - 0.5 * F.col("tied"), n * F.col("ls") - chosen),
        part(F.col("high"), n * F.exp(b - F.col("ls")) + 0.5 * tied - F.col("lost") - 0.5 * F.col("tied"), F.lit(0.0)),
        part(F.when(F.col("log_nu").isNotNull(), F.lit(NO_MODEL)), tied - F.col("tied"), F.lit(0.0)),
    )
    rows = at.select("__stratum", F.inline(parts)).where("model is not null")
    return rows.groupBy("__stratum", "model").agg(F.sum("slope").alias("slope"), F.sum("value").alias("value"))


def _direction(products: np.ndarray, history: int) -> np.ndarray:
    """Coefficients of the quasi-Newton direction over steps, changes and gradient, by the two-loop recursion."""
    weights, alpha = np.zeros(BASIS), np.zeros(MEMORY)
    weights[-1] = -1.0
    recent = range(MEMORY - history, MEMORY)
    for i in reversed(recent):
        alpha[i] = weights @ products[:, i] / products[i, MEMORY + i]
        weights[MEMORY + i] -= alpha[i]
    newest = MEMORY - 1
    weights *= products[newest, MEMORY + newest] / products[MEMORY + newest, MEMORY + newest] if history else 1.0
    for i in recent:
        weights[i] += alpha[i] - weights @ products[:, MEMORY + i] / products[i, MEMORY + i]
    return weights


def _planned(config: EstimatorConfig):
    """Adds to KEYS rows with inner products: direction weights, its slope, and the status of those that are done."""

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            weights, slopes, statuses = [], [], []
            for row in frame.itertuples(index=False):
                products = np.zeros((BASIS, BASIS))
                products[tuple(zip(*ENTRIES))] = row.products
                products = products + np.tril(products, -1).T
                enough, exact = (row.steep <= size * max(1.0, row.total) for size in (config.tolerance, min(EXACT, config.tolerance)))
                if exact or (enough and (row.halvings or row.iteration >= config.max_iterations)):
                    status = "SUCCESS"
                elif not np.isfinite(row.steep) or row.halvings > HALVINGS or row.iteration >= config.max_iterations:
                    status = "OPTIMIZATION_FAILED"
                else:
                    status = None
                own = _direction(products, row.history) if status is None else np.zeros(BASIS)
                weights.append(own)
                slopes.append(float(own @ products[:, -1]))
                statuses.append(status)
            names = [part.split()[0] for part in KEYS.split(", ")]
            yield frame[names].assign(status=pd.Series(statuses, dtype=object).to_numpy(), weights=weights, slope=slopes)

    return plan


def _minimised(pairs: DataFrame, points: DataFrame, totals: DataFrame, config: EstimatorConfig) -> tuple[DataFrame, DataFrame]:
    """(stratum, model, x) at the optimum and (stratum, status, iteration, value) for every stratum.

    ``points``: (stratum, model, unit) of all parameters; ``totals``: (stratum, total), likelihood rows.
    """
    zeros = F.array_repeat(F.lit(0.0), 2 * MEMORY)
    first = stored(_slopes(pairs, points.select("__stratum", "model", F.lit(0.0).alias("t"))))
    slope = (F.coalesce("slope", F.lit(0.0)) * F.col("unit")).alias("g")
    state = stored(points.join(first, ["__stratum", "model"], "left").select("__stratum", "model", "unit", F.lit(0.0).alias("x"), slope, zeros.alias("basis")))
    keys = stored(first.groupBy("__stratum").agg(F.sum("value").alias("value")).join(totals, "__stratum").select(
        "__stratum", "value", F.col("total").cast("double").alias("total"), F.lit(1.0).alias("share"), F.lit(0).alias("iteration"),
        F.lit(0).alias("halvings"), F.lit(0).alias("history"), F.lit(None).cast("string").alias("status"),
    ))
    few = keys.count() <= BROADCAST_ROWS
    per_stratum = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    vector = F.concat("basis", F.array("g"))
    done_states, done_keys = [], []
    while True:
        products = F.array(*[F.sum(vector[i] * vector[j]) for i, j in ENTRIES]).alias("products")
        found = state.groupBy("__stratum").agg(products, F.max(F.abs(F.col("g") / F.col("unit"))).alias("steep"))
        planned = stored(keys.join(found, "__stratum").mapInPandas(_planned(config), KEYS + ", weights array<double>, slope double"))
        left = planned.groupBy().agg(F.count_if(F.col("status").isNull()).alias("open"), F.count_if(F.col("status").isNotNull()).alias("done")).first()
        if left["done"]:
            over = planned.where("status is not null").select("__stratum", "status", "iteration", "value")
            done_keys.append(over)
            done_states.append(state.join(over.select("__stratum"), "__stratum").select("__stratum", "model", (F.col("x") * F.col("unit")).alias("x")))
        if not left["open"]:
            break
        going = per_stratum(planned.where("status is null"))
        move = F.aggregate(F.zip_with(vector, "weights", lambda v, w: v * w), F.lit(0.0), lambda total, term: total + term)
        trial = state.join(going, "__stratum").withColumn("step", F.col("share") * move).withColumn("t", F.col("x") + F.col("step"))
        at = trial.select("__stratum", "model", (F.col("t") * F.col("unit")).alias("t"))
        slopes = stored(_slopes(pairs.join(going.select("__stratum"), "__stratum", "left_semi"), at))
        moved = trial.select("__stratum", "model", "unit", "x", "g", "basis", "step", "t").join(
            slopes.select("__stratum", "model", F.col("slope").alias("new_slope")), ["__stratum", "model"], "left"
        ).withColumn("new_g", F.coalesce("new_slope", F.lit(0.0)) * F.col("unit")).withColumn("change", F.col("new_g") - F.col("g"))
        values = slopes.groupBy("__stratum").agg(F.sum("value").alias("new_value"))
        curved = moved.groupBy("__stratum").agg((F.sum(F.col("step") * F.col("change")) > 0).alias("curved"))
        enough = F.col("new_value") <= F.col("value") + 1e-4 * F.col("share") * F.col("slope") + 1e-12 * F.abs("value")
        judged = planned.where("status is null").join(values, "__stratum").join(curved, "__stratum").withColumn("good", F.coalesce(enough, F.lit(False)))
        keep = lambda name, value: F.when(F.col("good"), value).otherwise(F.col(name)).alias(name)
        judged = stored(judged.select(
            "__stratum", keep("value", F.col("new_value")), "total", F.when(F.col("good"), 1.0).otherwise(F.col("share") / 2).alias("share"),
            keep("iteration", F.col("iteration") + 1), F.when(F.col("good"), 0).otherwise(F.col("halvings") + 1).alias("halvings"),
            F.when(F.col("good") & F.col("curved"), F.least(F.col("history") + 1, F.lit(MEMORY))).otherwise(F.col("history")).alias("history"),
            "status", "good", (F.col("good") & F.col("curved")).alias("learnt"),
        ))
        flags = per_stratum(judged.select("__stratum", "good", "learnt"))
        shifted = F.concat(F.slice("basis", 2, MEMORY - 1), F.array("step"), F.slice("basis", MEMORY + 2, MEMORY - 1), F.array("change"))
        state = stored(moved.join(flags, "__stratum").select(
            "__stratum", "model", "unit", keep("x", F.col("t")), keep("g", F.col("new_g")),
            F.when(F.col("learnt"), shifted).otherwise(F.col("basis")).alias("basis"),
        ))
        keys = judged.drop("good", "learnt")
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(done_states), union(done_keys)


def fit_many(cells: DataFrame, config: EstimatorConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """One result row per stratum, as from the grouped fit, whatever the number of strata and of their models."""
    ties = config.estimator != "bradley_terry_decisive"
    # One text names a stratum from here on, so that null keys are strata like any other.
    cells = cells.withColumn("__fit", _stratum(by))
    own = ("__fit",)
    used = stored(likelihood_rows(cells, config))
    named = lambda df, *columns: df.select(F.col("__fit").alias("__stratum"), *columns)
    models = stored(named(models_of(cells, own), "model_id"))
    keys = cells.select(F.col("__fit").alias("__stratum"), *by).distinct()
    same = lambda df, name: named(df, "n").groupBy("__stratum").agg(F.sum("n").alias(name))
    facts = keys.join(models.groupBy("__stratum").agg(F.count(F.lit(1)).cast("int").alias("models")), "__stratum")
    facts = facts.join(same(cells, "rows"), "__stratum").join(same(used, "likelihood_rows"), "__stratum", "left")
    lost = named(dropped_models(cells, config, own)).groupBy("__stratum").agg(F.lit(True).alias("dropped"))
    graph = named(graph_facts(used, ["__fit"]), F.col("edge_count").cast("int").alias("edges"), F.col("component_count").cast("int").alias("components"))
    strong = named(strongly_connected(used, ["__fit"], ties=ties), "strongly_connected")
    tied = named(tie_support(cells, config, own), "identifiable")
    for more in (lost, graph, strong, tied):
        facts = facts.join(more, "__stratum", "left")
    status = (
        F.when(F.coalesce("likelihood_rows", F.lit(0)) == 0, "ZERO_LIKELIHOOD_ROWS")
        .when(F.col("models") < 2, "INSUFFICIENT_MODELS")
        .when(F.col("dropped"), "MODEL_DROPPED_BY_OUTCOME_POLICY")
        .when(F.col("components") != 1, "DISCONNECTED_GRAPH")
        .when(F.lit(ties) & ~F.col("identifiable"), "UNIDENTIFIABLE_TIE_PARAMETER")
        .when(~F.col("strongly_connected"), "SEPARATION")
    )
    facts = stored(facts.withColumn("guard", status).withColumn("likelihood_rows", F.coalesce("likelihood_rows", F.lit(0))))
    fine = facts.where("guard is null").select("__stratum")
    ids = models.groupBy("__stratum").agg(F.array_sort(F.collect_list("model_id")).alias("model_ids"))
    if fine.isEmpty():
        out = facts.join(ids, "__stratum").withColumn("status", F.col("guard"))
        return _result(out, by)
    pairs = stored(_pairs(used).join(fine, "__stratum", "left_semi"))
    battles = F.col("won") + F.col("lost") + F.col("tied")
    both = pairs.select("__stratum", F.explode(F.array("low", "high")).alias("model"), battles.alias("n"))
    if ties:
        both = both.unionByName(pairs.select("__stratum", F.lit(NO_MODEL).alias("model"), battles.alias("n")))
    points = both.groupBy("__stratum", "model").agg((2 / F.sqrt(F.sum("n"))).alias("unit"))
    totals = facts.select("__stratum", F.col("likelihood_rows").alias("total"))
    states, over = _minimised(pairs, stored(points), totals, config)
    states = stored(states)
    found = states.where(F.col("model") != NO_MODEL)
    middle = found.groupBy("__stratum").agg(F.avg("x").alias("middle"))
    scores = found.join(middle, "__stratum").select(F.col("__stratum").alias("fit"), F.col("model").alias("model_id"), (F.col("x") - F.col("middle")).alias("score"))
    ranked = dense_ranks(stored(scores), ("fit",))
    listed = ranked.groupBy(F.col("fit").alias("__stratum")).agg(F.array_sort(F.collect_list(F.struct("model_id", "score", "rank"))).alias("m"))
    nu = states.where(F.col("model") == NO_MODEL).select("__stratum", F.exp("x").alias("tie_parameter"))
    done = over.join(listed, "__stratum").join(nu, "__stratum", "left").select("__stratum", F.col("status").alias("end"), "iteration", "value", "m", "tie_parameter")
    good = F.col("end") == "SUCCESS"
    out = facts.join(ids, "__stratum").join(done, "__stratum", "left").select(
        *[c for c in facts.columns], "model_ids", F.coalesce("guard", "end").alias("status"), F.col("iteration").alias("iterations"),
        F.col("value").alias("objective"), F.when(good, F.col("tie_parameter")).alias("tie_parameter"),
        F.when(good, F.col("m.score")).alias("scores"), F.when(good, F.col("m.rank")).alias("ranks"),
    )
    return _result(out, by)


def _result(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    have = set(rows.columns)
    shown = [(F.col(name) if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in RESULT]
    # What a guard stops early is not known about its stratum, as in the grouped fit.
    early = {"edges": ("ZERO_LIKELIHOOD_ROWS", "INSUFFICIENT_MODELS", "MODEL_DROPPED_BY_OUTCOME_POLICY")}
    early["components"] = early["edges"]
    frame = rows.select(*by, *shown)
    return frame.withColumns({name: F.when(~F.col("status").isin(*codes), F.col(name)) for name, codes in early.items()})


def fit_large(cells: DataFrame, config: EstimatorConfig, keys: dict[str, Any]) -> DataFrame:
    """One result row for the cells of one stratum, named by ``keys``."""
    found = fit_many(cells.drop(*keys), config)
    return found.withColumns({name: F.lit(value) for name, value in keys.items()}) if keys else found
