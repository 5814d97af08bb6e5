"""Fits against closed forms, invariances, failure codes, and the distributed fit against the grouped one."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairpref.operators.estimate import (
    EstimationError,
    EstimatorConfig,
    count_cells,
    dense_ranks,
    fit,
    fit_cells,
    scores_long,
)
from pairpref.operators.graph import components, graph_facts, strongly_connected
from pairpref.operators.kernel import dense_ranks as kernel_ranks
from pairpref.operators.kernel import gradient, objective
from pairpref.operators.largefit import fit_large, fit_many
from pairpref.schema import A_WIN, B_WIN, BOTH_BAD, TIE, UNKNOWN
from pairpref.session import cut

BT, DAVIDSON, COALESCED = (EstimatorConfig(n) for n in ("bradley_terry_decisive", "davidson", "davidson_coalesced_ties"))


def cells_of(spark, *counts):
    return cut(spark.createDataFrame(list(counts), "model_a_id string, model_b_id string, canonical_outcome string, n long"))


def pair(a, b, won, lost, tied=0):
    return [(a, b, o, n) for o, n in ((A_WIN, won), (B_WIN, lost), (TIE, tied)) if n]


def scores(fits):
    return {r["model_id"]: r["score"] for r in scores_long(fits).collect()}


THREE = pair("a", "b", 200, 100) + pair("b", "c", 200, 100) + pair("a", "c", 400, 100)


def test_two_models_differ_by_log_odds(spark):
    found = scores(fit_cells(cells_of(spark, *pair("a", "b", 300, 100)), BT))
    assert found["a"] - found["b"] == pytest.approx(math.log(3), abs=1e-9)
    assert found["a"] + found["b"] == pytest.approx(0, abs=1e-10)


def test_three_models(spark):
    found = fit_cells(cells_of(spark, *THREE), BT)
    assert [scores(found)[m] for m in "abc"] == pytest.approx([math.log(2), 0, -math.log(2)], abs=1e-8)
    assert found.first()["ranks"] == [1, 2, 3] and found.first()["tie_parameter"] is None


def test_symmetric_ties(spark):
    found = fit_cells(cells_of(spark, *pair("a", "b", 100, 100, 200)), DAVIDSON).first()
    assert found["tie_parameter"] == pytest.approx(2.0, abs=1e-9) and found["ranks"] == [1, 1]
    bad = cells_of(spark, *pair("a", "b", 100, 100, 100), ("a", "b", BOTH_BAD, 100))
    assert fit_cells(bad, COALESCED).first()["tie_parameter"] == pytest.approx(2.0, abs=1e-9)
    assert fit_cells(bad, DAVIDSON).first()["tie_parameter"] == pytest.approx(1.0, abs=1e-9)


def test_davidson_recovers_known_scores(spark):
    truth, rows = {"a": math.log(2), "b": 0.0, "c": -math.log(2)}, []
    for x, y in (("a", "b"), ("b", "c"), ("a", "c")):
        ex, ey = math.exp(truth[x]), math.exp(truth[y])
        total = ex + ey + math.sqrt(ex * ey)
        rows += pair(x, y, round(10_000 * ex / total), round(10_000 * ey / total), round(10_000 * math.sqrt(ex * ey) / total))
    found = fit_cells(cells_of(spark, *rows), DAVIDSON)
    assert scores(found) == pytest.approx(truth, abs=0.03) and found.first()["tie_parameter"] == pytest.approx(1, abs=0.03)


def test_invariances(spark):
    base = fit_cells(cells_of(spark, *THREE), BT).first()
    swap = {A_WIN: B_WIN, B_WIN: A_WIN}
    swapped = fit_cells(cells_of(spark, *[(b, a, swap[o], n) for a, b, o, n in THREE]), BT).first()
    assert swapped["scores"] == pytest.approx(base["scores"], abs=1e-9)
    doubled = fit_cells(cells_of(spark, *[(a, b, o, 2 * n) for a, b, o, n in THREE]), BT).first()
    assert doubled["scores"] == pytest.approx(base["scores"], abs=1e-9)
    assert doubled["objective"] == pytest.approx(2 * base["objective"])
    renamed = fit_cells(cells_of(spark, *[("z" + a, "z" + b, o, n) for a, b, o, n in THREE]), BT).first()
    assert renamed["scores"] == pytest.approx(base["scores"], abs=1e-12)


FAILURES = [
    (BT, pair("a", "b", 3, 0), "SEPARATION"),
    (BT, pair("a", "b", 3, 1) + pair("c", "d", 3, 1), "DISCONNECTED_GRAPH"),
    (BT, [("a", "b", TIE, 3)], "ZERO_LIKELIHOOD_ROWS"),
    (BT, pair("a", "b", 3, 1) + [("a", "c", TIE, 2)], "MODEL_DROPPED_BY_OUTCOME_POLICY"),
    (DAVIDSON, pair("a", "b", 3, 1), "UNIDENTIFIABLE_TIE_PARAMETER"),
    (DAVIDSON, [("a", "b", TIE, 3)], "UNIDENTIFIABLE_TIE_PARAMETER"),
    (DAVIDSON, pair("a", "b", 3, 1, 1) + pair("c", "a", 2, 0), "SEPARATION"),
    (DAVIDSON, pair("a", "b", 3, 0, 1), "SUCCESS"),
]


@pytest.mark.parametrize(("config", "rows", "status"), FAILURES)
def test_status_codes(spark, config, rows, status):
    cells = cells_of(spark, *rows)
    assert fit_cells(cells, config).first()["status"] == status


@pytest.mark.parametrize("config", [BT, DAVIDSON])
def test_status_codes_of_the_loop_for_many_models(spark, config):
    """All cases of one policy as strata of one call."""
    cases = [(str(i), rows, status) for i, (own, rows, status) in enumerate(FAILURES) if own is config]
    rows = [(*row, case) for case, counts, _ in cases for row in counts]
    cells = cut(spark.createDataFrame(rows, "model_a_id string, model_b_id string, canonical_outcome string, n long, case string"))
    assert {r["case"]: r["status"] for r in fit_many(cells, config, ("case",)).collect()} == {case: status for case, _, status in cases}


def test_input_codes(spark):
    schema = "model_a_id string, model_b_id string, canonical_outcome string, battle_id string"
    for row, code in (
        ((" ", "b", A_WIN, "1"), "INVALID_MODEL_ID"),
        (("a", "a", A_WIN, "1"), "SELF_COMPARISON"),
        (("a", "b", UNKNOWN, "1"), "INVALID_OUTCOME"),
    ):
        with pytest.raises(EstimationError) as error:
            fit(spark.createDataFrame([row], schema), BT)
        assert error.value.code == code
    with pytest.raises(EstimationError) as error:
        fit(spark.createDataFrame([("a",)], "model_a_id string"), BT)
    assert error.value.code == "MISSING_REQUIRED_COLUMNS"


def test_strata_are_independent(spark):
    rows = [("x", *c) for c in THREE] + [("y", *c) for c in pair("a", "b", 3, 0)]
    cells = cut(spark.createDataFrame(rows, "s string, model_a_id string, model_b_id string, canonical_outcome string, n long"))
    found = {r["s"]: r for r in fit_cells(cells, BT, ("s",)).collect()}
    assert found["x"]["status"] == "SUCCESS" and found["y"]["status"] == "SEPARATION"
    assert found["x"]["scores"][0] == pytest.approx(math.log(2), abs=1e-8)


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    i, j = np.array([0, 0, 1]), np.array([1, 2, 2])
    counts = [rng.integers(1, 50, 3).astype(float) for _ in range(3)]
    theta, log_nu, h = rng.normal(size=3), 0.3, 1e-6
    slope, tie_slope = gradient(theta, log_nu, i, j, *counts)
    for m in range(3):
        step = np.eye(3)[m] * h
        numeric = (objective(theta + step, log_nu, i, j, *counts) - objective(theta - step, log_nu, i, j, *counts)) / (2 * h)
        assert slope[m] == pytest.approx(numeric, abs=1e-4)
    numeric = (objective(theta, log_nu + h, i, j, *counts) - objective(theta, log_nu - h, i, j, *counts)) / (2 * h)
    assert tie_slope == pytest.approx(numeric, abs=1e-4)


def test_large_fit_agrees_with_grouped_fit(spark):
    rng, rows = np.random.default_rng(3), []
    names = [f"m{i:02d}" for i in range(12)]
    for x in range(12):
        for y in range(x + 1, 12):
            rows += pair(names[x], names[y], *(int(v) for v in rng.integers(1, 30, 3)))
    cells = cells_of(spark, *rows)
    for config in (BT, DAVIDSON):
        grouped, large = fit_cells(cells, config).first(), fit_large(cells, config, {}).first()
        assert large["scores"] == pytest.approx(grouped["scores"], abs=1e-5)
        assert large["objective"] == pytest.approx(grouped["objective"], rel=1e-9)
        assert large["ranks"] == grouped["ranks"]


def test_rank_groups_hang_on_their_head(spark):
    values = [0.0, -0.8e-10, -1.6e-10, -1.0]
    rows = spark.createDataFrame([(f"m{i}", v) for i, v in enumerate(values)], "model_id string, score double")
    found = [r["rank"] for r in dense_ranks(rows).orderBy("model_id").collect()]
    assert found == [1, 1, 2, 3] == kernel_ranks(np.array(values)).tolist()


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.format_string("n%04d", "id").alias("u"), F.format_string("n%04d", F.col("id") + 1).alias("v"))
    edges = edges.where("u <> 'n0100'")
    vertices = edges.selectExpr("u as node").union(edges.selectExpr("v")).distinct()
    found = components(edges, vertices, []).groupBy("component").count().collect()
    assert sorted(r["count"] for r in found) == [101, 200]


def test_graph_facts_and_strength(spark):
    cells = cells_of(spark, *pair("a", "b", 2, 0), *pair("b", "c", 2, 0), *pair("c", "a", 1, 0), *pair("d", "e", 1, 1))
    facts = graph_facts(cells, []).first()
    assert (facts["node_count"], facts["edge_count"], facts["component_count"]) == (5, 4, 2)
    cycle = cells.where("model_a_id <> 'd'")
    assert strongly_connected(cycle, [], ties=False).first()["strongly_connected"]
    assert not strongly_connected(cells, [], ties=False).first()["strongly_connected"]


def test_config_is_checked():
    for bad in ({"estimator": "elo"}, {"max_iterations": 0}, {"tolerance": float("nan")}):
        with pytest.raises(ValueError):
            EstimatorConfig(**bad)


def test_counting_is_the_same_as_expanding(spark):
    rows = [(a, b, o) for a, b, o, n in THREE for _ in range(n)]
    expanded = spark.createDataFrame(rows, "model_a_id string, model_b_id string, canonical_outcome string")
    counted = {tuple(r) for r in count_cells(expanded).collect()}
    assert counted == set(THREE)
