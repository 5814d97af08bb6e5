"""What must not depend on size: the draws of a bootstrap, the split of a classifier, empty and odd inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairpref.functions.conversation import plain_json
from pairpref.operators import bootstrap, estimate, graph
from pairpref.operators.classify import stratified_split
from pairpref.operators.estimate import REQUIRED_COLUMNS, EstimationError, EstimatorConfig, count_cells, fit, fit_cells
from pairpref.operators.kernel import dense_ranks as kernel_ranks
from pairpref.operators.largefit import fit_many
from pairpref.schema import A_WIN, B_WIN, RANK_TOLERANCE, TIE
from pairpref.session import cut

SCHEMA = "model_a_id string, model_b_id string, canonical_outcome string, judge_cluster_id string"


@pytest.fixture(scope="module")
def battles(spark):
    rows = [(f"m{i % 4}", f"m{(i + 1 + i % 2) % 4}", [A_WIN, B_WIN, TIE][i * 7 % 3], f"j{i % 37}") for i in range(900)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("draws", ["blocked", "hashed"])
def test_draws_do_not_depend_on_the_number_of_models(battles, monkeypatch, draws):
    config = bootstrap.BootstrapConfig(3, 7, draws=draws, estimator=EstimatorConfig(tolerance=1e-7))
    fits = lambda: {r.replicate: r.tie_parameter for r in bootstrap.run_bootstrap(battles, config).fits.collect()}
    few = fits()
    monkeypatch.setattr(bootstrap, "DENSE_MODELS", 2)
    monkeypatch.setattr(estimate, "DENSE_MODELS", 2)
    many = fits()
    assert few.keys() == many.keys() and all(abs(few[r] - many[r]) < 1e-6 for r in few)


def test_split_does_not_depend_on_partitioning(spark):
    rows = spark.range(30_000).select("id", F.concat(F.lit("c"), F.col("id") % 3).alias("label"))
    split = lambda n: {r.id for r in stratified_split(rows.repartition(n), "label", "id", 42).where("train").collect()}
    one = split(1)
    assert one == split(13) and abs(len(one) / 30_000 - 0.8) < 0.01


def test_empty_population(spark):
    nothing = spark.createDataFrame([], ", ".join(f"`{name}` string" for name in REQUIRED_COLUMNS))
    with pytest.raises(EstimationError) as error:
        fit(nothing, EstimatorConfig("davidson"))
    assert "ZERO_LIKELIHOOD_ROWS" in str(error.value)


def test_deep_nesting_is_a_parse_error():
    assert plain_json("[" * 20_000) is None and plain_json("[" + "9" * 5_000 + "]") is None


def test_fits_of_many_strata_in_one_loop(spark, battles):
    """Strata of every status at once, and the optimum of the grouped fit, ranks included."""
    config = EstimatorConfig("davidson", tolerance=1e-8)
    rows = [(f"m{i % 4}", f"m{(i + 1 + i % 2) % 4}", [A_WIN, B_WIN, TIE][(i * 7 + s * (i % 5)) % 3], f"s{s}") for s in range(4) for i in range(400)]
    rows += [("a", "b", A_WIN, "won"), ("b", "c", TIE, "won"), ("a", "b", A_WIN, "apart"), ("c", "d", TIE, "apart"), ("a", "b", "tie_bothbad", "bad"), ("a", "b", A_WIN, "plain"), ("b", "a", A_WIN, "plain")]
    rows += [("a", "b", A_WIN, None), ("b", "a", A_WIN, None), ("a", "b", TIE, None)]
    cells = cut(count_cells(spark.createDataFrame(rows, "model_a_id string, model_b_id string, canonical_outcome string, s string"), ("s",)))
    one = {r.s: r for r in fit_cells(cells, config, ("s",)).collect()}
    many = {r.s: r for r in fit_many(cells, config, ("s",)).collect()}
    assert one.keys() == many.keys() and {s: r.status for s, r in one.items()} == {s: r.status for s, r in many.items()}
    assert {r.status for r in one.values()} >= {"SUCCESS", "SEPARATION", "DISCONNECTED_GRAPH", "ZERO_LIKELIHOOD_ROWS", "UNIDENTIFIABLE_TIE_PARAMETER"}
    for s, r in one.items():
        other = many[s]
        assert (r.models, r.rows, r.likelihood_rows, r.edges, r.components, r.model_ids) == (other.models, other.rows, other.likelihood_rows, other.edges, other.components, other.model_ids)
        if r.status == "SUCCESS":
            assert abs(r.tie_parameter - other.tie_parameter) < 1e-5 and max(abs(x - y) for x, y in zip(r.scores, other.scores)) < 1e-5
            assert r.ranks == other.ranks and abs(r.objective - other.objective) < 1e-6 * r.objective


def test_ranks_follow_their_heads_over_slices(spark):
    """Chains of scores closer than the tolerance, equal ones, and strata over many slices, against the fold."""
    import random

    import numpy as np

    r = random.Random(5)
    rows = []
    for s in range(3):
        score = 0.0
        for i in range(400):
            score -= r.choice([0.0, RANK_TOLERANCE * 0.4, RANK_TOLERANCE * 0.9, RANK_TOLERANCE * 1.1, 1e-3])
            rows.append((f"s{s}" if s else None, f"m{i:04d}", score))
    frame = spark.createDataFrame(rows, "s string, model_id string, score double").repartition(7)
    found = {(x.s, x.model_id): x["rank"] for x in estimate.dense_ranks(frame, ("s",)).collect()}
    for s in (None, "s1", "s2"):
        own = [x for x in rows if x[0] == s]
        assert [found[s, m] for _, m, _ in own] == kernel_ranks(np.array([x[2] for x in own])).tolist()


def test_strong_components_of_long_chains(spark, monkeypatch):
    """A chain of 5,000 models, and graphs larger than a task: contracted, or walked where nothing contracts."""
    two_ways = [(f"m{i:05d}", f"m{i + 1:05d}", TIE, "chain") for i in range(5000)]
    one_way = [(f"m{i:05d}", f"m{i + 1:05d}", A_WIN, "line") for i in range(26)]
    ring = [(f"m{i:05d}", f"m{(i + 1) % 27:05d}", A_WIN, "ring") for i in range(27)]
    frame = spark.createDataFrame(two_ways + one_way + ring, "model_a_id string, model_b_id string, canonical_outcome string, s string")
    expected = {"chain": (5001, 5001, 5001, True), "line": (27, 27, 1, False), "ring": (27, 27, 27, True)}
    for limit in (500_000, 25):
        monkeypatch.setattr(graph, "ARCS_A_TASK", limit)
        rows = frame if limit > 25 else frame.where("s <> 'chain' or model_a_id < 'm00120'")
        found = {r.s: tuple(r)[1:] for r in graph.strongly_connected(rows, ["s"], ties=True).collect()}
        assert found == expected if limit > 25 else found == expected | {"chain": (121, 121, 121, True)}
