"""Draws: shares down the tree, cells against a recomputation in one process, row draws found in prefix sums."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairpref.operators import resample
from pairpref.operators.bootstrap import BootstrapConfig, hashed_cells
from pairpref.schema import A_WIN, B_WIN, TIE


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(f"u{i % 90:03d}", i * 7 % 13, 1 + i % 3) for i in range(400)]
    return spark.createDataFrame(rows, "unit string, code long, n long").groupBy("unit", "code").agg(F.sum("n").alias("n"))


def test_shares_of_a_tree_add_up_and_follow_the_weights():
    tree = resample.ShareTree.over([5, 0, 20, 75, 100])
    assert tree.weights[1] == 200 and tree.leaves == 8
    streams = resample.Streams(3)
    shares = np.array([[tree.share(streams, r, b) for b in range(5)] for r in range(1, 601)])
    assert (shares.sum(1) == 200).all() and (shares[:, 1] == 0).all()
    expected, spread = np.array([5, 0, 20, 75, 100]), np.sqrt(200 * np.array([5, 0, 20, 75, 100]) / 200 * (1 - np.array([5, 0, 20, 75, 100]) / 200))
    assert (np.abs(shares.mean(0) - expected) <= 5 * spread / np.sqrt(600)).all()
    assert np.abs(shares.std(0) - spread).max() < 1


def test_blocked_cells_equal_the_multiplicities_of_their_units(spark, cells):
    found = {(r.replicate, r.code): r.n for r in resample.blocked_cells(cells, 120, 5, 7).collect()}
    times = resample.blocked_multiplicities(cells, 120, 5, 7).collect()
    again, per = Counter(), Counter()
    own = cells.collect()
    by_unit = {u: [(r.code, r.n) for r in own if r.unit == u] for u in {r.unit for r in own}}
    for t in times:
        per[t.replicate] += t.multiplicity
        for code, n in by_unit[t.unit]:
            again[t.replicate, code] += n * t.multiplicity
    assert found == dict(again) and set(per.values()) == {90}


def test_draws_depend_on_the_configuration_alone(cells):
    key = lambda df: sorted((r.replicate, r.code, r.n) for r in df.collect())
    one = key(resample.blocked_cells(cells.repartition(1), 60, 9, 4))
    assert one == key(resample.blocked_cells(cells.repartition(23), 60, 9, 4))
    assert one != key(resample.blocked_cells(cells, 60, 9, 5)) and one != key(resample.blocked_cells(cells, 60, 10, 4))
    few = [x for x in one if x[0] <= 7]
    assert few == key(resample.blocked_cells(cells, 7, 9, 4))  # a replicate does not depend on how many there are


def test_row_draws_spend_every_draw_on_known_cells(spark):
    counts = {code: 1 + code * code % 50 for code in range(40)}
    frame = spark.createDataFrame(list(counts.items()), "code long, n long")
    total, sums = sum(counts.values()), Counter()
    drawn = resample.row_resample_cells(frame, 400, 4, 6).collect()
    for r in drawn:
        sums[r.replicate] += r.n
    assert set(sums.values()) == {total} and len(sums) == 400
    mean = {c: sum(r.n for r in drawn if r.code == c) / 400 for c in counts}
    assert all(abs(mean[c] - n) < 5 * np.sqrt(n / 400) for c, n in counts.items())


def test_hashed_row_cells_cell_by_cell(spark):
    battles = [(f"m{i % 3}", f"n{i % 4}", [A_WIN, B_WIN, TIE][i % 5 % 3], f"j{i}", str(i)) for i in range(500)]
    frame = spark.createDataFrame(battles, "model_a_id string, model_b_id string, canonical_outcome string, judge_cluster_id string, battle_id string")
    found = {(r.replicate, r.model_a_id, r.model_b_id, r.canonical_outcome): r.n for r in hashed_cells(frame, BootstrapConfig(4, 8, "battle_row", "hashed")).collect()}
    order = sorted(b[:3] for b in battles)
    again = Counter()
    for r in range(1, 5):
        for d in range(500):
            again[(r, *order[int(hashlib.md5(f"8|{r}|{d}".encode()).hexdigest()[:15], 16) % 500])] += 1
    assert found == dict(again)


@pytest.mark.parametrize("wrong", [{"replicates": 0}, {"seed": -1}, {"blocks": 0}, {"blocks": True}, {"draws": "other"}, {"confidence": 1.0}, {"resampling_unit": "x"}])
def test_configurations_that_mean_nothing(wrong):
    with pytest.raises(ValueError, match=next(iter(wrong))):
        BootstrapConfig(**{"replicates": 3, "seed": 1} | wrong)


def test_blocks_are_part_of_the_identity():
    assert BootstrapConfig(3, 1, blocks=8).to_dict() != BootstrapConfig(3, 1).to_dict()
    assert "blocks" not in BootstrapConfig(3, 1, draws="hashed").to_dict()
