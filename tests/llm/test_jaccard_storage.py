"""What op8's join stores and shuffles for each shingle, and sets whose stored part is too short."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairpref.llm import jaccard_join
from tests.llm.test_operators import groups


def expected(found):
    return sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in found)


@pytest.fixture
def kept(monkeypatch):
    """Columns, rows and bytes of ``shingles`` of every table the join stores."""
    seen, before = [], jaccard_join.stored

    def spied(df, **options):
        done = before(df, **options)
        size = F.sum(F.length("shingles")) if "shingles" in done.columns else F.lit(0)
        seen.append((tuple(done.columns), *done.agg(F.count(F.lit(1)), size).first()))
        return done

    monkeypatch.setattr(jaccard_join, "stored", spied)
    return seen


def test_sets_are_not_stored_whole(spark, kept):
    """120 texts that link with nothing but two: 8 bytes for about a third of the shingles, not for all."""
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(200))) for i in range(120)]
    rows.append((500, rows[7][1] + " end"))
    found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert expected(found) == sorted(groups(rows))
    shingles = sum(x.n_shingles for x in found)
    assert sum(size or 0 for _, _, size in kept) < 0.4 * 8 * shingles


def test_heads_beyond_the_stored_part(spark, kept):
    """Long shingles shared with longer texts are all frequent: sets of the shorter ones are made from their texts again."""
    r = random.Random(4)
    common = [f"boilerplate{'x' * 30}{i}" for i in range(60)]
    rows = [(200 + i, " ".join(common + [f"k{r.randrange(10**5)}" for _ in range(250)])) for i in range(12)]
    for i in range(24):
        own = [f"k{r.randrange(10**5)}" for _ in range(80)]
        rows.append((2 * i, " ".join(common + own)))
        if i % 3 == 0:
            own[40] = "changed"
            rows.append((2 * i + 1, " ".join(common + own)))
    rows += [(100, rows[12][1]), (None, rows[13][1]), (101, None), (102, "two words")]
    found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert expected(found) == sorted(groups(rows))
    again = [n for columns, n, _ in kept if columns == ("name", "n_shingles", "doc_key", "print")]
    assert again and again[0] == 24 + 8


def test_chosen_sets_of_tiles_are_found_without_moving_members(spark, monkeypatch):
    """Blocks of many tiles: leaders and outsiders are named by a broadcast, so members move only to their search tasks."""
    monkeypatch.setattr(jaccard_join, "TILE", 300)
    small, hinted = jaccard_join.broadcast_if_small, []
    monkeypatch.setattr(jaccard_join, "broadcast_if_small", lambda df: hinted.append(tuple(df.columns)) or small(df))
    r = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(w if r.random() > 0.02 else f"z{r.randrange(9999)}" for w in base)) for i in range(30)]
    found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert expected(found) == sorted(groups(rows))
    assert hinted.count(("name",)) == 2


def entry_bytes(buckets, last):
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(r.integers(-(2**63), 2**63, 40)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
        ["name", "n_shingles", "shingles"],
    )
    made = list(jaccard_join._heads(85, buckets, last)(iter([batch])))
    return sum(len(x.as_py()) for b in made for x in b.column("entries")) / sum(int(jaccard_join.head_size(len(s))) for s in sets)


class Sent:
    value = np.empty(0, np.uint64)


@pytest.mark.parametrize("buckets", [3, 500])
def test_bytes_of_a_head_shingle(buckets):
    """Before: 20 in both passes."""
    assert (entry_bytes(buckets, None), entry_bytes(buckets, Sent)) == (8, 16)


def test_size_codes_keep_the_order():
    n = np.unique(np.concatenate([np.arange(1, 5000), 2 ** np.arange(32), 2 ** np.arange(1, 33) - 1, np.random.default_rng(0).integers(1, 2**32, 2000)])).astype(np.int64)
    codes = jaccard_join.size_codes(n)
    assert (np.diff(codes.astype(np.int64)) >= 0).all() and codes.max() < 2**16
    assert (jaccard_join.least_size(codes) <= n).all() and (n < jaccard_join.least_size(codes + np.uint64(1))).all()
    assert (jaccard_join.least_size(codes)[n < 4096] == n[n < 4096]).all()
