"""The robust estimate against a minimum covariance determinant in NumPy, and the verdict that follows from it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairpref.llm import quality_rules as q

FLOOR = np.diag([(x * q.SCALE) ** 2 for x in q.FLOOR])


def statistics(seed, size=200, odd=30):
    r = np.random.default_rng(seed)
    mixed = r.normal(size=(5, 5))
    rows = r.normal(size=(size, 5)) @ mixed * 40 + [5000, 1600, 100, 50, 60]
    rows[:odd] = r.normal(size=(odd, 5)) * 30 + [9000, 2600, 900, 700, 20]
    return np.round(rows).astype(int)


def concentrated(rows, mean, cov):
    """Steps from one start, with the bins and the share of the library."""
    for _ in range(50):
        d = np.einsum("ij,jk,ik->i", rows - mean, np.linalg.inv(cov), rows - mean)
        bins = np.floor(np.log2(np.round(np.minimum(d, 1e6) * q.SCALE) + 1) * 64)
        near = rows[bins <= np.percentile(bins, 100 * q.KEPT_SHARE)]
        new = near.mean(0), np.cov(near.T, bias=True) + FLOOR
        if np.allclose(new[1], cov):
            break
        mean, cov = new
    return np.linalg.slogdet(cov)[1], mean, cov


def brute(rows, starts=60):
    """The least determinant over many random starts."""
    r, found = np.random.default_rng(0), []
    for _ in range(starts):
        some = rows[r.choice(len(rows), 50, replace=False)]
        found.append(concentrated(rows, some.mean(0), np.cov(some.T, bias=True) + FLOOR))
    return min(found, key=lambda x: x[0])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_estimate_has_the_least_determinant(spark, seed):
    rows = statistics(seed)
    good = spark.createDataFrame([("g", *map(int, x)) for x in rows], "group string, " + ", ".join(f"{x} long" for x in q.X))
    found = q.estimates(good).first().asDict()
    factor = np.array([[found[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    det, mean, cov = brute(rows)
    assert 2 * np.log(np.diag(factor)).sum() <= det + 0.05
    # Parts of nearly the same determinant have nearly the same centre.
    assert (np.abs(np.array([found[f"m{i}"] for i in range(5)]) - mean) < 0.2 * np.sqrt(np.diag(cov))).all()
    # The verdict: planted rows lie beyond the limit, the others within it.
    estimate = spark.createDataFrame([tuple(found.values())], ", ".join(f"`{k}` {'string' if k == 'group' else 'double'}" for k in found))
    d = q._distances(good, estimate.drop("scale")).select((F.col("d") / q.SCALE / found["scale"]).alias("d")).collect()
    far = np.array([x.d for x in d]) > q.LIMIT
    own = np.einsum("ij,jk,ik->i", rows - mean, np.linalg.inv(cov), rows - mean)
    own = own / (np.median(own) / q.MEDIAN) > q.LIMIT
    assert (far == own).mean() > 0.98 and far[:30].all() and not far[30:].any()


def test_verdicts_of_documents(spark):
    """Whole way: texts like each other stay, a text of another make goes, base failures go by the simple limits."""
    r = np.random.default_rng(4)
    say = lambda n: " ".join("".join(r.choice(list("abcdefgh"), r.integers(3, 7))) for _ in range(n))
    rows = [(i, say(int(r.integers(80, 160))), "en", "s", 1) for i in range(150)]
    odd = " ".join("#$%&|" * 6 + str(i) for i in range(300))
    rows += [(200, odd, "en", "s", 1), (201, "too short", "en", "s", 1), (202, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    out = {x.doc_id: x for x in q.judge(docs).collect()}
    assert all(out[i].kept for i in range(150)) and not any(out[i].kept for i in (200, 201, 202))
    assert not out[200].base_failed and out[201].base_failed and out[202].base_failed
    kept = q.keep_kept(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(range(150))
