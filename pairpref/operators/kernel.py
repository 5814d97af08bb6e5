"""The small dense part of a paired-comparison fit: at most a few hundred models, counts already grouped.

Both likelihoods are concave conditional logits that are linear in the scores and the log tie parameter, so a
damped Newton iteration with a rank-one gauge term finds the optimum in a handful of steps.
"""

from __future__ import annotations

import numpy as np

from pairpref.schema import RANK_TOLERANCE


def reach(adjacency: np.ndarray, start: int) -> np.ndarray:
    """Which nodes can be reached from ``start``."""
    seen = np.zeros(len(adjacency), dtype=bool)
    seen[start] = True
    frontier = seen
    while frontier.any():
        frontier = adjacency[frontier].any(axis=0) & ~seen
        seen = seen | frontier
    return seen


def component_count(adjacency: np.ndarray) -> int:
    left = np.ones(len(adjacency), dtype=bool)
    count = 0
    while left.any():
        count += 1
        left &= ~reach(adjacency, int(np.flatnonzero(left)[0]))
    return count


def probabilities(theta: np.ndarray, log_nu: float, i: np.ndarray, j: np.ndarray):
    """P(i wins), P(j wins), P(tie) and the log denominator per pair; no ties when log_nu is -inf."""
    a, b = theta[i], theta[j]
    c = log_nu + 0.5 * (a + b)
    top = np.maximum(np.maximum(a, b), c)
    log_sum = top + np.log(np.exp(a - top) + np.exp(b - top) + np.exp(c - top))
    return np.exp(a - log_sum), np.exp(b - log_sum), np.exp(c - log_sum), log_sum


def objective(theta, log_nu, i, j, won, lost, tied) -> float:
    log_sum = probabilities(theta, log_nu, i, j)[3]
    chosen = won * theta[i] + lost * theta[j]
    if np.isfinite(log_nu):
        chosen = chosen + tied * (log_nu + 0.5 * (theta[i] + theta[j]))
    return float(np.sum((won + lost + tied) * log_sum - chosen))


def gradient(theta, log_nu, i, j, won, lost, tied):
    """Expected minus observed points per model, and expected minus observed ties."""
    k, n = len(theta), won + lost + tied
    pi, pj, pt, _ = probabilities(theta, log_nu, i, j)
    at_i = n * (pi + 0.5 * pt) - (won + 0.5 * tied)
    at_j = n * (pj + 0.5 * pt) - (lost + 0.5 * tied)
    return np.bincount(i, at_i, k) + np.bincount(j, at_j, k), float(np.sum(n * pt - tied))


def _curvature(theta, log_nu, i, j, n) -> np.ndarray:
    k = len(theta)
    pi, pj, pt, _ = probabilities(theta, log_nu, i, j)
    si, sj = pi + 0.5 * pt, pj + 0.5 * pt
    h = np.zeros((k + 1, k + 1))
    np.add.at(h, (i, i), n * (pi + 0.25 * pt - si * si))
    np.add.at(h, (j, j), n * (pj + 0.25 * pt - sj * sj))
    cross = n * (0.25 * pt - si * sj)
    np.add.at(h, (i, j), cross)
    np.add.at(h, (j, i), cross)
    h[:k, k] = np.bincount(i, n * pt * (0.5 - si), k) + np.bincount(j, n * pt * (0.5 - sj), k)
    h[k, :k] = h[:k, k]
    h[k, k] = np.sum(n * pt * (1.0 - pt))
    h[:k, :k] += 1.0 / k  # the level of the scores is free; this fixes it
    return h


def newton(k, i, j, won, lost, tied, *, ties: bool, max_iterations: int, tolerance: float):
    """(theta, log_nu, objective, iterations, converged), scores centred on zero."""
    theta, log_nu = np.zeros(k), 0.0 if ties else -np.inf
    n = won + lost + tied
    goal = tolerance * max(1.0, float(n.sum()))
    size = k + 1 if ties else k
    value = objective(theta, log_nu, i, j, won, lost, tied)
    for iteration in range(max_iterations + 1):
        by_model, by_tie = gradient(theta, log_nu, i, j, won, lost, tied)
        slope = np.append(by_model, by_tie)[:size]
        if not np.isfinite(slope).all():
            return theta, log_nu, value, iteration, False
        if np.abs(slope).max() <= goal:
            return theta - theta.mean(), log_nu, value, iteration, True
        try:
            step = np.linalg.solve(_curvature(theta, log_nu, i, j, n)[:size, :size], slope)
        except np.linalg.LinAlgError:
            return theta, log_nu, value, iteration, False
        for halving in range(60):
            share = 0.5**halving
            new_theta = theta - share * step[:k]
            new_log_nu = log_nu - share * step[k] if ties else log_nu
            new_value = objective(new_theta, new_log_nu, i, j, won, lost, tied)
            if new_value <= value + 1e-12 * abs(value):
                break
        theta, log_nu, value = new_theta - new_theta.mean(), new_log_nu, new_value
    return theta, log_nu, value, max_iterations, False


def dense_ranks(scores: np.ndarray) -> np.ndarray:
    """Ranks from the best score down; a score joins the group whose first member is within the tolerance."""
    ranks = np.zeros(len(scores), dtype=int)
    rank, head = 0, None
    for index in np.argsort(-scores, kind="stable"):
        if head is None or abs(scores[index] - head) > RANK_TOLERANCE:
            rank, head = rank + 1, scores[index]
        ranks[index] = rank
    return ranks


def fit_counts(k: int, a, b, outcome, n, *, estimator: str, max_iterations: int, tolerance: float) -> dict:
    """Guards and fit for one stratum.

    ``a`` and ``b`` are positions among the k models of the population; ``outcome`` is 0 for a win of a, 1 for
    a win of b, 2 for a tie and 3 for a tie of two bad answers; ``n`` counts battles.
    """
    ties = estimator != "bradley_terry_decisive"
    used = outcome <= 1
    if ties:
        used = used | (outcome == 2)
    if estimator == "davidson_coalesced_ties":
        used = used | (outcome == 3)
    out = {"status": "SUCCESS", "models": k, "rows": int(n.sum()), "likelihood_rows": int(n[used].sum())}
    a, b, n = a[used], b[used], n[used].astype(float)
    tie, first = outcome[used] >= 2, outcome[used] == 0
    present = np.zeros(k, dtype=bool)
    present[a] = present[b] = True
    if not len(a):
        return out | {"status": "ZERO_LIKELIHOOD_ROWS"}
    if present.sum() < 2:
        return out | {"status": "INSUFFICIENT_MODELS"}
    if not present.all():
        return out | {"status": "MODEL_DROPPED_BY_OUTCOME_POLICY"}
    both = np.zeros((k, k), dtype=bool)
    both[a, b] = both[b, a] = True
    out |= {"edges": int(np.triu(both).sum()), "components": component_count(both)}
    if out["components"] != 1:
        return out | {"status": "DISCONNECTED_GRAPH"}
    if ties and (not tie.any() or tie.all()):
        return out | {"status": "UNIDENTIFIABLE_TIE_PARAMETER"}
    beats = np.zeros((k, k), dtype=bool)
    forth, back = first | tie, ~first
    beats[a[forth], b[forth]] = True
    beats[b[back], a[back]] = True
    if not (reach(beats, 0).all() and reach(beats.T, 0).all()):
        return out | {"status": "SEPARATION"}
    low, high = np.minimum(a, b), np.maximum(a, b)
    pair, slot = np.unique(low.astype(np.int64) * k + high, return_inverse=True)
    low_won = ~tie & (first == (a == low))
    sums = [np.bincount(slot, n * chosen, len(pair)) for chosen in (low_won, ~tie & ~low_won, tie)]
    theta, log_nu, value, iterations, converged = newton(
        k, pair // k, pair % k, *sums, ties=ties, max_iterations=max_iterations, tolerance=tolerance
    )
    out |= {"iterations": iterations, "objective": value}
    if not converged:
        return out | {"status": "OPTIMIZATION_FAILED"}
    nu = float(np.exp(log_nu)) if ties else None
    if not np.isfinite(theta).all() or (ties and not (np.isfinite(nu) and nu > 0)):
        return out | {"status": "NONFINITE_RESULT"}
    return out | {"tie_parameter": nu, "scores": theta, "ranks": dense_ranks(theta)}
