"""Strictly convex quadratic programs by a dual active set, and the portfolio problems made of them."""

from __future__ import annotations

import numpy as np


class Infeasible(ValueError):
    """No point satisfies the constraints."""


def solve_qp(g, c, eq=None, eq_to=None, over=None, over_to=None, rounds: int = 500, tol: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """(x, multipliers) that minimise x'gx/2 - c'x with eq x = eq_to and over x >= over_to.

    Starts at the unconstrained minimum and takes in the most violated constraint, one at
    a time, keeping the multipliers of inequalities non-negative (Goldfarb and Idnani).
    Multipliers come in the order eq, over.
    """
    g, c = np.asarray(g, float), np.asarray(c, float)
    n = len(c)
    eq = np.zeros((0, n)) if eq is None else np.atleast_2d(np.asarray(eq, float))
    over = np.zeros((0, n)) if over is None else np.atleast_2d(np.asarray(over, float))
    rows = np.vstack([eq, over])
    to = np.concatenate([np.zeros(0) if eq_to is None else np.atleast_1d(eq_to), np.zeros(0) if over_to is None else np.atleast_1d(over_to)]).astype(float)
    size = np.maximum(1e-300, np.linalg.norm(rows, axis=1))
    m_eq, inverse = len(eq), np.linalg.inv(g)
    x, active, u = inverse @ c, [], np.zeros(0)

    def directions(q):
        nn = rows[active].T
        if not active:
            return inverse @ q, np.zeros(0)
        hn = inverse @ nn
        r = np.linalg.lstsq(nn.T @ hn, hn.T @ q, rcond=None)[0]
        return inverse @ q - hn @ r, r

    for _ in range(rounds):
        gap = (rows @ x - to) / size
        todo = [i for i in range(m_eq) if i not in active and abs(gap[i]) > tol]
        if todo:
            j = todo[0]
        else:
            free = [i for i in range(m_eq, len(rows)) if i not in active]
            j = min(free, key=lambda i: gap[i], default=None)
            if j is None or gap[j] >= -tol:
                out = np.zeros(len(rows))
                out[active] = u
                return x, out
        sign = -1.0 if j < m_eq and gap[j] > 0 else 1.0
        q, uq = sign * rows[j], 0.0
        while True:
            z, r = directions(q)
            curve = float(z @ q)
            full = (sign * to[j] - q @ x) / curve if curve > 1e-14 * size[j] ** 2 * np.abs(inverse).max() else np.inf
            ratios = [(u[k] / r[k], k) for k, i in enumerate(active) if i >= m_eq and r[k] > 1e-14]
            part, drop = min(ratios, default=(np.inf, -1))
            t = min(full, part)
            if not np.isfinite(t):
                if j < m_eq and abs(gap[j]) <= 1e-9:  # depends on equalities that hold
                    break
                raise Infeasible("no portfolio satisfies the constraints")
            u, uq = u - t * r, uq + t
            if np.isfinite(full):
                x = x + t * z
            if t == full:
                active, u = [*active, j], np.append(u, sign * uq)
                break
            active, u = active[:drop] + active[drop + 1 :], np.delete(u, drop)
        if j < m_eq and j not in active:
            rows[j], to[j] = 0.0, 0.0
    raise ArithmeticError("the active set did not settle")


def clean(w: np.ndarray, cut: float = 1e-4, places: int = 5) -> np.ndarray:
    """Weights under the cut are 0, the rest is rounded; the sum is left as it is."""
    return np.round(np.where(np.abs(w) < cut, 0.0, w), places) + 0.0


def _box(n: int, bounds) -> tuple[np.ndarray, np.ndarray]:
    return np.vstack([np.eye(n), -np.eye(n)]), np.concatenate([np.full(n, bounds[0]), np.full(n, -bounds[1])])


def min_vol(cov, bounds=(0.0, 1.0)) -> np.ndarray:
    """Cleaned weights of least variance with sum 1 within bounds."""
    n = len(cov)
    over, to = _box(n, bounds)
    return clean(solve_qp(cov, np.zeros(n), np.ones((1, n)), 1.0, over, to)[0])


def target_return(mu, cov, target: float, bounds=(0.0, 1.0)) -> np.ndarray:
    """Weights of least variance with sum 1 and the target return within bounds; Infeasible if there are none."""
    n = len(cov)
    over, to = _box(n, bounds)
    w = solve_qp(cov, np.zeros(n), np.vstack([np.ones(n), mu]), [1.0, target], over, to)[0]
    if abs(w.sum() - 1) > 1e-7 or abs(w @ mu - target) > 1e-7 or w.min() < bounds[0] - 1e-7 or w.max() > bounds[1] + 1e-7:
        raise Infeasible("the target return is out of reach")
    return w


def max_sharpe(mu, cov, rf: float, bounds=(0.0, 1.0), fixed: dict[int, float] | None = None, minimum: dict[int, float] | None = None) -> np.ndarray:
    """Cleaned weights of greatest (w'mu - rf) / sqrt(w'cov w) with sum 1, bounds, and fixed and least weights by position.

    With y = k w and (mu - rf)'y = 1 the problem is: least y'cov y, every constraint on
    w times k = sum(y).
    """
    mu, n = np.asarray(mu, float), len(cov)
    if not mu.max() > rf:
        raise ValueError("no asset's expected return is over the risk-free rate")
    ones, unit = np.ones(n), np.eye(n)
    over = [unit[i] - bounds[0] * ones for i in range(n)] + [bounds[1] * ones - unit[i] for i in range(n)]
    over += [unit[i] - v * ones for i, v in (minimum or {}).items()] + [ones]
    eq = [mu - rf] + [unit[i] - v * ones for i, v in (fixed or {}).items()]
    y, _ = solve_qp(cov, np.zeros(n), np.array(eq), [1.0] + [0.0] * (len(eq) - 1), np.array(over), np.zeros(len(over)))
    if y.sum() <= 0:
        raise Infeasible("no portfolio satisfies the constraints")
    return clean(y / y.sum())


def posterior(cov, market, risk_aversion: float, tau: float, views: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """(mu, pi): equilibrium returns, and those after absolute views with the variance of each view's own portfolio."""
    cov = np.asarray(cov, float)
    pi = risk_aversion * cov @ np.asarray(market, float)
    if not views:
        return pi, pi
    at, q = list(views), np.array(list(views.values()), float)
    p = np.eye(len(pi))[at]
    spread = tau * p @ cov @ p.T
    return pi + tau * cov @ p.T @ np.linalg.solve(spread + np.diag(np.diag(spread)), q - pi[at]), pi
