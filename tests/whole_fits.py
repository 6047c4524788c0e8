"""A pinball fit on whole arrays by ADMM, which the fits in passes are compared with."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class PinballFit:
    weights: np.ndarray
    intercept: float
    primal: float
    dual: float
    iterations: int
    converged: bool


def pinball_fit(z: np.ndarray, y: np.ndarray, cost: np.ndarray, tau: float, penalty: np.ndarray | float = 1.0, linear: np.ndarray | None = None, most: int = 5000, relative: float = 1e-4, absolute: float = 1e-7) -> PinballFit:
    """min w'Rw / 2 + c'w + sum cost * pinball(y - Zw - b), by ADMM with a duality-gap certificate.

    The residual is split off and the intercept is free. The best primal and the
    best dual value seen make the gap; the fit has converged once that is below
    absolute + relative * max(1, |primal|, |dual|).
    """
    n, d = z.shape
    quadratic = np.eye(d) * penalty if np.isscalar(penalty) else np.asarray(penalty, dtype=float)
    c = np.zeros(d) if linear is None else linear
    r_factor = np.linalg.cholesky(quadratic)
    rho = float(np.median(cost)) / max(1e-6, float(np.median(np.abs(y - np.median(y)))))
    extended = np.hstack([z, np.ones((n, 1))])
    base = np.zeros((d + 1, d + 1))
    base[:d, :d] = quadratic
    gram = extended.T @ extended
    factor = np.linalg.inv(base + rho * gram + 1e-12 * np.eye(d + 1))
    r, u = y - np.quantile(y, tau), np.zeros(n)
    best = (np.inf, np.zeros(d), 0.0)
    dual = -np.inf
    done = 0
    for done in range(1, most + 1):
        target = extended.T @ (rho * (y - r) - u)
        target[:d] -= c
        solved = factor @ target
        fitted = extended @ solved
        v = y - fitted - u / rho
        r = np.where(v > tau * cost / rho, v - tau * cost / rho, np.where(v < -(1 - tau) * cost / rho, v + (1 - tau) * cost / rho, 0.0))
        u = u + rho * (r + fitted - y)
        if done % 25 and done != most:
            continue
        w = solved[:d]
        residual = y - z @ w
        order = np.argsort(residual)
        up = np.cumsum(cost[order])
        b = residual[order][min(n - 1, int(np.searchsorted(up, tau * up[-1])))]
        e = residual - b
        primal = 0.5 * w @ quadratic @ w + c @ w + float(np.sum(cost * np.maximum(tau * e, (tau - 1) * e)))
        if primal < best[0]:
            best = (primal, w.copy(), float(b))
        a = np.clip(-u, -(1 - tau) * cost, tau * cost)
        over = a.sum()  # the free intercept wants multipliers that sum to zero
        room = (a + (1 - tau) * cost) if over > 0 else (tau * cost - a)
        a = a - np.sign(over) * room * (abs(over) / max(room.sum(), 1e-300))
        g = np.linalg.solve(r_factor, z.T @ a - c)
        dual = max(dual, float(a @ y - 0.5 * g @ g))
        if best[0] - dual <= absolute + relative * max(1.0, abs(best[0]), abs(dual)):
            return PinballFit(best[1], best[2], best[0], dual, done, True)
    return PinballFit(best[1], best[2], best[0], dual, done, False)
