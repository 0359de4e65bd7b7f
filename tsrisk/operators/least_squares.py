"""Conditional least squares of ARMA models by damped Gauss-Newton steps, many series and orders at a time.

A model is (1 - phi)(1 - PHI) w = (1 + theta)(1 + THETA) e, its seasonal products constrained. The sum of squared shocks, taken
as 0 before the first one that all orders can reach, is made least; every round computes shocks and their
derivatives by one recursion over the days for all rows that have not converged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS = 40
#: A row has converged when a step moves its sum of squares, and was expected to, by less than this share.
SHARE = 1e-8
#: Numbers that the derivatives of one chunk of rows may hold.
CELLS = 1 << 23


@dataclass(frozen=True)
class Shape:
    """Numbers of plain and seasonal coefficients, autoregressive then moving average."""

    p: int
    seasonal_p: int
    q: int
    seasonal_q: int
    period: int

    @property
    def size(self) -> int:
        return self.p + self.seasonal_p + self.q + self.seasonal_q

    @property
    def reach(self) -> tuple[int, int]:
        return self.p + self.seasonal_p * self.period, self.q + self.seasonal_q * self.period

    def polynomials(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both polynomials by power of the lag, and their derivatives by coefficient."""
        at = np.cumsum([0, self.p, self.seasonal_p, self.q, self.seasonal_q])
        ar, ar_slopes = self._product(beta[at[0] : at[1]], beta[at[1] : at[2]], -1.0)
        ma, ma_slopes = self._product(beta[at[2] : at[3]], beta[at[3] : at[4]], 1.0)
        none_ar, none_ma = np.zeros((len(ma_slopes), len(ar))), np.zeros((len(ar_slopes), len(ma)))
        return ar, ma, np.vstack([ar_slopes, none_ar]), np.vstack([none_ma, ma_slopes])

    def _product(self, short: np.ndarray, long: np.ndarray, sign: float) -> tuple[np.ndarray, np.ndarray]:
        first = np.append(1.0, sign * short)
        second = np.zeros(len(long) * self.period + 1)
        second[0] = 1.0
        second[self.period :: self.period] = sign * long
        whole = np.convolve(first, second)
        slopes = np.zeros((len(short) + len(long), len(whole)))
        for i in range(len(short)):
            slopes[i, i + 1 : i + 1 + len(second)] = sign * second
        for j in range(len(long)):
            lag = (j + 1) * self.period
            slopes[len(short) + j, lag : lag + len(first)] = sign * first
        return whole, slopes


def shocks(w: np.ndarray, first: np.ndarray, ar, ma, ar_slopes, ma_slopes) -> tuple[np.ndarray, np.ndarray]:
    """Shocks (rows, days) and their derivatives (rows, coefficients, days); 0 before `first`."""
    rows, days = w.shape
    size, back = ar_slopes.shape[1], ma.shape[1] - 1
    known = np.zeros((rows, days))
    slopes = np.zeros((rows, size, days))
    for lag in range(ar.shape[1]):
        moved = w[:, : days - lag]
        known[:, lag:] += ar[:, lag, None] * moved
        slopes[:, :, lag:] += ar_slopes[:, :, lag, None] * moved[:, None, :]
    e = np.zeros((rows, back + days))
    d = np.zeros((rows, size, back + days))
    weights, weight_slopes = ma[:, :0:-1], ma_slopes[:, :, :0:-1]
    live = np.arange(days)[None, :] >= first[:, None]
    known *= live
    slopes *= live[:, None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        for t in range(int(first.min(initial=days)), days):
            past = e[:, t : t + back]
            now = known[:, t] - np.einsum("rl,rl->r", weights, past)
            slope = slopes[:, :, t] - np.matmul(weight_slopes, past[:, :, None])[:, :, 0]
            slope -= np.matmul(d[:, :, t : t + back], weights[:, :, None])[:, :, 0]
            on = live[:, t]
            e[:, back + t] = np.where(on, now, 0.0)
            d[:, :, back + t] = np.where(on[:, None], slope, 0.0)
    return e[:, back:], d[:, :, back:]


def _evaluate(w, first, shapes, betas, reach, size):
    """Shocks, sums of squares, gradients and cross products of the derivatives at the given coefficients."""
    rows = len(betas)
    ar, ma = np.zeros((rows, reach[0] + 1)), np.zeros((rows, reach[1] + 1))
    ar_slopes, ma_slopes = np.zeros((rows, size, reach[0] + 1)), np.zeros((rows, size, reach[1] + 1))
    for r, (shape, beta) in enumerate(zip(shapes, betas)):
        a, m, sa, sm = shape.polynomials(beta[: shape.size])
        ar[r, : len(a)], ma[r, : len(m)] = a, m
        ar_slopes[r, : len(sa), : len(a)], ma_slopes[r, : len(sm), : len(m)] = sa, sm
    e, d = shocks(w, first, ar, ma, ar_slopes, ma_slopes)
    with np.errstate(over="ignore", invalid="ignore"):
        return e, np.einsum("rt,rt->r", e, e), np.einsum("rkt,rt->rk", d, e), np.einsum("rkt,rlt->rkl", d, d)


@dataclass
class Fit:
    """Least-squares coefficients of one row with its shocks."""

    beta: np.ndarray
    shocks: np.ndarray
    squares: float
    n: int
    rounds: int
    converged: bool


def fit_rows(series: list[np.ndarray], shapes: list[Shape], starts: list[np.ndarray]) -> list[Fit | None]:
    """One fit for each row of series, shape and start; None for a series too short or flat.

    A start whose shocks grow without bound is replaced by zeros. Rows that have not converged after ROUNDS rounds
    keep the best coefficients seen. All rows leave out as many first days as the longest shape needs, so that their
    sums compare.
    """
    if not series:
        return []
    size = max(s.size for s in shapes)
    reach = max(s.reach[0] for s in shapes), max(1, *(s.reach[1] for s in shapes))
    out: list[Fit | None] = [None] * len(series)
    usable = [r for r, w in enumerate(series) if len(w) - reach[0] > 2 * size and np.isfinite(w).all() and np.ptp(w) > 0]
    step = max(1, CELLS // (size * max(map(len, series))))
    for a in range(0, len(usable), step):
        own = usable[a : a + step]
        for r, fit in zip(own, _fit_chunk([series[r] for r in own], [shapes[r] for r in own], [starts[r] for r in own], reach, size)):
            out[r] = fit
    return out


def _fit_chunk(series, shapes, starts, reach, size) -> list[Fit]:
    rows, days = len(series), max(map(len, series))
    w = np.zeros((rows, days))
    for r, own in enumerate(series):
        w[r, days - len(own) :] = own
    first = np.array([days - len(own) + reach[0] for own in series])
    count = days - first
    beta = np.zeros((rows, size))
    for r, start in enumerate(starts):
        beta[r, : len(start)] = start
    e, squares, gradient, cross = _evaluate(w, first, shapes, beta, reach, size)
    plain = np.einsum("rt,rt->r", *[np.where(np.arange(days) >= first[:, None], w, 0.0)] * 2)
    bad = ~(squares < plain)  # not finite, or worse than no model
    if bad.any():
        at = bad.nonzero()[0]
        beta[at] = 0.0
        e[at], squares[at], gradient[at], cross[at] = _evaluate(w[at], first[at], [shapes[r] for r in at], beta[at], reach, size)
    damping, done, rounds = np.full(rows, 1e-3), np.zeros(rows, bool), np.zeros(rows, int)
    unused = np.array([[k >= s.size for k in range(size)] for s in shapes])
    for _ in range(ROUNDS):
        at = (~done).nonzero()[0]
        if not len(at):
            break
        rounds[at] += 1
        scale = np.einsum("rkk->rk", cross[at])
        system = cross[at].copy()
        index = np.arange(size)
        system[:, index, index] += damping[at, None] * scale + np.where(unused[at] | (scale == 0), 1.0, 0.0)
        move = -np.linalg.solve(system, gradient[at][:, :, None])[:, :, 0]
        expected = -np.einsum("rk,rk->r", move, gradient[at])
        tried = beta[at] + move
        found = _evaluate(w[at], first[at], [shapes[r] for r in at], tried, reach, size)
        better = found[1] < squares[at]
        gain = np.where(better, squares[at] - found[1], 0.0)
        good = at[better]
        beta[good], e[good], squares[good], gradient[good], cross[good] = tried[better], *(x[better] for x in found)
        damping[at] = np.where(better, np.maximum(damping[at] / 10, 1e-12), np.minimum(damping[at] * 10, 1e12))
        still = (expected <= SHARE * squares[at]) & (gain <= SHARE * squares[at])
        done[at] = still
    return [Fit(beta[r, : shapes[r].size], e[r], float(squares[r]), int(count[r]), int(rounds[r]), bool(done[r])) for r in range(rows)]
