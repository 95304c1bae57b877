"""Numbers of tables of Chinese-restaurant dishes, drawn at once for all customers of a dish.

S(n, t), the generalised Stirling numbers of a discount d, are the weights of all seatings of n customers at t tables, together:
S(n + 1, t) = S(n, t - 1) + (n - d t) S(n, t). With them a dish's number of tables is drawn from its conditional distribution given
everything else, as if all its customers had left and were seated again, whichever way. Up to ROWS customers they come from the
recurrence; beyond, from Cauchy's integral of the generating function, (1 - (1 - x)^d)^t / (t! d^t), along a parabola through its
saddle point (or, near the branch point, Weideman and Trefethen's), where the midpoint rule converges geometrically.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from epochal.llm._packed import ragged

ROWS = 1024
#: Largest distance of the integral's nodes, and their reach, in standard deviations; nodes of Chebyshev interpolation.
STEP, REACH, CHEBYSHEV = 0.2, 9.6, 32
#: Weights below e^-CUT of the largest are left out: they are beyond the precision of the others (1e-10 for n of thousands).
CUT = 30.0


def _rest(x: np.ndarray) -> np.ndarray:
    """What Stirling's formula lacks of log_gamma."""
    z = 1 / x
    y = z * z
    return z * (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x > 0."""
    x = np.asarray(x, float)
    few = x < 16
    if not few.any():
        return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + _rest(x)
    out = log_gamma(np.where(few, x + 16, x))
    y = x[few]
    out[few] -= np.log(np.prod([y + i for i in range(16)], axis=0))
    return out


def by_integral(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(n, t) of many customers, 1 <= t < n; t need not be whole."""
    n, t = np.broadcast_arrays(np.asarray(n, float), np.asarray(t, float))
    low, high = np.full(n.shape, -90.0), np.full(n.shape, 5.0)  # of log(-s), x = e^s

    def log_rest(s):  # of 1 - x
        far = s.real < -1
        out = np.log(-np.expm1(s))
        out[far] = np.log1p(-np.exp(s[far]))
        return out

    def slope(s):
        y = log_rest(s)
        return d * np.exp(s + (d - 1) * y) / -np.expm1(d * y), np.exp(y)

    for _ in range(30):
        at = (low + high) / 2
        right = t * slope(-np.exp(at))[0] > n
        low, high = np.where(right, at, low), np.where(right, high, at)
    s0 = -np.exp((low + high) / 2)
    most = min(6 * d / (1 - d), 15.0)  # saddle points this near the branch point, times n; others are some deviations away
    d_step = min(STEP, STEP * math.sqrt(most * (1 - d)))
    nodes = math.ceil(REACH / d_step)
    r, y = slope(s0)
    q = 1 + (1 - d) * np.exp(s0) / y - r
    second, third = t * r * q, q * q + (1 - d) * np.exp(s0) / y**2 - r * q
    step, bend = d_step / np.sqrt(second), third / (6 * q)
    circle = step * nodes > math.pi
    step, bend = np.where(circle, math.pi / nodes, step), np.where(circle, 0.0, bend)
    near = -s0 * n < most
    s0, step, bend = np.where(near, -0.1309 * 48 / n, s0), np.where(near, math.pi / 2 / n, step), np.where(near, 0.1194 / 0.0625 / 48 * n, bend)
    top = np.where(near, 0.0, t * np.log(-np.expm1(d * log_rest(s0)))) - n * s0
    total = np.zeros(n.shape)
    for k in range(nodes):
        v = (k + 0.5) * step
        s = s0 + bend * v * v + 1j * v
        power = t * np.log(-np.expm1(d * log_rest(s)))
        value = np.exp(np.where(near, 0, power) - n * s - top)
        value[near] *= np.expm1(power[near])
        total += (value * (2 * bend * v + 1j)).imag
    return log_gamma(n + 1) - log_gamma(t + 1) - t * math.log(d) + top + np.log(total * step / math.pi)


def _nodes(a: float | np.ndarray, b: float | np.ndarray) -> np.ndarray:
    """Chebyshev points of [a, b] along a last axis."""
    x = np.cos((np.arange(CHEBYSHEV) + 0.5) * math.pi / CHEBYSHEV)
    return np.multiply.outer((np.asarray(b) - a) / 2, x) + np.asarray((np.asarray(b) + a) / 2)[..., None]


#: From values at the points to coefficients.
_COEFFICIENTS = 2 / CHEBYSHEV * np.cos(np.outer(np.arange(CHEBYSHEV), np.arange(CHEBYSHEV) + 0.5) * math.pi / CHEBYSHEV)
_COEFFICIENTS[0] /= 2


def _clenshaw(c: np.ndarray, row: np.ndarray, x: np.ndarray, most: int = CHEBYSHEV - 1) -> np.ndarray:
    """Series of row c[row] at x of [-1, 1], up to a degree."""
    a, b = np.zeros(len(x)), np.zeros(len(x))
    for k in range(most, 0, -1):
        a, b = 2 * x * a - b + c[row, k], a
    return x * a - b + c[row, 0]


class Stirling:
    """log S(n, t) of a discount."""

    def __init__(self, d: float, most: int):
        """most: largest n asked for."""
        self.d, self.rows = d, max(2, min(ROWS, most))
        self.width = self.rows + 1
        table = np.full((self.width, self.width), -np.inf)
        table[1, 1] = 0
        t = d * np.arange(self.width)
        for n in range(1, self.rows):
            some = slice(1, n + 2)
            table[n + 1, some] = np.logaddexp(table[n, : n + 1], np.log(np.maximum(n - t[some], 1e-300)) + table[n, some])
        self.flat = table.ravel()
        with np.errstate(invalid="ignore"):
            grown = np.exp(table[1:] - table[:-1])
        self.grown = np.where(np.isfinite(grown), grown, 1.0).ravel()
        self.ends = math.log(self.rows), math.log(max(most, self.rows + 1))
        # for each t, of log n: log S(n, t) - log_gamma(n - d) and its derivative, and the degrees that these need
        self.series, self.slope = np.zeros((2, 1, CHEBYSHEV))
        self.degrees = np.zeros((2, 1), np.int64)

    def along_t(self, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Values for each n > ROWS at t = low..high (n at most), in a row."""
        size = high - low + 1
        row, at = np.repeat(np.arange(len(n)), size), ragged(low, size).astype(float)
        out = np.empty(len(at))
        even = high < 0.9 * n  # a series; not smooth enough near t = n
        if even.any():
            a, b, place = np.log(low[even]), np.log(np.maximum(high, low + 1)[even]), np.cumsum(even) - 1
            t = np.exp(_nodes(a, b))
            values = by_integral(n[even][:, None], t, self.d) + log_gamma(t + 1)
            some = even[row]
            r, x = place[row[some]], at[some]
            out[some] = _clenshaw(values @ _COEFFICIENTS.T, r, (2 * np.log(x) - (a + b)[r]) / (b - a)[r]) - log_gamma(x + 1)
        if not even.all():
            some = ~even[row]
            out[some] = self._direct(n[row[some]], at[some])
        return out

    def _direct(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.where(t < n, by_integral(n, np.minimum(t, n - 1e-3), self.d), np.where(t == n, 0.0, -np.inf))

    def __call__(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Of any 1 <= t; log 0 where t > n. Beyond ROWS it serves few tables best: there is a series for each t."""
        out = self.flat[np.minimum(n, self.rows) * self.width + np.minimum(t, self.rows)]
        big = np.flatnonzero(n > self.rows)
        if len(big):
            n, t = n[big], t[big]
            small = t < self.rows  # beyond, the integral itself
            self._extend(int(t[small].max(initial=0)))
            a, b = self.ends
            value = np.empty(len(big))
            x = np.log(n[small])
            value[small] = _clenshaw(self.series, t[small], (2 * x - a - b) / (b - a), int(self.degrees[0, t[small]].max(initial=0))) + log_gamma(n[small] - self.d)
            if len(more := np.flatnonzero(~small)):
                value[more] = self._direct(n[more], t[more])
            out[big] = value
        return out

    def growth(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """S(n + 1, t) / S(n, t) of any n >= t (else anything)."""
        out = self.grown[np.minimum(n, self.rows - 1) * self.width + np.minimum(t, self.rows)]
        big = np.flatnonzero(n >= self.rows)
        if len(big):
            n, t = n[big], t[big]
            small = t < self.rows
            if small.all():
                self._extend(int(t.max()))
                a, b = self.ends
                m = n + 0.5
                out[big] = (n - self.d) * np.exp(_clenshaw(self.slope, t, (2 * np.log(m) - a - b) / (b - a), int(self.degrees[1, t].max())) / m)
            else:
                out[big] = np.exp(self(n + 1, t) - self(n, np.minimum(t, n)))
        return out

    def _extend(self, t: int) -> None:
        if t < len(self.series):
            return
        every = np.arange(len(self.series), min(max(t, 2 * len(self.series), 32), self.rows - 1) + 1)
        n = np.exp(_nodes(*self.ends))
        values = by_integral(n[None, :], every[:, None], self.d) - log_gamma(n - self.d)
        series = values @ _COEFFICIENTS.T
        slope = np.polynomial.chebyshev.chebder(series, axis=1) * 2 / (self.ends[1] - self.ends[0])
        slope = np.concatenate([slope, np.zeros((len(slope), 1))], axis=1)
        degrees = [np.where(np.abs(x) > least, np.arange(CHEBYSHEV), 0).max(axis=1) for x, least in ((series, 1e-10), (slope, 1e-8))]
        self.series, self.slope = np.concatenate([self.series, series]), np.concatenate([self.slope, slope])
        self.degrees = np.concatenate([self.degrees, degrees], axis=1)


def climb(more: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log weights from the ratios of each to the one before, but for the first of each row of ``size``, up to a constant of the row."""
    more[np.cumsum(size) - size] = 1.0
    return np.cumsum(np.log(more))


def draw(low: np.ndarray, size: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value low..low + size - 1 of each by its log weights, in a row; whether the first and the last weight are as good as 0."""
    first = np.cumsum(size) - size
    top = np.maximum.reduceat(weight, first)
    w = np.exp(weight - np.repeat(top, size))
    ends = np.cumsum(w)
    last = first + size - 1
    begin = ends[first] - w[first]
    at = np.searchsorted(ends, begin + rng.random(len(size)) * (ends[last] - begin), "right")
    return low + np.clip(at - first, 0, size - 1), weight[first] < top - CUT, weight[last] < top - CUT


def draw_within(least: np.ndarray, c: np.ndarray, t: np.ndarray, weight: Callable, rng: np.random.Generator) -> np.ndarray:
    """A number of tables least..c of each; weight(which, low, size): log weights of low..low + size - 1 of those, in a row.

    Weights are taken around t as far as they count in double precision, beyond which they fall on both sides.
    """
    out, which, half = t.copy(), np.arange(len(c)), np.where(c <= 8, 8, 8 + 5 * np.sqrt(t)).astype(np.int64)
    while len(which):
        low, high = np.maximum(t[which] - half, least[which]), np.minimum(t[which] + half, c[which])
        size = high - low + 1
        got, left, right = draw(low, size, weight(which, low, size), rng)
        out[which] = got
        again = ((low > least[which]) & ~left) | ((high < c[which]) & ~right)
        which, half = which[again], 2 * half[again]
    return out
