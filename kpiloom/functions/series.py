"""Statistics of one KPI series that have no built-in expression. Each works on one bounded, period-ordered array."""

from __future__ import annotations

import math

import numpy as np

# Fixed values
BOOTSTRAP_RESAMPLES = 1000
BOOTSTRAP_SEED = 42
CI_LEVEL = 0.95
PELT_PENALTY = 3.0
PELT_JUMP = 5
PELT_MIN_SIZE = 2


def bootstrap_interval(values: np.ndarray, chunk: int = 4_000_000) -> tuple[float | None, float | None]:
    """Percentile interval of the mean from seeded resamples; none below three points.

    Resamples are drawn in row blocks, so memory stays bounded for long series and the draws stay the same.
    """
    n = len(values)
    if n < 3:
        return None, None
    rng = np.random.default_rng(BOOTSTRAP_SEED)
    rows = max(1, min(BOOTSTRAP_RESAMPLES, chunk // n))
    means = []
    left = BOOTSTRAP_RESAMPLES
    while left:
        take = min(rows, left)
        means.append(values[rng.integers(0, n, size=(take, n))].mean(axis=1))
        left -= take
    tail = (1.0 - CI_LEVEL) / 2.0
    low, high = np.quantile(np.concatenate(means), [tail, 1.0 - tail])
    return float(low), float(high)


def _kth_gap(ordered: np.ndarray, k: int) -> float:
    """k-th smallest (from 0) of all pairwise gaps of a sorted array, in linear memory.

    Non-negative doubles sort like their bit patterns, so a bisection over bit patterns ends at the exact value.
    """
    n = len(ordered)
    start = np.arange(n)

    def pairs_within(limit: float) -> int:
        low, high = start.copy(), np.full(n, n - 1)
        while True:
            open_ = low < high
            if not open_.any():
                break
            middle = (low + high + 1) // 2
            fits = ordered[middle] - ordered <= limit
            low = np.where(open_ & fits, middle, low)
            high = np.where(open_ & ~fits, middle - 1, high)
        return int((low - start).sum())

    low_bits = 0
    high_bits = int(np.float64(ordered[-1] - ordered[0]).view(np.int64))
    while low_bits < high_bits:
        middle_bits = (low_bits + high_bits) // 2
        if pairs_within(float(np.int64(middle_bits).view(np.float64))) > k:
            high_bits = middle_bits
        else:
            low_bits = middle_bits + 1
    return float(np.int64(low_bits).view(np.float64))


def median_squared_gap(values: np.ndarray) -> float:
    """Median of squared pairwise distances."""
    ordered = np.sort(values)
    count = len(values) * (len(values) - 1) // 2
    if count == 0:
        return 0.0
    upper = _kth_gap(ordered, count // 2)
    if count % 2:
        return upper * upper
    lower = _kth_gap(ordered, count // 2 - 1)
    return (lower * lower + upper * upper) / 2.0


class KernelCost:
    """Segment costs under a Gaussian kernel, for segments that start and end on a coarse grid (or at the end).

    Cost(s, e) = (e - s) - sum of kernel values inside the segment / (e - s). Only sums of grid cells are kept: with a
    step of five that is 1/25 of the full kernel matrix, which itself is never held.
    """

    def __init__(self, values: np.ndarray, step: int = PELT_JUMP) -> None:
        n = len(values)
        median = median_squared_gap(values)
        gamma = 1.0 / median if median != 0 else 1.0
        self.edges = np.append(np.arange(0, n, step), n)
        starts = self.edges[:-1]
        cells = len(starts)
        sums = np.zeros((cells + 1, cells + 1))
        block = max(1, 2_000_000 // (n * step))
        for first in range(0, cells, block):
            last = min(first + block, cells)
            rows = np.arange(starts[first], self.edges[last])
            gaps = (values[rows, None] - values[None, :]) ** 2 * gamma
            kernel = np.exp(-np.clip(gaps, 1e-2, 1e2))
            kernel[np.arange(len(rows)), rows] = 1.0
            by_column = np.add.reduceat(kernel, starts, axis=1)
            sums[first + 1 : last + 1, 1:] = np.add.reduceat(by_column, starts[first:last] - starts[first], axis=0)
        self.prefix = sums.cumsum(axis=0).cumsum(axis=1)

    def __call__(self, starts: np.ndarray, end: int) -> np.ndarray:
        """Costs of the segments from each grid index in ``starts`` to grid index ``end``."""
        p = self.prefix
        inner = p[end, end] - p[starts, end] - p[end, starts] + p[starts, starts]
        length = self.edges[end] - self.edges[starts]
        return length - inner / length


def change_points(values: np.ndarray, min_points: int = 8) -> list[int]:
    """Interior segment ends of the penalized optimal segmentation (pruned exact search, Killick et al. 2012)."""
    n = len(values)
    if n < min_points:
        return []
    penalty = PELT_PENALTY * math.log(n)
    cost = KernelCost(values)
    edges = cost.edges
    last = len(edges) - 1
    best = np.full(len(edges), np.inf)
    best[0] = 0.0
    previous = np.zeros(len(edges), dtype=int)
    open_starts: list[int] = []
    for end in range(1, last + 1):
        newest = (edges[end] - PELT_MIN_SIZE) // PELT_JUMP
        if newest >= 0 and newest not in open_starts:
            open_starts.append(newest)
        starts = np.array(open_starts)
        totals = best[starts] + cost(starts, end) + penalty
        choice = int(np.argmin(totals))
        best[end] = totals[choice]
        previous[end] = starts[choice]
        open_starts = [s for s, t in zip(open_starts, totals) if t <= best[end] + penalty]
    points = []
    at = last
    while at > 0:
        at = previous[at]
        if at > 0:
            points.append(int(edges[at]))
    return sorted(points)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return result


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def welch_p_value(n1: float, mean1: float, var1: float, n2: float, mean2: float, var2: float) -> float | None:
    """Two-sided p-value of the unequal-variance t-test; none below two values or without any variance."""
    if n1 < 2 or n2 < 2:
        return None
    e1, e2 = var1 / n1, var2 / n2
    if not e1 + e2 > 0:
        return None
    t = (mean1 - mean2) / math.sqrt(e1 + e2)
    freedom = (e1 + e2) ** 2 / (e1**2 / (n1 - 1) + e2**2 / (n2 - 1))
    return regularized_beta(freedom / 2.0, 0.5, freedom / (freedom + t * t))
