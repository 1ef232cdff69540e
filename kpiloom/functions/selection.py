"""Exact order statistics and counts of many columns at once by radix selection.

One scan counts every column's values by magnitude: sign and logarithm in steps of about one and a half per cent. The counts say
which few buckets hold the wanted ranks or bounds; a second scan brings the distinct values of those buckets alone. If they are
too many, they are written once and their ranges cut finer, by equal widths, until few are left. A bucket knows its least and
largest value, and buckets whose values overlap count as one, so no result depends on how a logarithm is rounded.

The driver sees at most some hundred thousand counters of each column, whatever the table's size, and ``direct_limit`` values.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.session import scratch_folder

#: Buckets of each unit of the natural logarithm, the offset that keeps a bucket's sign, and the parts of a finer cut.
STEPS, OFFSET, CELLS = 64, 60_000, 4096
DIRECT_LIMIT = 500_000


@dataclass
class Buckets:
    """Counts of one column's values in disjoint ranges, in order. A range from a value to itself is that value."""

    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(rows: Iterable[tuple[int, float, float]]) -> Buckets:
        """Ranges in order; those that overlap become one."""
        merged: list[list] = []
        for n, low, high in sorted(rows, key=lambda r: (r[1], r[2])):
            if merged and low <= merged[-1][2]:
                merged[-1][0] += n
                merged[-1][2] = max(merged[-1][2], high)
            else:
                merged.append([n, low, high])
        n, low, high = zip(*merged, strict=True) if merged else ((), (), ())
        return Buckets(np.array(n, np.int64), np.array(low, float), np.array(high, float))

    @property
    def total(self) -> int:
        return int(self.n.sum())

    @property
    def open(self) -> np.ndarray:
        return self.low < self.high

    def of_rank(self, rank: int) -> int:
        """The range that holds the value of a rank from 0."""
        return int(np.searchsorted(np.cumsum(self.n), rank, side="right"))

    def span(self, position: float) -> tuple[float, float]:
        """Least and largest value that the quantile at a fractional rank can have."""
        first = int(position)
        last, share = min(first + 1, self.total - 1), position - first
        a, b = self.of_rank(first), self.of_rank(last)
        low, high = (float(x[a] if a == b else x[a] + (x[b] - x[a]) * share) for x in (self.low, self.high))
        return low, high

    def holding(self, position: float) -> np.ndarray:
        """Which ranges hold the values next to a fractional rank."""
        first = int(position)
        held = np.zeros(len(self.n), bool)
        held[[self.of_rank(first), self.of_rank(min(first + 1, self.total - 1))]] = True
        return held

    def outside(self, low: float, high: float) -> int:
        """Values below ``low`` or above ``high``; no open range may hold either bound."""
        return int(self.n[(self.high < low) | (self.low > high)].sum())


class Selection:
    """The values of a frame's double columns, known as finely as asked for.

    ``counted`` are conditions whose rows are counted in the same scan.
    """

    def __init__(self, frame: DataFrame, columns: dict[str, Column], counted: dict[str, Column] | None = None, direct_limit: int = DIRECT_LIMIT):
        self.frame, self.columns, self.names, self.direct_limit = frame, columns, list(columns), direct_limit
        self.survivors: DataFrame | None = None
        conditions = list((counted or {}).items())
        entries = [self._entry(i, v, v.isNotNull()) for i, v in enumerate(columns.values())]
        entries += [self._entry(-1 - i, F.lit(0.0), c) for i, (_, c) in enumerate(conditions)]
        # Buckets are computed behind the generator, once for all columns: long generated methods are never compiled.
        found = self._counted(_entries(frame, entries).withColumn("b", _by_magnitude(F.col("v"))), F.count(F.lit(1))) if entries else []
        self.buckets = {c: Buckets.of((r.n, r.low, r.high) for r in found if r.c == i) for i, c in enumerate(self.names)}
        totals = {r.c: r.n for r in found}
        self.counts = {name: totals.get(-1 - i, 0) for i, (name, _) in enumerate(conditions)}

    @staticmethod
    def _entry(number: int, value: Column, condition: Column) -> Column:
        return F.when(condition, F.struct(F.lit(number).alias("c"), value.alias("v")))

    @staticmethod
    def _counted(entries: DataFrame, count: Column) -> list:
        return entries.groupBy("c", "b").agg(count.alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()

    def sharpen(self, needed) -> None:
        """Cut ranges finer until ``needed``, called for the ranges of each column, names none that is still open."""
        self.survivors = None
        while True:
            marked = {c: needed(c, b) for c, b in self.buckets.items() if b.total}
            runs = [(i, c, *run) for i, c in enumerate(self.names) if c in marked for run in _runs(marked[c], self.buckets[c])]
            if not runs:
                return
            few = sum(int(np.where(x.open, x.n, 1)[a:b].sum()) for _, c, a, b in runs for x in [self.buckets[c]]) <= self.direct_limit
            held = self._held(runs)
            if few:
                rows = held.collect()  # distinct values, no more than the limit
                self._replace(runs, [(r.c, r.n, r.v, r.v) for r in rows])
                continue
            if self.survivors is None:
                path = f"{scratch_folder(self.frame.sparkSession)}/selection-{uuid4().hex}"
                held.write.parquet(path)
                held = self.survivors = self.frame.sparkSession.read.schema(held.schema).parquet(path)
                held = self._held(runs)
            cells = [F.when((F.col("c") == i) & self._between(F.col("v"), c, a, b), self._cell(k, c, a, b)) for k, (i, c, a, b) in enumerate(runs)]
            cut = held.withColumn("b", F.coalesce(*cells))
            self._replace(runs, [(r.c, r.n, r.low, r.high) for r in self._counted(cut, F.sum("n"))])

    def _between(self, value: Column, c: str, a: int, b: int) -> Column:
        return value.between(F.lit(float(self.buckets[c].low[a])), F.lit(float(self.buckets[c].high[b - 1])))

    def _cell(self, run: int, c: str, a: int, b: int) -> Column:
        low, high = float(self.buckets[c].low[a]), float(self.buckets[c].high[b - 1])
        if low * high > 0 and not 0.5 < low / high < 2:  # several powers of two: equal widths of the logarithm
            begin, end = math.log(abs(low)), math.log(abs(high))
            share = (F.log(F.abs(F.col("v"))) - F.lit(begin)) / F.lit(end - begin)
        else:
            share = (F.col("v") / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
        return F.lit(run * 2 * CELLS) + F.floor(share * CELLS)

    def _held(self, runs: Sequence[tuple]) -> DataFrame:
        """Distinct values with their counts in some runs of ranges, from the survivors if there are any."""
        if self.survivors is not None:
            inside = [(F.col("c") == i) & self._between(F.col("v"), c, a, b) for i, c, a, b in runs]
            return self.survivors.filter(reduce(lambda x, y: x | y, inside))
        entries = [self._entry(i, self.columns[c], self._between(self.columns[c], c, a, b)) for i, c, a, b in runs]
        return _entries(self.frame, entries).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))

    def _replace(self, runs: Sequence[tuple], finer: list[tuple]) -> None:
        for i, c in dict.fromkeys(run[:2] for run in runs):
            old = self.buckets[c]
            kept = np.ones(len(old.n), bool)
            for j, _, first, stop in runs:
                if j == i:
                    kept[first:stop] = False
            rest = zip(old.n[kept].tolist(), old.low[kept].tolist(), old.high[kept].tolist(), strict=True)
            self.buckets[c] = Buckets.of([*rest, *(r[1:] for r in finer if r[0] == i)])

    def quantiles(self, probabilities: Sequence[float]) -> dict[str, dict[float, float | None]]:
        """Linear-interpolated quantiles of every column; null where a column has no values."""
        self.sharpen(lambda _, b: reduce(np.logical_or, [b.holding(p * (b.total - 1)) for p in probabilities]))
        return {c: {p: self._quantile(b, p) for p in probabilities} for c, b in self.buckets.items()}

    @staticmethod
    def _quantile(buckets: Buckets, p: float) -> float | None:
        if not buckets.total:
            return None
        position = p * (buckets.total - 1)
        first = int(position)
        low = float(buckets.low[buckets.of_rank(first)])
        high = float(buckets.low[buckets.of_rank(min(first + 1, buckets.total - 1))])
        return low if low == high or position == first else low + (high - low) * (position - first)

    def fences(self, factor: float) -> dict[str, tuple[float, float, int]]:
        """Bounds a factor of the quartile distance beyond the quartiles, and the values outside, of columns with such a distance."""

        def needed(_: str, b: Buckets) -> np.ndarray:
            positions = [p * (b.total - 1) for p in (0.25, 0.75)]
            (q1_low, q1_high), (q3_low, q3_high) = map(b.span, positions)
            held = b.holding(positions[0]) | b.holding(positions[1])
            least, most = q3_low - q1_high, q3_high - q1_low
            for bounds in ((q1_low - factor * most, q1_high - factor * least), (q3_low + factor * least, q3_high + factor * most)):
                margin = 1e-14 * max(map(abs, (*bounds, q1_low, q3_high)))
                held |= (b.high >= min(bounds) - margin) & (b.low <= max(bounds) + margin)
            return held

        self.sharpen(needed)
        out = {}
        for c, b in self.buckets.items():
            q1, q3 = self._quantile(b, 0.25), self._quantile(b, 0.75)
            if q1 is not None and q1 != q3:
                low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
                out[c] = (low, high, b.outside(low, high))
        return out

    def below_zero(self, column: str) -> int:
        """Negative values; magnitudes of different sign never share a range."""
        b = self.buckets[column]
        return int(b.n[b.high < 0].sum())


def _entries(frame: DataFrame, entries: list[Column]) -> DataFrame:
    """One row for each entry that is there."""
    return frame.select(F.inline(F.array(*entries))).filter("c IS NOT NULL")


def _by_magnitude(value: Column) -> Column:
    """A number that does not fall as the value rises: sign and stepped logarithm; infinities stand alone."""
    stepped = F.floor(F.when(F.abs(value) < float("inf"), F.log(F.abs(value)) * STEPS).otherwise(OFFSET - 1.0))
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, stepped + OFFSET).otherwise(-(stepped + OFFSET))


def _runs(marked: np.ndarray, buckets: Buckets) -> list[tuple[int, int]]:
    """Begin and end of the stretches of marked ranges of one sign, cut down to their first and last open one.

    A stretch is split where it holds many ranges, so that cutting it again into equal parts makes finer ones than before.
    """
    change = np.flatnonzero(np.diff(marked.astype(np.int8)) | np.diff(np.sign(buckets.low)).astype(bool)) + 1
    opened = [x[marked[x] & buckets.open[x]] for x in np.split(np.arange(len(marked)), change)]
    found = [part for x in opened for part in np.array_split(x, -(-len(x) // (CELLS // 16)) or 1)]
    return [(int(x[0]), int(x[-1]) + 1) for x in found if len(x)]
