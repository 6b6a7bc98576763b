"""Exact quantiles of weighted rows for a few groups at once, by counts of cells that are narrowed round by round."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of an interval in one round, and of all intervals together (unless these are more); their counts come to the driver.
CELLS, ALL_CELLS = 2048, 200_000

#: From this round on every other one lays its cells on a logarithmic scale, so that extreme values can't ask for many rounds.
LOG_ROUND = 3


def weighted_quantiles(df: DataFrame, key: str, y: str, n: str, shares: list[float], grid: tuple[float, float] | None = None) -> dict:
    """{key: for each share the least y at or below which that share of the group's mass n lies}; y is not null or NaN.

    A round is one aggregation of df by (interval, cell), combined before the shuffle. Cells are bounded by the least and
    the greatest y in them, so that an interval shrinks each time; it is done once it has one value. grid: where the first
    cells lie, a guess that changes no result; else between the least and the greatest y.
    """
    if grid is None or not all(map(math.isfinite, grid)):
        inside = F.when(F.abs(y) < math.inf, F.col(y))
        grid = tuple(v or 0.0 for v in df.agg(F.min(inside), F.max(inside)).first())
    rows = _cells(df.withColumn("_interval", F.col(key)), y, n, F.lit(grid[0]), F.lit(grid[1]), CELLS, False)
    out = {k: [None] * len(shares) for k in rows}
    seek = {(k, i): _find(cells, max(1, math.ceil(share * sum(c[1] for c in cells)))) for k, cells in rows.items() for i, share in enumerate(shares)}
    turn = 1
    while True:
        for k, i in [at for at, (low, high, _) in seek.items() if low == high]:
            out[k][i] = seek.pop((k, i))[0]
        if not seek:
            return out
        intervals = sorted({(k, low, high) for (k, _), (low, high, _) in seek.items()})
        kind = df.schema[key].dataType.simpleString()
        table = df.sparkSession.createDataFrame([(j, *x) for j, x in enumerate(intervals)], f"_interval int, _key {kind}, _low double, _high double")
        part = df.join(F.broadcast(table), (F.col(key) == F.col("_key")) & F.col(y).between(F.col("_low"), F.col("_high")))
        rows = _cells(part, y, n, F.col("_low"), F.col("_high"), max(2, min(CELLS, ALL_CELLS // len(intervals))), turn >= LOG_ROUND and turn % 2 == 1)
        seek = {(k, i): _find(rows[intervals.index((k, low, high))], rank) for (k, i), (low, high, rank) in seek.items()}
        turn += 1


def _cells(df: DataFrame, y: str, n: str, low: Column, high: Column, cells: int, log: bool) -> dict:
    """{interval: [(cell, mass, least y, greatest y), ...]} in order; the ends are in different cells unless log."""
    scale = (lambda v: F.signum(v) * F.log1p(F.abs(v))) if log else (lambda v: v / 2)  # half of a difference doesn't overflow
    v = F.col(y)
    width = scale(high) - scale(low)
    place = F.floor((scale(v) - scale(low)) / width * cells)
    cell = F.when(width > 0, F.least(place, F.lit(cells - 1)) + 1).otherwise(F.when(v > low, 2).otherwise(1))
    cell = F.when(v == -math.inf, -1).when(v == math.inf, cells + 2).when(v < low, 0).when(v > high, cells + 1).otherwise(cell)
    counted = df.groupBy("_interval", cell.alias("_cell")).agg(F.sum(n).alias("_n"), F.min(v).alias("_least"), F.max(v).alias("_most"))
    out: dict = {}
    for r in sorted(counted.collect(), key=lambda r: r["_cell"]):
        out.setdefault(r["_interval"], []).append((r["_cell"], r["_n"], r["_least"], r["_most"]))
    return out


def _find(cells: list[tuple], rank: int) -> tuple[float, float, int]:
    """Least and greatest y of the cell that holds the rank (from 1), and the rank within it."""
    for _, n, least, most in cells:
        if rank <= n:
            return least, most, rank
        rank -= n
    raise ValueError("the rank is beyond the rows")
