"""The split searches of splits.py on the driver, for histograms that are small: a few nodes, features and values.

A level's histogram no longer grows with the rows once its values and targets are bounded. Up to LOCAL_ROWS entries it is
collected and searched here in one job a level; larger ones take the distributed plan. Both give the same splits.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

#: Entries of a histogram that the driver takes, about 100 bytes each.
LOCAL_ROWS = 100_000


def small_rows(histogram: DataFrame) -> list | None:
    """The rows of a histogram, or None if there are more than LOCAL_ROWS."""
    rows = histogram.limit(LOCAL_ROWS + 1).collect()
    return rows if len(rows) <= LOCAL_ROWS else None


def best_split_local(rows, parity: bool = False) -> list[tuple[int, int, float]]:
    """node, attr, threshold as of best_split(gini_by_split()), from (node_id, attr, label, value, n) rows."""
    cells: dict = defaultdict(lambda: defaultdict(dict))
    for r in rows:
        cells[r["node_id"]][r["attr"]][(r["value"], r["label"])] = r["n"]
    out = []
    for node, attrs in sorted(cells.items()):
        best = None
        for attr, cell in sorted(attrs.items()):
            values = sorted({v for v, _ in cell})
            labels = {label: i for i, label in enumerate(dict.fromkeys(label for _, label in cell))}
            at = {v: i for i, v in enumerate(values)}
            n = np.zeros((len(values), len(labels)))
            for (v, label), c in cell.items():
                n[at[v], labels[label]] = c
            total = n.sum(0)
            s = np.cumsum(n, 0)[:-1]  # below each value but the least
            if not len(s):
                continue
            left, whole = s.sum(1), total.sum()
            small = 1 - ((s / left[:, None]) ** 2).sum(1)
            right = 1 - (((1 - s / left[:, None]) if parity else (total - s) / (whole - left)[:, None]) ** 2).sum(1)
            exact = 1 - ((total / whole) ** 2).sum() - left / whole * small - (1 - left / whole) * right
            gain = np.round(exact, 9)
            k = int(gain.argmax())  # the first of equals: the least threshold
            if best is None or gain[k] > best[0]:
                best = (gain[k], attr, float(values[k + 1]), exact[k])
        if best and best[3] > 1e-12:
            out.append((node, best[1], best[2]))
    return out


def _lad(y: np.ndarray, n: np.ndarray, trim: float) -> tuple[float, int]:
    """Loss and rows of values y in order with counts n, as of trimmed_lad()."""
    to, total = np.cumsum(n), int(n.sum())
    mid = y[np.searchsorted(to, total // 2, side="right")]
    low = math.floor(round((1 - trim) / 2, 12) * total + 0.5)
    inside = np.maximum(0, np.minimum(to, total - low) - np.maximum(to - n, low))
    return float((inside * np.abs(y - mid)).sum()), total


def best_subset_local(rows, trim: float = 1.0) -> list[tuple[int, int, tuple]]:
    """node, attr, subset as of best_subset(subset_losses()), from (node_id, attr, value, y, n) rows."""
    cells: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for r in rows:
        cells[r["node_id"]][r["attr"]][r["value"]].append((r["y"], r["n"]))
    out = []
    for node, attrs in sorted(cells.items()):
        best = None
        for attr, by_value in sorted(attrs.items()):
            medians = []
            for value, pairs in by_value.items():
                pairs.sort()
                n = np.array([c for _, c in pairs])
                medians.append((pairs[int(np.searchsorted(np.cumsum(n), n.sum() // 2, side="right"))][0], value))
            order = [value for _, value in sorted(medians)]
            place = {value: k for k, value in enumerate(order)}
            flat = sorted((y, c, place[value]) for value, pairs in by_value.items() for y, c in pairs)
            y, n, p = (np.array(x) for x in zip(*flat, strict=True))
            for cut in range(1, len(order)):
                left = p < cut
                (a, i), (b, j) = _lad(y[left], n[left], trim), _lad(y[~left], n[~left], trim)
                loss = round((a * i + b * j) / (i + j), 9)
                if best is None or loss < best[0]:
                    best = (loss, attr, tuple(sorted(order[:cut])))
        if best:
            out.append((node, best[1], best[2]))
    return out
