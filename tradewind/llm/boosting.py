"""Gradient boosting of small trees over counted classes of small-integer features, and the trees as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _probability(margin: float) -> float:
    return 1 / (1 + math.exp(-margin)) if margin > -700 else 0.0


def _best_split(rows: list[tuple], features: int, smooth: float, least: float) -> tuple[float, int, int] | None:
    """(gain, feature, value) of the best split `feature <= value` of rows (features, gradient, hessian), above `least`."""
    total_g, total_h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    worth = lambda g, h: g * g / (h + smooth)
    best = None
    for f in range(features):
        sums: dict[int, list[float]] = {}
        for x, g, h in rows:
            own = sums.setdefault(x[f], [0.0, 0.0])
            own[0] += g
            own[1] += h
        g = h = 0.0
        for value in sorted(sums)[:-1]:
            g, h = g + sums[value][0], h + sums[value][1]
            gain = worth(g, h) + worth(total_g - g, total_h - h) - worth(total_g, total_h)
            if gain > (least if best is None else best[0]):
                best = (gain, f, value)
    return best


def _grow(rows: list[tuple], features: int, depth: int, rate: float, smooth: float):
    """A leaf value, or (feature, value, tree for <=, tree for >)."""
    # a split without gain may make one below it worth while
    split = _best_split(rows, features, smooth, 1e-9 if depth == 1 else -1e9) if depth else None
    if split is None:
        return -rate * sum(r[1] for r in rows) / (sum(r[2] for r in rows) + smooth)
    _, f, value = split
    return (f, value, *[_grow([r for r in rows if (r[0][f] <= value) == low], features, depth - 1, rate, smooth)
                        for low in (True, False)])


def tree_value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


class BoostedTrees:
    """Log-odds as a sum of trees, fitted to classes (features, rows, positive rows) with logistic loss."""

    def __init__(self, start: float, trees: list):
        self.start, self.trees = start, trees

    @classmethod
    def fit(cls, classes: list[tuple], trees: int = 20, depth: int = 3, rate: float = 0.3,
            smooth: float = 1.0) -> BoostedTrees:
        classes = sorted(classes)
        n, positive = sum(c[1] for c in classes), sum(c[2] for c in classes)
        start = math.log((positive + 0.5) / (n - positive + 0.5))
        margins, grown = [start] * len(classes), []
        for _ in range(trees if classes else 0):
            rows = []
            for (x, m, pos), margin in zip(classes, margins):
                p = _probability(margin)
                rows.append((x, m * p - pos, m * p * (1 - p)))
            tree = _grow(rows, len(classes[0][0]), depth, rate, smooth)
            if not isinstance(tree, tuple):
                break
            grown.append(tree)
            margins = [margin + tree_value(tree, x) for (x, _, _), margin in zip(classes, margins)]
        return cls(start, grown)

    def margin(self, x) -> float:
        return self.start + sum(tree_value(t, x) for t in self.trees)

    def column(self, features: list[Column]) -> Column:
        """The margin as a column over feature columns."""
        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            f, value, low, high = tree
            return F.when(features[f] <= value, of(low)).otherwise(of(high))

        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + of(tree)
        return total

    def threshold(self, classes: list[tuple], precision: float) -> float | None:
        """The lowest margin at and above which held-out rows reach the precision; None if there is none."""
        found, n, positive = None, 0, 0
        by_margin: dict[float, list[int]] = {}
        for x, m, pos in classes:
            own = by_margin.setdefault(self.margin(x), [0, 0])
            own[0] += m
            own[1] += pos
        for margin in sorted(by_margin, reverse=True):
            n, positive = n + by_margin[margin][0], positive + by_margin[margin][1]
            if positive >= precision * n:
                found = margin
        return found
