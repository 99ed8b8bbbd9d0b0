"""Gradient-boosted trees over counted cells of small-integer features.

Rows with the same features are interchangeable, so the training set is a table
of cells (features, rows, positives) aggregated by Spark; its size is bounded by
the product of the features' ranges, not by the data. Fitting is plain
arithmetic on that table, and a fitted model is a Column of nested CASEs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    feature: str
    at: int  # left: feature <= at
    left: Leaf | Split
    right: Leaf | Split


@dataclass
class Model:
    bias: float
    trees: list = field(default_factory=list)
    threshold: float = 2.0  # of a probability; above 1: nothing is selected

    def margin(self, row: dict) -> float:
        total = self.bias
        for node in self.trees:
            while isinstance(node, Split):
                node = node.left if row[node.feature] <= node.at else node.right
            total += node.value
        return total

    def probability(self, row: dict) -> float:
        return 1 / (1 + math.exp(-self.margin(row)))

    def column(self, features: Column) -> Column:
        """The probability, from a struct that has the features as fields."""

        def of(node) -> Column:
            if isinstance(node, Leaf):
                return F.lit(node.value)
            return F.when(features[node.feature] <= node.at, of(node.left)).otherwise(of(node.right))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + of(tree)
        return 1 / (1 + F.exp(-total))


def fit(cells: list[dict], features: list[str], rounds: int = 20, depth: int = 2, rate: float = 0.3, ridge: float = 1.0) -> Model:
    """Logistic boosting; a cell has the features, ``n`` rows and ``pos`` positives."""
    n, pos = sum(c["n"] for c in cells), sum(c["pos"] for c in cells)
    if not 0 < pos < n:
        return Model(bias=math.log((pos + 0.5) / (n - pos + 0.5)))
    model = Model(bias=math.log(pos / (n - pos)))
    margins = [model.bias] * len(cells)
    for _ in range(rounds):
        grads = []
        for c, m in zip(cells, margins):
            p = 1 / (1 + math.exp(-m))
            grads.append((c["n"] * p - c["pos"], c["n"] * p * (1 - p)))
        tree = _grow(cells, grads, list(range(len(cells))), features, depth, rate, ridge)
        if isinstance(tree, Leaf):
            break
        model.trees.append(tree)
        for i, c in enumerate(cells):
            node = tree
            while isinstance(node, Split):
                node = node.left if c[node.feature] <= node.at else node.right
            margins[i] += node.value
    return model


def _grow(cells, grads, rows, features, depth, rate, ridge):
    g, h = sum(grads[i][0] for i in rows), sum(grads[i][1] for i in rows)
    leaf = Leaf(-rate * g / (h + ridge))
    if not depth or len(rows) < 2:
        return leaf
    best = (1e-6, None, None)
    for name in features:
        by: dict[int, list[float]] = {}
        for i in rows:
            s = by.setdefault(cells[i][name], [0.0, 0.0])
            s[0] += grads[i][0]
            s[1] += grads[i][1]
        gl = hl = 0.0
        for value in sorted(by)[:-1]:
            gl, hl = gl + by[value][0], hl + by[value][1]
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            if gain > best[0]:
                best = (gain, name, value)
    _, name, at = best
    if name is None:
        return leaf
    left = [i for i in rows if cells[i][name] <= at]
    right = [i for i in rows if cells[i][name] > at]
    return Split(
        name, at,
        _grow(cells, grads, left, features, depth - 1, rate, ridge),
        _grow(cells, grads, right, features, depth - 1, rate, ridge),
    )


def threshold(scored: list[tuple[float, int, int]], precision: float, z: float = 1.96) -> float:
    """The lowest score from which on the cells (score, rows, positives) reach the precision.

    Reached: by the lower end of Wilson's interval at ``z``. Where no score does: 2, over any probability.
    """
    ordered = sorted((x for x in scored if x[1]), reverse=True)
    out, n, pos = 2.0, 0, 0
    for k, (score, rows, good) in enumerate(ordered):
        n, pos = n + rows, pos + good
        if k + 1 < len(ordered) and ordered[k + 1][0] == score:
            continue
        p = pos / n
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if low >= precision:
            out = score
    return out


def calibrate(model: Model, held: list[dict], precision: float, z: float = 1.96) -> Model:
    """Sets the model's threshold by held-out cells."""
    model.threshold = threshold([(model.probability(c), c["n"], c["pos"]) for c in held], precision, z)
    return model
