"""Gradient-boosted trees for yes/no labels, and isotonic calibration, on a bounded sample in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 3
ROUNDS = 60
RATE = 0.2
BINS = 32
RIDGE = 1.0


@dataclass(frozen=True)
class Trees:
    """``rounds`` complete trees of depth DEPTH; without rounds every margin is ``base``."""

    base: float
    feature: np.ndarray  # rounds x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # rounds x leaves

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return total


def fit_trees(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Logistic loss, second-order leaves. With one kind of label only the base is fitted."""
    inner = 2**DEPTH - 1
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    base = float(np.log(rate / (1 - rate)))
    features, thresholds, leaves = [], [], []
    if len(labels) and 0 < labels.sum() < len(labels):
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in rows.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, rows.T, strict=True)], axis=1)
        margin = np.full(len(rows), base)
        for _ in range(ROUNDS):
            chance = 1 / (1 + np.exp(-margin))
            slope, bend = labels - chance, chance * (1 - chance)
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(rows), np.int64)
            for level in range(DEPTH):
                first = 2**level - 1
                for own in range(first, 2 * first + 1):
                    here = node == own
                    best = _split(binned[here], slope[here], bend[here], edges)
                    if best:
                        feature[own], threshold[own] = best
                node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > threshold[node])
            at = node - inner
            leaf = np.bincount(at, slope, inner + 1) / (np.bincount(at, bend, inner + 1) + RIDGE) * RATE
            margin += leaf[at]
            features.append(feature)
            thresholds.append(threshold)
            leaves.append(leaf)
    shape = (len(features), -1) if features else (0, inner)
    return Trees(
        base, np.array(features, np.int64).reshape(shape), np.array(thresholds, float).reshape(shape),
        np.array(leaves, float).reshape((len(leaves), -1) if leaves else (0, inner + 1)),
    )


def _split(binned: np.ndarray, slope: np.ndarray, bend: np.ndarray, edges: list) -> tuple[int, float] | None:
    best, found = 1e-6, None
    total, weight = slope.sum(), bend.sum()
    for k, edge in enumerate(edges):
        if not len(edge):
            continue
        left = np.cumsum(np.bincount(binned[:, k], slope, len(edge) + 1))[:-1]
        size = np.cumsum(np.bincount(binned[:, k], bend, len(edge) + 1))[:-1]
        gain = left**2 / (size + RIDGE) + (total - left) ** 2 / (weight - size + RIDGE) - total**2 / (weight + RIDGE)
        at = int(gain.argmax())
        if gain[at] > best:
            best, found = gain[at], (k, float(edge[at]))
    return found


@dataclass(frozen=True)
class Calibration:
    """A rising curve from margins to shares of label 1."""

    margin: np.ndarray
    share: np.ndarray

    def score(self, margin: np.ndarray) -> np.ndarray:
        """0 to 1; a trace of the margin itself keeps the order within level parts."""
        smooth = 1 / (1 + np.exp(-margin))
        if not len(self.margin):
            return smooth
        return 0.999 * np.interp(margin, self.margin, self.share) + 0.001 * smooth


def fit_isotonic(margin: np.ndarray, labels: np.ndarray) -> Calibration:
    """Pools neighbours that fall; equal margins are one point."""
    points, at = np.unique(margin, return_inverse=True)
    blocks: list[list[float]] = []  # sum of labels, rows, first and last margin
    for point, hits, rows in zip(points, np.bincount(at, labels), np.bincount(at), strict=True):
        blocks.append([hits, rows, point, point])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            hits, rows, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + hits, blocks[-1][1] + rows, blocks[-1][2], last]
    curve = [(m, hits / rows) for hits, rows, first, last in blocks for m in sorted({first, last})]
    return Calibration(np.array([m for m, _ in curve]), np.array([s for _, s in curve]))


def fit_calibrated(rows: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> tuple[Trees, Calibration]:
    """Trees on all rows, and a curve from the margins that trees of the other folds give each fold."""
    margin = np.zeros(len(rows))
    for fold in np.unique(folds):
        own = folds == fold
        others = ~own if (~own).any() else own
        margin[own] = fit_trees(rows[others], labels[others]).margin(rows[own])
    curve = fit_isotonic(margin, labels) if len(rows) else Calibration(np.empty(0), np.empty(0))
    return fit_trees(rows, labels), curve
