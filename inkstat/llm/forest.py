"""An isolation forest in arrays: fitted on a bounded sample, applied to batches."""

from __future__ import annotations

import numpy as np


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, float)
    out = np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), 0.0)
    return np.where(n == 2, 1.0, out)


class IsolationForest:
    """Random splits of random features; a point that is split off soon is anomalous."""

    def __init__(self, trees: int = 64, subsample: int = 256, seed: int = 7):
        self.trees, self.subsample, self.seed = trees, subsample, seed
        self.norm = 1.0
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        n = min(self.subsample, len(x))
        self.norm = float(max(expected_path(n), 1e-9))
        depth = int(np.ceil(np.log2(max(n, 2))))
        self.nodes = [self._grow(x[rng.choice(len(x), n, replace=False)], depth, rng) for _ in range(self.trees)] if n else []
        return self

    @staticmethod
    def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, at, left, right, path = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            i = len(feature)
            for a, v in ((feature, -1), (at, 0.0), (left, 0), (right, 0), (path, level + float(expected_path(len(rows))))):
                a.append(v)
            if level < depth and len(rows) > 1:
                lo, hi = rows.min(0), rows.max(0)
                wide = np.flatnonzero(hi > lo)
                if len(wide):
                    f = int(rng.choice(wide))
                    feature[i], at[i] = f, float(rng.uniform(lo[f], hi[f]))
                    below = rows[:, f] < at[i]
                    left[i] = node(rows[below], level + 1)
                    right[i] = node(rows[~below], level + 1)
            return i

        node(x, 0)
        return tuple(np.array(a) for a in (feature, at, left, right, path))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the larger, the sooner a point is split off."""
        if not len(x) or not self.nodes:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, at, left, right, path in self.nodes:
            where = np.zeros(len(x), np.int64)
            while True:
                f = feature[where]
                go = np.flatnonzero(f >= 0)
                if not len(go):
                    break
                below = x[rows[go], f[go]] < at[where[go]]
                where[go] = np.where(below, left[where[go]], right[where[go]])
            total += path[where]
        return 2.0 ** (-total / len(self.nodes) / self.norm)
