"""Small gradient-boosted trees for the log loss, in numpy, with a calibration of their scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    depth: int = 3
    start: float = 0.0
    # Of each tree, by node in level order: the feature, the limit (left if at most), and the leaves' values.
    features: list[np.ndarray] = field(default_factory=list)
    limits: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    # Calibration: probabilities by rising score.
    scores: np.ndarray | None = None
    probabilities: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, limit, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > limit[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        s = self.score(x)
        if self.scores is None or not len(self.scores):
            return 1 / (1 + np.exp(-s))
        return np.interp(s, self.scores, self.probabilities)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Isotonic: neighbours by score are pooled until their shares of positives rise."""
        order = np.argsort(self.score(x), kind="stable")
        pools: list[list[float]] = []
        for s, v in zip(self.score(x)[order], y[order], strict=True):
            pools.append([float(v), 1.0, float(s)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                v2, n2, s2 = pools.pop()
                v1, n1, s1 = pools[-1]
                pools[-1] = [v1 + v2, n1 + n2, (s1 * n1 + s2 * n2) / (n1 + n2)]
        self.scores = np.array([p[2] for p in pools])
        self.probabilities = np.array([p[0] / p[1] for p in pools])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, leaf_rows: int = 8, bins: int = 32) -> Trees:
    """Newton boosting; splits are sought between the quantiles of every feature."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(depth, float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)))[:-1] for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p) + 1e-9
        feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == at)
                best = 1e-6
                if len(rows) >= 2 * leaf_rows:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        size = len(c) + 1
                        gl, hl, nl = (np.cumsum(np.bincount(coded[rows, f], w, size))[:-1] for w in (g[rows], h[rows], None))
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < leaf_rows) | (len(rows) - nl < leaf_rows)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, feature[at], limit[at] = float(gain[k]), f, float(c[k])
                node[rows] = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
        leaf = node - (2**depth - 1)
        n = 2**depth
        value = -rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1)
        score += value[leaf]
        model.features.append(feature)
        model.limits.append(limit)
        model.leaves.append(value)
    return model
