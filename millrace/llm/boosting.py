"""Gradient-boosted regression trees with logistic loss, over binned features, in numpy."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """``edges`` are the bins' limits per feature; a tree is (feature, bin) per inner node and a value per leaf."""

    depth: int = 3
    rate: float = 0.2
    rounds: int = 50
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        b = self.binned(x).astype(np.int64)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            f += self._grow(b, y - p, p * (1 - p))
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One tree, level by level; returns its values for the rows."""
        n, d = b.shape
        inner = (1 << self.depth) - 1
        feature, limit = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(self.depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            for j in range(d):
                at = (node - first) * BINS + b[:, j]
                gs = np.bincount(at, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(at, h, width * BINS).reshape(width, BINS).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best = np.where(better, top, best)
                feature[first : first + width] = np.where(better, j, feature[first : first + width])
                limit[first : first + width] = np.where(better, k, limit[first : first + width])
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > limit[node])
        leaf = node - inner
        value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        self.trees.append((feature, limit, value))
        return value[leaf]

    def to_json(self) -> str:
        return json.dumps({"depth": self.depth, "base": self.base, "edges": [e.tolist() for e in self.edges], "trees": [[a.tolist() for a in t] for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        d = json.loads(text)
        kinds = (np.int64, np.int64, np.float64)
        return cls(depth=d["depth"], base=d["base"], edges=[np.array(e, float) for e in d["edges"]], trees=[tuple(np.array(a, k) for a, k in zip(t, kinds, strict=True)) for t in d["trees"]])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > limit[node])
            f += value[node - len(limit)]
        return f
