"""Gradient-boosted trees for two classes: fitted from histograms, kept as flat node arrays.

Node ``k`` of a tree has ``feature[k]`` (-1 at a leaf), ``threshold[k]``, ``left[k]``, ``right[k]`` and
``value[k]``. A row goes left where its feature is at most the threshold. Features with constraint +1 (-1) can only
raise (lower) the margin: splits against it are refused, and the bounds of a split's two sides meet at
the middle of their values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(go, self.left[at], self.right[at]))
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x, y, monotone=None, trees: int = 60, depth: int = 3, rate: float = 0.15, least: float = 2.0, bins: int = 64, ridge: float = 1.0) -> Trees:
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, m = x.shape
    monotone = [0] * m if monotone is None else list(monotone)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(m)]
    where = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]) if n else np.empty((0, m), int)
    share = min(max((y.sum() + 1) / (n + 2), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node(**v) -> int:
        for k in out:
            out[k].append(v.get(k, -1 if k in ("feature", "left", "right") else 0.0))
        return len(out["value"]) - 1

    margin = np.full(n, base)
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            v = float(np.clip(gs / (hs + ridge), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) > 1:
                for j in range(m):
                    k = len(cuts[j]) + 1
                    if k < 2:
                        continue
                    gl = np.cumsum(np.bincount(where[rows, j], g[rows], k))[:-1]
                    hl = np.cumsum(np.bincount(where[rows, j], h[rows], k))[:-1]
                    nl = np.cumsum(np.bincount(where[rows, j], minlength=k))[:-1]
                    a, b = np.clip(gl / (hl + ridge), low, high), np.clip((gs - gl) / (hs - hl + ridge), low, high)
                    gain = 2 * gl * a - (hl + ridge) * a**2 + 2 * (gs - gl) * b - (hs - hl + ridge) * b**2 - (2 * gs * v - (hs + ridge) * v**2)
                    bad = (np.minimum(hl, hs - hl) < least / 10) | (np.minimum(nl, len(rows) - nl) < least)
                    if monotone[j]:
                        bad |= (b - a) * monotone[j] < 0
                    gain[bad] = -1
                    s = int(np.argmax(gain))
                    if gain[s] > best[0]:
                        best = (float(gain[s]), (j, s, float(a[s]), float(b[s])))
            if best[1] is None:
                margin[rows] += rate * v
                return node(value=rate * v)
            j, s, a, b = best[1]
            me = node(feature=j, threshold=float(cuts[j][s]))
            mid = (a + b) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[j]]
            side = where[rows, j] <= s
            out["left"][me] = grow(rows[side], level + 1, *bounds[0])
            out["right"][me] = grow(rows[~side], level + 1, *bounds[1])
            return me

        roots.append(grow(np.arange(n), 0, -4.0, 4.0))
    kinds = {"feature": int, "left": int, "right": int}
    return Trees(*(np.array(out[k], kinds.get(k, float)) for k in ("feature", "threshold", "left", "right", "value")), np.array(roots, int), base, depth)
