"""Gradient-boosted trees for two classes, small enough to be sent to every worker and scored in batches."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of depth-limited trees on quantile bins, with a threshold calibrated on held-out rows."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 4.0, damp: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.damp = rounds, depth, rate, bins, least, damp
        self.base, self.trees, self.edges, self.threshold = 0.0, [], [], 0.5
        self.calibration: tuple[float, float] = (1.0, 0.0)
        self.flat: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int32) if len(x) else np.zeros((0, len(self.edges)), np.int32)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = (None, -total_g / (total_h + self.damp) * self.rate)
        if depth == 0 or len(rows) < 2:
            return leaf
        best = (1e-6, None, None)
        for j in range(b.shape[1]):
            n = len(self.edges[j]) + 1
            if n < 2:
                continue
            gj = np.cumsum(np.bincount(b[rows, j], weights=g[rows], minlength=n))[:-1]
            hj = np.cumsum(np.bincount(b[rows, j], weights=h[rows], minlength=n))[:-1]
            gain = gj**2 / (hj + self.damp) + (total_g - gj) ** 2 / (total_h - hj + self.damp) - total_g**2 / (total_h + self.damp)
            gain[(hj < self.least / 4) | (total_h - hj < self.least / 4)] = 0
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > best[0]:
                best = (gain[k], j, k)
        if best[1] is None:
            return leaf
        left = b[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1))

    def _apply(self, tree: tuple, b: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if tree[0] is None:
            out[rows] += tree[1]
            return
        left = b[rows, tree[0]] <= tree[1]
        self._apply(tree[2], b, rows[left], out)
        self._apply(tree[3], b, rows[~left], out)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """All trees level by level: each is laid out as a full one, so a row's leaf is found without parting the rows."""
        out, b = np.full(len(x), self.base), self._binned(x)
        if self.flat is None:
            self.flat = [self._laid_out(t) for t in self.trees]
        every = np.arange(len(x))
        for feature, cut, leaf in self.flat:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[every, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out

    def _laid_out(self, tree: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.depth - 1
        feature, cut, leaf = np.zeros(inner, np.int64), np.zeros(inner, np.int32), np.zeros(inner + 1)

        def put(t: tuple, at: int) -> None:
            if at >= inner:
                leaf[at - inner] = t[1]
            elif t[0] is None:  # a leaf above the last level stands for all below it
                put(t, 2 * at + 1), put(t, 2 * at + 2)
            else:
                feature[at], cut[at] = t[0], t[1]
                put(t[2], 2 * at + 1), put(t[3], 2 * at + 2)

        put(tree, 0)
        return feature, cut, leaf

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, c = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + c, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, example: np.ndarray | None = None) -> Boosted:
        """Every fourth example is held out of the trees with all its rows; Platt scaling and the threshold of best F1 come from
        those. Without ``example`` each row is one."""
        held = (np.arange(len(y)) if example is None else example) % 4 == 3
        if y[~held].sum() in (0, (~held).sum()) or y[held].sum() == 0:
            held[:] = False
        tx, ty = x[~held], y[~held]
        self.edges = [np.unique(np.quantile(tx[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        mean = min(max(ty.mean(), 1e-4), 1 - 1e-4)
        self.base, self.trees, self.flat = float(np.log(mean / (1 - mean))), [], None
        b, score, rows = self._binned(tx), np.full(len(ty), self.base), np.arange(len(ty))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(b, p - ty, p * (1 - p), rows, self.depth)
            self.trees.append(tree)
            self._apply(tree, b, rows, score)
        if held.any():
            self._calibrate(self.raw(x[held]), y[held])
        return self

    def _calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        def loss(a: float, c: float) -> float:
            z = np.clip(a * raw + c, -30, 30)
            return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.05 * (a - 1) ** 2 + 0.05 * c * c)

        a, c = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * raw + c, -30, 30)))
            w = p * (1 - p) + 1e-6
            g = np.array([((p - y) * raw).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * c])
            h = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.1]])
            step, now = np.linalg.solve(h, g), loss(a, c)
            # a step that overshoots is halved
            while np.abs(step).max() >= 1e-6 and loss(a - step[0], c - step[1]) > now:
                step = step / 2
            a, c = a - step[0], c - step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.calibration = (float(max(a, 0.05)), float(c))
        p = 1 / (1 + np.exp(-np.clip(self.calibration[0] * raw + self.calibration[1], -30, 30)))
        best = (-1.0, 0.5)
        for t in np.linspace(0.2, 0.8, 25):
            hit = p >= t
            f1 = 2 * (hit & (y == 1)).sum() / max(1, hit.sum() + (y == 1).sum())
            # of equally good thresholds the one nearest to even odds
            if (f1, -abs(t - 0.5)) > (best[0], -abs(best[1] - 0.5)):
                best = (f1, float(t))
        self.threshold = best[1]
