"""A generalised additive model with pairwise interactions, boosted in turn feature by feature.

Each feature has a lookup table over its bins, each chosen pair a table over coarse bins of both. A
round visits every feature in order and adds a shallow tree (three leaves) fitted to what the model
still gets wrong; afterwards the strongest pairs get trees of four leaves, by turns again. Scoring adds
table entries, nothing else. The fit runs on a bounded sample and is free of chance.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[
                np.searchsorted(self.pair_edges[f], x[:, f], side="right"), np.searchsorted(self.pair_edges[g], x[:, g], side="right")]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _leaf(g, h, l2):
    return g / (h + l2)


def _gain(g, h, l2):
    return g * g / (h + l2)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, l2: float) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins; gain 0 where none helps."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl, l2) + _gain(g.sum() - gl, h.sum() - hl, l2) - _gain(g.sum(), h.sum(), l2)
    gain[(nl < least) | (n.sum() - nl < least)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _three_leaves(g, h, n, least, l2) -> np.ndarray:
    out = np.full(len(g), _leaf(g.sum(), h.sum(), l2))
    gain, at = _split(g, h, n, least, l2)
    if gain <= 0:
        return np.zeros(len(g))
    sides = [slice(0, at), slice(at, len(g))]
    again = [_split(g[s], h[s], n[s], least, l2) for s in sides]
    more = int(again[1][0] > again[0][0])
    for i, s in enumerate(sides):
        cuts = [s.start, s.start + again[i][1], s.stop] if i == more and again[i][0] > 0 else [s.start, s.stop]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), l2)
    return out


def _quadrants(g, h, n, least, l2) -> tuple[float, np.ndarray]:
    """The best cut of both axes at once: its gain and the four leaf values as a table."""
    def parts(x):
        c = x.cumsum(0).cumsum(1)
        a = c[:-1, :-1]
        top, left, all_ = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return np.stack([a, top - a, left - a, all_ - top - left + a])

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    pg, ph, pn = parts(g), parts(h), parts(n)
    gain = _gain(pg, ph, l2).sum(0) - _gain(g.sum(), h.sum(), l2)
    gain[pn.min(0) < least] = 0
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    if gain[i, j] <= 0:
        return 0.0, np.zeros(g.shape)
    leaf = _leaf(pg[:, i, j], ph[:, i, j], l2)
    rows, columns = np.arange(g.shape[0]) > i, np.arange(g.shape[1]) > j
    return float(gain[i, j]), leaf[rows[:, None] * 2 + columns[None, :]]


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 10, rounds: int = 150, pairs: int = 8, pair_rounds: int = 60, rate: float = 0.1, least: int = 10, l2: float = 1.0) -> Model:
    """y is 0 or 1. Without both classes the model is the constant share of ones (one half of nothing)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    width = x.shape[1]
    model.edges = [_edges(x[:, f], bins) for f in range(width)]
    model.pair_edges = [_edges(x[:, f], pair_bins) for f in range(width)]
    at = [np.searchsorted(model.edges[f], x[:, f], side="right") for f in range(width)]
    coarse = [np.searchsorted(model.pair_edges[f], x[:, f], side="right") for f in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    score = np.full(len(y), model.intercept)

    def wrong():
        p = 1 / (1 + np.exp(-score))
        return y - p, np.maximum(p * (1 - p), 1e-9)

    for _ in range(rounds):
        for f in range(width):
            g, h = wrong()
            size = len(model.tables[f])
            step = rate * _three_leaves(np.bincount(at[f], g, size), np.bincount(at[f], h, size), np.bincount(at[f], minlength=size), least, l2)
            model.tables[f] += step
            score += step[at[f]]

    def histograms(f, k, g, h):
        shape = len(model.pair_edges[f]) + 1, len(model.pair_edges[k]) + 1
        cell = coarse[f] * shape[1] + coarse[k]
        return cell, [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h, np.ones(len(y)))]

    g, h = wrong()
    ranked = sorted(((_quadrants(*histograms(f, k, g, h)[1], least, l2)[0], f, k) for f in range(width) for k in range(f + 1, width)), key=lambda r: (-r[0], r[1:]))
    model.pairs = [(f, k) for gain, f, k in ranked[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.pair_edges[f]) + 1, len(model.pair_edges[k]) + 1)) for f, k in model.pairs]
    for _ in range(pair_rounds):
        for number, (f, k) in enumerate(model.pairs):
            cell, parts = histograms(f, k, *wrong())
            step = rate * _quadrants(*parts, least, l2)[1]
            model.pair_tables[number] += step
            score += step.reshape(-1)[cell]
    return model
