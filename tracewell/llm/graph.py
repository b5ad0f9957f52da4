"""A robust-pruned directed graph over the vectors of one shard, built and searched in batches.

Vectors are scaled and get one more coordinate, so that all have length one and the nearest in distance
is the one with the largest inner product.
"""

from __future__ import annotations

import numpy as np

DEGREE, BUILD_BEAM, RELAX = 24, 48, 1.2
ENTRIES, EXPAND, BATCH = 8, 4, 512


def on_sphere(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    norms = np.sqrt((wide * wide).sum(axis=1))
    wide /= norms.max()
    return np.c_[wide, np.sqrt(np.maximum(0, 1 - (norms / norms.max()) ** 2))].astype(np.float32)


def _distances(x: np.ndarray, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of points x[rows] (b, c) to `to` (b, d); vectors have length one."""
    return 2 - 2 * np.einsum("bcd,bd->bc", x[np.maximum(rows, 0)], to, optimize=False)


class Graph:
    def __init__(self, x: np.ndarray, neighbours: np.ndarray, entries: np.ndarray):
        self.x, self.neighbours, self.entries = x, neighbours, entries

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search of a batch: the nearest points found (-1 for none) and their distances."""
        x, b = self.x, len(queries)
        seen = np.zeros((b, len(x)), bool)
        lines = np.arange(b)[:, None]
        ids = np.broadcast_to(self.entries, (b, len(self.entries))).copy()
        seen[lines, ids] = True
        far = _distances(x, ids, queries)
        opened = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, opened = ids[lines, order], far[lines, order], opened[lines, order]
            todo = ~opened & (ids >= 0) & np.isfinite(far)
            pick = np.argsort(~todo, axis=1, kind="stable")[:, :EXPAND]
            chosen = np.where(todo[lines, pick], ids[lines, pick], -1)
            if (chosen < 0).all():
                return ids, far
            opened[lines, pick] = True
            new = np.where(chosen[:, :, None] >= 0, self.neighbours[np.maximum(chosen, 0)], -1).reshape(b, -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[lines, np.maximum(new, 0)]] = -1
            rows, columns = np.nonzero(new >= 0)
            seen[rows, new[rows, columns]] = True
            width = int((new >= 0).sum(axis=1).max(initial=0))
            new = -np.sort(-new, axis=1)[:, :width]
            d = _distances(x, new, queries)
            d[new < 0] = np.inf
            ids, far, opened = np.c_[ids, new], np.c_[far, d], np.c_[opened, np.zeros(new.shape, bool)]


def _prune(x: np.ndarray, points: np.ndarray, found: np.ndarray, relax: float) -> np.ndarray:
    """Keep the nearest candidate, drop those that lie closer to it (by the factor) than to the point, and so on."""
    to = x[points]
    found = np.where(found == points[:, None], -1, found)
    found = np.sort(found, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    d = _distances(x, found, to)
    d[found < 0] = np.inf
    kept, lines = np.full((len(points), DEGREE), -1, np.int32), np.arange(len(points))
    vectors = x[np.maximum(found, 0)]
    for i in range(DEGREE):
        best = d.argmin(axis=1)
        alive = np.isfinite(d[lines, best])
        if not alive.any():
            break
        kept[alive, i] = found[lines, best][alive]
        between = 2 - 2 * np.einsum("bcd,bd->bc", vectors, vectors[lines, best], optimize=False)
        d[relax * relax * between <= d] = np.inf
        d[lines, best] = np.inf
    return kept


def build(x: np.ndarray, seed: int = 0) -> Graph:
    n, random = len(x), np.random.default_rng(seed)
    entries = np.array([int((x @ x.mean(axis=0)).argmax())])
    far = 2 - 2 * x @ x[entries[0]]
    while len(entries) < min(ENTRIES, n):  # entry points far from each other reach clusters that lie apart
        entries = np.r_[entries, far.argmax()]
        far = np.minimum(far, 2 - 2 * x @ x[entries[-1]])
    neighbours = random.integers(0, n, (n, DEGREE), dtype=np.int32)
    graph = Graph(x, neighbours, np.unique(entries))
    for relax in (1.0, RELAX):
        for points in np.array_split(random.permutation(n), -(-n // BATCH)):
            found, _ = graph.search(x[points], BUILD_BEAM)
            own = _prune(x, points, np.c_[found, neighbours[points]], relax)
            neighbours[points] = own
            source, target = np.repeat(points, DEGREE), own.reshape(-1)
            source, target = source[target >= 0], target[target >= 0]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            places, starts, counts = np.unique(target, return_index=True, return_counts=True)
            back = np.full((len(places), counts.max(initial=0)), -1, np.int32)
            back[np.repeat(np.arange(len(places)), counts), np.arange(len(target)) - np.repeat(starts, counts)] = source
            for part in np.array_split(np.arange(len(places)), max(1, len(places) // BATCH)):
                neighbours[places[part]] = _prune(x, places[part], np.c_[neighbours[places[part]], back[part]], relax)
    return graph
