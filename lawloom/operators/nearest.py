"""Exact nearest vectors of many queries in one slice of points, with clusters that prune by the triangle inequality.

The slice is cut into about sqrt(n) clusters by the nearest of evenly spaced members. A query at angle t from a centre is
at least t - r away from every point of a cluster of radius r, so no point there scores above cos(t - r); a cluster whose
bound lies below the k-th best score that the query has already is skipped for it. The best k of every query are exact.
"""

from __future__ import annotations

import numpy as np

STEP_BYTES = 32 << 20  # scores that are worked on at once
ROUNDING = 2e-6  # scores are rounded to six decimals before they are compared


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths == 0, 1.0, lengths)


class Clusters:
    """Points of a slice by cluster. `ranks` is the order of their ids, which decides ties."""

    def __init__(self, vectors: np.ndarray, ranks: np.ndarray):
        self.units, self.ranks = unit_rows(vectors.astype(np.float64)), ranks
        n = len(vectors)
        count = max(1, int(np.sqrt(n)))
        self.centres = self.units[np.linspace(0, n - 1, count).astype(np.int64)]
        self.of, cosine, step = np.empty(n, np.int64), np.empty(n), max(1, STEP_BYTES // (8 * count))
        for i in range(0, n, step):
            near = self.units[i : i + step] @ self.centres.T
            self.of[i : i + step] = near.argmax(axis=1)
            cosine[i : i + step] = near.max(axis=1)
        self.radius = np.zeros(count)
        np.maximum.at(self.radius, self.of, np.arccos(np.clip(cosine, -1, 1)))
        self.order = np.argsort(self.of, kind="stable")
        self.visited = self.skipped = 0

    def best(self, queries: np.ndarray, ks: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, point and score of the best ks[q] points of each query among those in the mask."""
        k = int(ks.max(initial=0))
        at = self.order if mask is None else self.order[mask[self.order]]
        if not len(at) or not k:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        ends = np.cumsum(np.bincount(self.of[at], minlength=len(self.centres)))
        units = unit_rows(np.asarray(queries, np.float64))
        angle = np.arccos(np.clip(units @ self.centres.T, -1, 1))
        bound = np.cos(np.maximum(0, angle - self.radius)) + ROUNDING
        held = _Best(len(units), k, self.ranks)
        filled = np.flatnonzero(np.diff(ends, prepend=0))
        first = filled[bound[:, filled].argmax(axis=1)]  # each query begins where it may score highest
        for queries_first in (True, False):
            for c in filled:
                points = at[ends[c - 1] if c else 0 : ends[c]]
                mine = np.flatnonzero((first == c) if queries_first else (first != c) & (bound[:, c] >= held.floor))
                if not queries_first:
                    self.skipped += int((first != c).sum()) - len(mine)
                self.visited += len(mine)
                step = max(1, STEP_BYTES // (8 * max(1, len(points))))
                for i in range(0, len(mine), step):
                    rows = mine[i : i + step]
                    held.add(rows, points, np.round(units[rows] @ self.units[points].T, 6))
        query, place = np.nonzero((held.point >= 0) & (np.arange(k) < ks[:, None]))
        return query, held.point[query, place], held.score[query, place] + 0.0


class _Best:
    """The best k points of each query so far, by descending score and rank."""

    def __init__(self, queries: int, k: int, ranks: np.ndarray):
        self.k, self.ranks = k, ranks
        self.score, self.point = np.full((queries, k), -np.inf), np.full((queries, k), -1, np.int64)

    @property
    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, rows: np.ndarray, points: np.ndarray, scores: np.ndarray) -> None:
        least = self.floor[rows]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero(scores >= least[:, None])
        if not len(i):
            return
        hit = np.unique(i)
        old, place = np.nonzero(self.point[rows[hit]] >= 0)
        query = np.concatenate([rows[i], rows[hit][old]])
        point = np.concatenate([points[j], self.point[rows[hit][old], place]])
        score = np.concatenate([scores[i, j], self.score[rows[hit][old], place]])
        order = np.lexsort((self.ranks[point], -score, query))
        query, point, score = query[order], point[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.score[query[kept], place[kept]], self.point[query[kept], place[kept]] = score[kept], point[kept]
