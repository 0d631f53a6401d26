"""Open clusters of a greedy fold, found by score bounds instead of one by one.

A row's score with a cluster is a weighted cosine, weighted Jaccard overlaps of sets, and a remainder of known size. One
matrix product gives all cosines and postings from set values to clusters give all overlaps, so only clusters whose bound
reaches the threshold and the best score so far are scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import chain

import numpy as np

#: How far a bound may fall short of the exact score by rounding.
SLACK = 1e-5


def unit(value: np.ndarray) -> np.ndarray:
    size = float(np.linalg.norm(value))
    return value / size if size > 1e-12 else value


def cosine(left: np.ndarray, right: np.ndarray) -> float:
    size = float(np.linalg.norm(left) * np.linalg.norm(right))
    return float(np.dot(left, right) / size) if size > 1e-12 else 0.0


def set_overlap(left: set, right: set) -> float:
    return len(left & right) / len(left | right) if left and right else 0.0


@dataclass
class OpenCluster:
    """What a greedy fold remembers of a cluster: its centre and the union of its members' sets."""

    number: int
    size: int
    centre: np.ndarray
    sets: dict[str, set] = field(default_factory=dict)

    def absorb(self, vector: np.ndarray, sets: dict[str, set], normal: bool = True) -> None:
        moved = (self.centre * self.size + vector) / (self.size + 1)
        self.centre = unit(moved) if normal else moved
        self.size += 1
        for name, values in sets.items():
            self.sets[name] |= values


@dataclass(frozen=True)
class Score:
    """``cosine`` and ``overlaps`` (set name to weight) are added up with ``extra(sets, cluster)``, which is at most ``most``; None
    there excludes the cluster. With ``linked`` (set names) the remainder of a cluster that shares no value of these is 0
    and its score stays below the threshold unless it shares a value of an overlap: others are not looked at."""

    cosine: float
    overlaps: dict[str, float]
    extra: Callable[[dict[str, set], OpenCluster], float | None]
    most: float
    linked: tuple[str, ...] = ()
    positive: bool = False

    def exact(self, vector: np.ndarray, sets: dict[str, set], cluster: OpenCluster) -> float | None:
        rest = self.extra(sets, cluster)
        if rest is None:
            return None
        near = cosine(vector, cluster.centre)
        return self.cosine * (max(0.0, near) if self.positive else near) + sum(w * set_overlap(sets[n], cluster.sets[n]) for n, w in self.overlaps.items()) + rest


class OpenClusters:
    """The open clusters of one key; full ones are forgotten, with ``scan`` all but the most recent compete no more."""

    def __init__(self, score: Score, threshold: float, capacity: int, scan: int | None = None, normal: bool = True) -> None:
        self.score, self.threshold, self.capacity, self.scan, self.normal = score, threshold, capacity, scan, normal
        self.opened = self.compared = 0
        self.sets = tuple(dict.fromkeys([*score.overlaps, *score.linked]))
        self._rebuild([])

    def _rebuild(self, clusters: list[OpenCluster]) -> None:
        room = max(64, 2 * len(clusters))
        self.clusters: list[OpenCluster | None] = []
        self.alive, self.numbers, self.dead = np.zeros(room, bool), np.zeros(room, np.int64), 0
        self.centres: np.ndarray | None = None
        self.counts = {name: np.zeros(room, np.int64) for name in self.sets}
        self.postings: dict[str, dict] = {name: {} for name in self.sets}
        for cluster in clusters:
            self._append(cluster)

    def _append(self, cluster: OpenCluster) -> None:
        at = len(self.clusters)
        self.clusters.append(cluster)
        if self.centres is None:
            self.centres = np.zeros((len(self.alive), len(cluster.centre)), np.float32)
        if at >= len(self.alive):
            grow = lambda a: np.concatenate([a, np.zeros_like(a)])
            self.alive, self.numbers, self.centres = grow(self.alive), grow(self.numbers), grow(self.centres)
            self.counts = {name: grow(counts) for name, counts in self.counts.items()}
        self.alive[at], self.numbers[at] = True, cluster.number
        self._refresh(at, {name: cluster.sets[name] for name in self.sets})

    def _refresh(self, at: int, added: dict[str, set]) -> None:
        cluster = self.clusters[at]
        self.centres[at] = unit(cluster.centre)
        for name, values in added.items():
            self.counts[name][at] = len(cluster.sets[name])
            for value in values:
                self.postings[name].setdefault(value, []).append(at)

    def _shared(self, name: str, values: set, size: int) -> np.ndarray:
        """How many of ``values`` each cluster has."""
        lists = [held for v in values if (held := self.postings[name].get(v))]
        return np.bincount(np.fromiter(chain.from_iterable(lists), np.int64), minlength=size) if lists else np.zeros(size, np.int64)

    def _candidates(self, vector: np.ndarray, sets: dict[str, set]) -> tuple[np.ndarray, np.ndarray]:
        """Places and bounds of the clusters that can reach the threshold, best bound first."""
        size = len(self.clusters)
        shared = {name: self._shared(name, sets[name], size) for name in self.sets}
        fits = self.alive[:size].copy()
        if self.scan is not None:
            fits &= self.numbers[:size] > self.opened - self.scan
        if self.score.linked:
            fits &= sum(shared.values()) > 0
        places = np.flatnonzero(fits)
        bound = np.full(len(places), self.score.most + SLACK)
        if len(places) and self.score.linked:
            linked = sum(shared[name][places] for name in self.score.linked) > 0
            bound[~linked] = SLACK
        for name, weight in self.score.overlaps.items():
            own = shared[name][places]
            bound += weight * own / np.maximum(1, len(sets[name]) + self.counts[name][places] - own)
        if len(places):
            near = self.centres[places] @ unit(vector)
            bound += self.score.cosine * (np.maximum(near, 0) if self.score.positive else near)
        reach = np.flatnonzero(bound >= self.threshold)
        reach = reach[np.argsort(-bound[reach], kind="stable")]
        return places[reach], bound[reach]

    def place(self, vector: np.ndarray, sets: dict[str, set]) -> int:
        """Number of the best cluster at or above the threshold, the first one opened of equal scores, or of a new one."""
        best, best_score = None, -np.inf
        if self.clusters:
            for at, bound in zip(*(x.tolist() for x in self._candidates(vector, sets))):
                if bound < best_score:
                    break
                self.compared += 1
                value = self.score.exact(vector, sets, self.clusters[at])
                if value is not None and (value > best_score or (value == best_score and at < best)):
                    best, best_score = at, value
        if best is None or best_score < self.threshold:
            self.opened += 1
            self._append(OpenCluster(self.opened, 1, vector.copy(), {k: set(v) for k, v in sets.items()}))
            best = len(self.clusters) - 1
        else:
            cluster = self.clusters[best]
            added = {name: sets[name] - cluster.sets[name] for name in self.sets}
            cluster.absorb(vector, sets, self.normal)
            self._refresh(best, added)
        number = self.clusters[best].number
        if self.clusters[best].size >= self.capacity:
            self.alive[best], self.clusters[best] = False, None
            self.dead += 1
        if self.scan is not None and len(self.clusters) > 4 * self.scan or self.dead > max(64, len(self.clusters) // 2):
            oldest = self.opened - self.scan if self.scan is not None else 0
            self._rebuild([c for c in self.clusters if c is not None and c.number > oldest])
        return number
