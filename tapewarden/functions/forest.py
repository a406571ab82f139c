"""A small isolation forest (Liu, Ting and Zhou, 2008) for the rows of one task.

All trees grow together, one level at a time, so a fit is a handful of numpy
passes. Trees are heap-shaped arrays: node ``i`` has children ``2i+1`` and
``2i+2``; ``feature`` is -1 at a leaf and ``depth`` holds the leaf's expected
path length.
"""

from __future__ import annotations

import io
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np

_EULER = 0.5772156649015329
#: Rows, and rows times trees, that are scored together.
_ROWS, _CELLS = 1024, 1 << 13
#: From so many rows on, leaves are found by masks: the tables are made anew for each call. Rows that are looked up together.
_MANY, _BLOCK = 2048, 4096
_ALL = np.uint64(2**64 - 1)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + _EULER
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Leaves(NamedTuple):
    """Up to 64 leaves of a tree, one bit each. The leaf of a row is the one bit that all its features' words have in common."""

    #: By feature: how many neighbouring ranks (cuts below a value) share a word, and the words; nothing where no cut tells these leaves apart.
    words: dict[int, tuple[np.ndarray, np.ndarray]]
    #: Depth by the number of the bit, and 0 where none is left.
    depth: np.ndarray

    def tables(self) -> dict[int, np.ndarray]:
        """Words by rank."""
        return {feature: np.repeat(words, lengths) for feature, (lengths, words) in self.words.items()}

    def reached(self, common: np.ndarray) -> np.ndarray:
        return self.depth.take(np.bitwise_count(common - np.uint64(1)))


@dataclass(frozen=True)
class Forest:
    feature: np.ndarray  # (trees, nodes), -1 at leaves
    cut: np.ndarray
    depth: np.ndarray
    sample: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1); near 1 is isolated."""
        if len(rows) >= _MANY:
            return self._isolation(self._depths(rows))
        # leaves pass their rows on to the left, so that all paths are equally long and no step asks who has arrived
        levels = (self.feature.shape[1] + 1).bit_length() - 2
        feature, cut, depth = self.feature.astype(np.intp), self.cut.astype(float), self.depth.astype(float)
        for level in range(levels):
            here = slice(2**level - 1, 2 ** (level + 1) - 1)
            leaf = feature[:, here] < 0
            feature[:, here][leaf], cut[:, here][leaf] = 0, np.inf
            lefts = slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1, 2)
            feature[:, lefts][leaf], depth[:, lefts][leaf] = -1, depth[:, here][leaf]
        total = np.zeros(len(rows))
        columns = np.ascontiguousarray(rows.T, dtype=float)
        together = max(1, _CELLS // max(min(len(rows), _ROWS), 1))
        for start in range(0, len(rows), _ROWS):
            block = np.ascontiguousarray(columns[:, start : start + _ROWS])
            width, flat, sums = block.shape[1], block.ravel(), total[start : start + _ROWS]
            line = np.arange(width)
            for first in range(0, len(feature), together):
                trees = slice(first, first + together)
                begin, cuts = (feature[trees] * width).ravel(), cut[trees].ravel()
                base = (np.arange(len(feature[trees])) * feature.shape[1])[:, None]
                # the root of a heap that counts from one, less the place of the first node
                node = np.broadcast_to(base, (len(base), width)).copy()
                for _ in range(levels):
                    at = begin.take(node, mode="clip")
                    at += line
                    right = flat.take(at, mode="clip") > cuts.take(node, mode="clip")
                    node *= 2
                    node += right
                    node -= base - 1
                # one tree after another: the sum has the same bits however many go together
                for reached in depth[trees].ravel().take(node, mode="clip"):
                    sums += reached
        return self._isolation(total)

    def _isolation(self, total: np.ndarray) -> np.ndarray:
        return np.power(2.0, -(total / len(self.feature)) / max(float(average_path(self.sample)), 1e-12))

    @cached_property
    def _leaves(self) -> tuple[list[np.ndarray], list[list[Leaves]]]:
        """The sorted cuts of each feature, and the leaves of each tree."""
        inner = self.feature >= 0
        # nothing is above a missing cut
        cut = np.where(np.isnan(self.cut), np.inf, self.cut.astype(float))
        columns = int(self.feature.max(initial=0)) + 1
        cuts = [np.unique(cut[inner & (self.feature == f)]) for f in range(columns)]
        trees = []
        for feature, limit, depth in zip(self.feature, cut, self.depth.astype(float), strict=True):
            # boxes of ranks, from the root on
            boxes, found = [(0, np.zeros(columns, dtype=np.int64), np.array([len(c) for c in cuts]))], []
            for node, low, high in boxes:
                f = int(feature[node])
                if f < 0:
                    found.append((depth[node], low, high))
                    continue
                rank = int(np.searchsorted(cuts[f], limit[node]))
                left, right = high.copy(), low.copy()
                left[f], right[f] = min(left[f], rank), max(right[f], rank + 1)
                boxes += [(2 * node + 1, low, left)] if low[f] <= left[f] else []
                boxes += [(2 * node + 2, right, high)] if right[f] <= high[f] else []
            trees.append([_leaves_of(found[i : i + 64], cuts) for i in range(0, len(found), 64)])
        return cuts, trees

    def _ranks(self, rows: np.ndarray) -> list[np.ndarray]:
        """Cuts below each value; a missing value is above none."""
        return [np.where(np.isnan(line), 0, np.searchsorted(c, line)) for c, line in zip(self._leaves[0], rows.T.astype(float))]

    def _depths(self, rows: np.ndarray) -> np.ndarray:
        total, ranks = np.zeros(len(rows)), self._ranks(rows)
        # one tree after another, as on a walk: the sum has the same bits
        for tree in self._leaves[1]:
            for leaves in tree:
                tables = leaves.tables()
                for start in range(0, len(rows), _BLOCK):
                    at = slice(start, start + _BLOCK)
                    common = np.full(len(total[at]), _ALL if tables else np.uint64(1))
                    for feature, table in tables.items():
                        common &= table.take(ranks[feature][at])
                    total[at] += leaves.reached(common)
        return total

    def swapped(self, rows: np.ndarray, donors: np.ndarray) -> np.ndarray:
        """Scores of ``rows`` with one feature at a time, that of the column, taken from ``donors``."""
        total = np.zeros((rows.shape[1], len(rows)))
        ranks, others = self._ranks(rows), self._ranks(donors)
        for tree in self._leaves[1]:
            for leaves in tree:
                tables = leaves.tables()
                for start in range(0, len(rows), _BLOCK):
                    at = slice(start, start + _BLOCK)
                    own = {feature: table.take(ranks[feature][at]) for feature, table in tables.items()}
                    # what the features before have in common, then with those behind
                    common = np.full(len(total[0, at]), _ALL if tables else np.uint64(1))
                    rest = {}
                    for feature, words in own.items():
                        rest[feature] = common
                        common = common & words
                    plain = leaves.reached(common)
                    behind = None
                    for feature in reversed(own):
                        if behind is not None:
                            rest[feature] = rest[feature] & behind
                        behind = own[feature] if behind is None else behind & own[feature]
                    for feature in range(len(total)):
                        if feature in rest:
                            total[feature, at] += leaves.reached(rest[feature] & tables[feature].take(others[feature][at]))
                        else:
                            total[feature, at] += plain
        return self._isolation(total).T

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, feature=self.feature.astype(np.int16), cut=self.cut, depth=self.depth, sample=self.sample)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Forest:
        with np.load(io.BytesIO(data), allow_pickle=False) as held:
            return Forest(held["feature"].astype(np.int64), held["cut"], held["depth"], int(held["sample"]))


def _leaves_of(found: list[tuple[float, np.ndarray, np.ndarray]], cuts: list[np.ndarray]) -> Leaves:
    depth, low, high = (np.array(part) for part in zip(*found, strict=True))
    bits = np.uint64(1) << np.arange(len(depth), dtype=np.uint64)
    words = {}
    for feature, limits in enumerate(cuts):
        starts = np.unique(np.concatenate([[0], low[:, feature], high[:, feature] + 1]))
        starts = starts[starts <= len(limits)]
        inside = (low[:, feature] <= starts[:, None]) & (starts[:, None] <= high[:, feature])
        if not inside.all():
            words[feature] = (np.diff(starts, append=len(limits) + 1), np.where(inside, bits, np.uint64(0)).sum(axis=1, dtype=np.uint64))
    if not words and len(depth) > 1:
        raise AssertionError("boxes of leaves overlap")
    return Leaves(words, np.concatenate([depth, np.zeros(65 - len(depth))]))


def grow(samples: np.ndarray, rng: np.random.Generator) -> Forest:
    """One tree per entry of ``samples`` (trees, rows, features)."""
    trees, size, columns = samples.shape
    levels = int(np.ceil(np.log2(max(size, 2))))
    nodes = 2 ** (levels + 1) - 1
    feature = np.full((trees, nodes), -1)
    cut, depth = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    # a line per feature; the rows of a node stand together, nodes in order, and stay so from level to level
    held = np.ascontiguousarray(samples.reshape(-1, columns).T)
    base = np.arange(trees) * nodes
    place, count = np.zeros(trees, dtype=np.int64), np.full(trees, size)
    for level in range(levels + 1):
        depth.ravel()[base + place] = level + average_path(count)
        if level == levels or not held.shape[1]:
            break
        starts = np.cumsum(count) - count
        lows, highs = np.minimum.reduceat(held, starts, axis=1), np.maximum.reduceat(held, starts, axis=1)
        varying = highs > lows
        splits = varying.any(axis=0)
        if not splits.any():
            break
        if not splits.all():
            held = held[:, np.repeat(splits, count)]
            base, place, count = base[splits], place[splits], count[splits]
            varying, lows, highs = varying[:, splits], lows[:, splits], highs[:, splits]
            starts = np.cumsum(count) - count
        varying = varying.T
        pick = np.where(varying, rng.random(varying.shape), -1.0).argmax(axis=1)
        lines = np.arange(len(pick))
        low, high = lows[pick, lines], highs[pick, lines]
        limit = low + rng.random(len(pick)) * (high - low)
        feature.ravel()[base + place], cut.ravel()[base + place] = pick, limit
        row = np.arange(held.shape[1])
        right = held.ravel().take(np.repeat(pick * held.shape[1], count) + row) > np.repeat(limit, count)
        rights = np.add.reduceat(right, starts, dtype=np.int64)
        # the left rows of a node first, then its right ones
        ahead = np.cumsum(right) - np.repeat(np.cumsum(rights) - rights, count)
        order = np.empty(held.shape[1], dtype=np.int64)
        order[np.where(right, np.repeat(starts + count - rights - 1, count) + ahead, row - ahead)] = row
        held = held.take(order, axis=1)
        base, place = np.repeat(base, 2), np.stack([2 * place + 1, 2 * place + 2], axis=1).ravel()
        count = np.stack([count - rights, rights], axis=1).ravel()
        some = count > 0
        if not some.all():
            base, place, count = base[some], place[some], count[some]
    return Forest(feature, cut, depth, size)


def fit(rows: np.ndarray, trees: int, rng: np.random.Generator, sample: int = 256) -> Forest:
    size = min(sample, len(rows))
    draws = rng.random((trees, len(rows)))
    # a tree asks which rows it has, not in what order
    chosen = draws.argpartition(size - 1, axis=1)[:, :size] if size < len(rows) else draws.argsort(axis=1)
    return grow(rows[chosen], rng)
