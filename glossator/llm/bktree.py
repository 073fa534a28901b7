"""BK-trees over integers under the Hamming distance, searched many queries at a time.

The children of a node are keyed by their integer distance to it. A query at
distance ``d`` from a node with radius ``r`` follows only the edges ``d-r`` to
``d+r``. The search hands each node the queries that reached it as one numpy
array, so that the pruning is the tree's and the arithmetic is vectorised.
"""

from __future__ import annotations

import numpy as np


class BKTree:
    """A BK-tree over the distinct values given; ties and repeats share a node."""

    def __init__(self, values: np.ndarray):
        values = np.unique(np.asarray(values, dtype=np.uint64))
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.rows: list[np.ndarray] = []
        # A node takes the first of its values and hands the rest on by distance.
        waiting = [(values, -1, -1)] if len(values) else []
        while waiting:
            own, parent, edge = waiting.pop()
            at = len(self.values)
            pick = len(own) // 2
            self.values.append(int(own[pick]))
            self.children.append({})
            if parent >= 0:
                self.children[parent][edge] = at
            rest = np.delete(own, pick)
            if len(rest):
                far = np.bitwise_count(rest ^ own[pick])
                order = np.argsort(far, kind="stable")
                rest, far = rest[order], far[order]
                cuts = np.flatnonzero(np.diff(far)) + 1
                for part, distance in zip(np.split(rest, cuts), far[np.r_[0, cuts]]):
                    waiting.append((part, at, int(distance)))

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query positions, matching values) for all pairs within the radius."""
        queries = np.asarray(queries, dtype=np.uint64)
        hit_q, hit_v = [], []
        waiting = [(0, np.arange(len(queries)))] if self.values and len(queries) else []
        while waiting:
            node, who = waiting.pop()
            far = np.bitwise_count(queries[who] ^ np.uint64(self.values[node])).astype(np.int16)
            near = who[far <= radius]
            if len(near):
                hit_q.append(near)
                hit_v.append(np.full(len(near), self.values[node], dtype=np.uint64))
            for edge, child in self.children[node].items():
                inside = who[np.abs(far - edge) <= radius]
                if len(inside):
                    waiting.append((child, inside))
        if not hit_q:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        return np.concatenate(hit_q), np.concatenate(hit_v)
