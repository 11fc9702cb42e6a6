"""A k-d tree over vectors of small counts, searched for many vectors at once.

A vector is near another if at most ``up`` must be added and at most ``down``
taken away, summed over its components.  A box whose least such costs exceed
that holds no near vector, so it is pruned; what a vector has spent is carried
down the tree, component by component, so that two cuts of one component cost
the larger of the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Below and above every count.
LOW, HIGH = -1, 1 << 30


class KdTree:
    """Splits ``vectors`` (a row each) until a part has at most ``most`` rows or only equal ones.

    ``leaves`` holds the row numbers of each leaf.
    """

    def __init__(self, vectors: np.ndarray, most: float):
        # Of each inner node: the component, the greatest count on the left, the node's own bounds there, and both children (leaf n is ~n).
        self.nodes: list[list[int]] = []
        self.leaves: list[np.ndarray] = []
        self.root = -1
        todo = [(np.arange(len(vectors)), {}, -1, 0)]
        while todo:
            rows, bounds, parent, side = todo.pop()
            cut = _cut(vectors[rows]) if len(rows) > most else None
            if cut is None:
                number = ~len(self.leaves)
                self.leaves.append(rows)
            else:
                dim, at = cut
                low, high = bounds.get(dim, (LOW, HIGH))
                number = len(self.nodes)
                self.nodes.append([dim, at, low, high, 0, 0])
                left = vectors[rows, dim] <= at
                todo.append((rows[left], bounds | {dim: (low, at)}, number, 4))
                todo.append((rows[~left], bounds | {dim: (at + 1, high)}, number, 5))
            if parent < 0:
                self.root = number
            else:
                self.nodes[parent][side] = number

    def forget(self) -> KdTree:
        """Drop the rows of the leaves: what is left tells only which leaf a vector belongs to."""
        self.leaves = [rows[:0] for rows in self.leaves]
        return self

    def search(self, vectors: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, numbers of the vectors that may have a near one there); with no costs each vector is in one leaf."""
        n = len(vectors)
        spent = np.zeros(n, np.int32)
        todo = [(self.root, np.arange(n), spent, spent)]
        while todo:
            node, rows, added, taken = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows
                continue
            dim, at, low, high, left, right = self.nodes[node]
            own = vectors[rows, dim].astype(np.int32)
            more = taken + np.maximum(own - at, 0) - np.maximum(own - high, 0)
            keep = more <= down
            todo.append((left, rows[keep], added[keep], more[keep]))
            more = added + np.maximum(at + 1 - own, 0) - np.maximum(low - own, 0)
            keep = more <= up
            todo.append((right, rows[keep], more[keep], taken[keep]))


def _cut(vectors: np.ndarray) -> tuple[int, int] | None:
    """The component and count that divide the rows most evenly, None if all are equal."""
    ordered = np.sort(vectors, axis=0)
    half = len(ordered) // 2
    best, found = 0, None
    for dim in np.flatnonzero(ordered[0] != ordered[-1]).tolist():
        column = ordered[:, dim]
        # Equal counts stay together, so the cut is before or after those of the median.
        for at in {int(column[half]), int(column[half]) - 1}:
            smaller = int(np.searchsorted(column, at, side="right"))
            smaller = min(smaller, len(column) - smaller)
            if smaller > best:
                best, found = smaller, (dim, at)
    return found
