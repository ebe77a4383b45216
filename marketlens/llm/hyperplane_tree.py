"""Multiway hyperplane tree with distance ranges between siblings (GNAT), in numpy.

A node has up to ``FAN`` split points; a vector belongs to the nearest of them, so the children are
cut apart by the hyperplanes between split points. For every pair of split point i and child j the
node keeps the least and the largest distance from i to the vectors below j. A query is a ring
(annulus): all vectors whose distance to the query point lies in [inner, outer]. With d the distance
from the query point to split point i, such a vector's distance to i lies in
[max(d - outer, inner - d), d + outer]; a child whose range with any split point misses that interval
holds none and is left out with everything below it.

The tree is made from a sample; the ranges are taken over all vectors, so no vector is missed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

FAN = 8


@dataclass
class Node:
    points: np.ndarray                     # split points, one a row
    children: list[Node | int]             # a node, or the number of a leaf
    low: np.ndarray = field(default=None)  # low[i, j]: least distance from point i to the vectors below j
    high: np.ndarray = field(default=None)


@dataclass
class Tree:
    root: Node | int
    leaves: int
    nodes: list[Node]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of every row of ``a`` to every row of ``b``."""
    squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0))


def grow(sample: np.ndarray, leaf_share: float, fan: int = FAN) -> Tree:
    """Tree over ``sample``; a group of at most ``leaf_share`` of the sample is a leaf."""
    nodes: list[Node] = []
    leaves = 0
    least = max(2 * fan, int(leaf_share * len(sample)))

    def split(rows: np.ndarray) -> Node | int:
        nonlocal leaves
        points = _spread(rows, fan) if len(rows) > least else rows[:0]
        if len(points) < 2:
            leaves += 1
            return leaves - 1
        node = Node(points, [])
        nodes.append(node)
        nearest = distances(rows, points).argmin(axis=1)
        node.children = [split(rows[nearest == j]) for j in range(len(points))]
        return node

    root = split(sample)
    return Tree(root, leaves, nodes)


def _spread(rows: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` different rows, each the farthest from those before (of a few candidates, as the farthest
    of all would be outliers)."""
    few = rows[np.linspace(0, len(rows) - 1, min(len(rows), 3 * k)).astype(int)]
    chosen = [0]
    gap = distances(few, few[:1])[:, 0]
    while len(chosen) < k and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(few, few[chosen[-1:]])[:, 0])
    return few[chosen]


def route(tree: Tree, rows: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray] | None]]:
    """(leaf of every row, per node the (low, high) of these rows or None where none came by)."""
    leaf = np.zeros(len(rows), np.int32)
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def down(at: Node | int, which: np.ndarray) -> None:
        if not len(which):
            return
        if not isinstance(at, Node):
            leaf[which] = at
            return
        d = distances(rows[which], at.points)
        nearest = d.argmin(axis=1)
        k = len(at.points)
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for j in range(k):
            mine = nearest == j
            if mine.any():
                low[:, j], high[:, j] = d[mine].min(axis=0), d[mine].max(axis=0)
                down(at.children[j], which[mine])
        seen[id(at)] = (low, high)

    down(tree.root, np.arange(len(rows)))
    return leaf, [seen.get(id(n)) for n in tree.nodes]


def rings(tree: Tree, queries: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(query numbers, leaves) that can hold a vector of the query's rings: ``inner`` and ``outer`` have one column
    a ring, a ring with inner > outer holds nothing. ``slack`` covers rounding."""
    found_q, found_leaf = [], []

    def down(at: Node | int, which: np.ndarray, open_rings: np.ndarray) -> None:
        if not len(which):
            return
        if not isinstance(at, Node):
            found_q.append(which)
            found_leaf.append(np.full(len(which), at, np.int32))
            return
        d = distances(queries[which], at.points)
        left = np.repeat(open_rings[:, :, None], len(at.points), axis=2)  # query, ring, child
        for i in range(len(at.points)):
            from_ = np.maximum(d[:, i, None] - outer[which], inner[which] - d[:, i, None]) - slack
            to = d[:, i, None] + outer[which] + slack
            left &= (at.high[i] >= from_[:, :, None]) & (at.low[i] <= to[:, :, None])
        some = left.any(axis=1)
        for j, child in enumerate(at.children):
            go = some[:, j]
            down(child, which[go], left[go][:, :, j])

    down(tree.root, np.arange(len(queries)), inner <= outer + slack)
    none = np.zeros(0, np.int32)
    q, leaf = (np.concatenate(found_q), np.concatenate(found_leaf)) if found_q else (none, none)
    if not isinstance(tree.root, Node):  # a tree of one leaf
        some = (inner <= outer + slack).any(axis=1)[q]
        return q[some], leaf[some]
    return q, leaf
