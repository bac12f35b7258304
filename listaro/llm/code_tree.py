"""Trees over the parts of vectors, and the dual-tree search for each part's nearest codebook entry.

Numpy on one block of vectors. A block's parts of one position lie in a balanced
k-d tree, in whose order they are kept; each node has the box and the sum of its
points. The codebook's entries of that position lie in a tree of the same kind.
All positions are searched at once: the frontier is a table of (position, point
node, entry node).
"""

from __future__ import annotations

import numpy as np

#: A leaf of a point tree holds fewer points than this.
LEAF = 32


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end, in n points; each node is cut in two on the next level."""
    return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


class Forest:
    """One balanced tree per position over ``points`` (positions, n, width), in levels 0 (the root) to ``depth``.

    order: (positions, n), a point's index by its place in the tree. points: in
    that order. low, high: (positions, nodes, width), a node's box; sums: its
    points' sum. Node i of level l is number 2^l - 1 + i.
    """

    def __init__(self, order: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, depth: int):
        self.order, self.points, self.low, self.high, self.sums, self.depth = order, points, low, high, sums, depth
        cuts = [bounds(points.shape[1], level) for level in range(depth + 1)]
        self.begin, self.end = np.concatenate([c[:-1] for c in cuts]), np.concatenate([c[1:] for c in cuts])

    @classmethod
    def over(cls, points: np.ndarray, depth: int) -> Forest:
        positions, n, _ = points.shape
        order = np.tile(np.arange(n), (positions, 1))
        low, high, sums = [], [], []
        for level in range(depth + 1):
            cuts = bounds(n, level)
            placed = np.take_along_axis(points, order[:, :, None], 1)
            low.append(np.minimum.reduceat(placed, cuts[:-1], axis=1))
            high.append(np.maximum.reduceat(placed, cuts[:-1], axis=1))
            sums.append(np.add.reduceat(placed, cuts[:-1], axis=1))
            if level < depth:  # the points of each node are sorted along its widest side, then halved
                widest = np.argmax(high[-1] - low[-1], axis=2)
                node = np.repeat(np.arange(1 << level), np.diff(cuts))
                for p in range(positions):
                    order[p] = order[p][np.lexsort((placed[p, np.arange(n), widest[p][node]], node))]
        return cls(order, np.take_along_axis(points, order[:, :, None], 1), np.concatenate(low, 1), np.concatenate(high, 1), np.concatenate(sums, 1), depth)


def point_forest(points: np.ndarray) -> Forest:
    return Forest.over(points, max(0, (points.shape[1] // LEAF).bit_length() - 1))


def entry_forest(entries: np.ndarray) -> Forest:
    """Deep enough that a leaf has one entry or none."""
    return Forest.over(entries, max(0, (entries.shape[1] - 1).bit_length()))


def _children(nodes: np.ndarray, first_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``nodes``, child) for both children of each node; a leaf is its own child."""
    width = np.where(nodes >= first_leaf, 1, 2)
    at = np.repeat(np.arange(len(nodes)), width)
    second = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
    return at, np.where(width[at] == 1, nodes[at], 2 * nodes[at] + 1 + second)


def nearest(points: Forest, entries: Forest) -> tuple[list[tuple[int, int, int]], list[tuple[int, np.ndarray, np.ndarray]]]:
    """(nodes, rest): ``nodes`` has (position, point node, entry) where one entry is nearest to all points of a node;
    ``rest`` has per position the places of all other points and the entry of each, of equally near ones the first.

    A pair of nodes is dropped where its least distance is above the greatest
    distance from the point node to some other entry node still paired with it;
    so entries that may tie stay. What is left at the leaves is decided point by
    point. All of it is integer arithmetic.
    """
    positions = points.points.shape[0]
    p, a, b = np.arange(positions), np.zeros(positions, np.int64), np.zeros(positions, np.int64)
    first_leaf, first_entry = (1 << points.depth) - 1, (1 << entries.depth) - 1
    nodes, rest = [], []
    while len(p):
        above, below = points.low[p, a] - entries.high[p, b], entries.low[p, b] - points.high[p, a]
        gap = np.maximum(np.maximum(above, below), 0)
        reach = np.maximum(points.high[p, a] - entries.low[p, b], entries.high[p, b] - points.low[p, a])
        least, most = (gap * gap).sum(1), (reach * reach).sum(1)
        group = p * len(points.begin) + a  # pairs of one point node are adjacent
        new = np.concatenate(([True], group[1:] != group[:-1]))
        starts = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        stays = least <= np.minimum.reduceat(most, starts)[of]
        p, a, b, of = p[stays], a[stays], b[stays], of[stays]
        many = np.bincount(of, minlength=len(starts))[of]
        single = b >= first_entry
        sure = single & (many == 1)
        nodes += zip(p[sure].tolist(), a[sure].tolist(), (b[sure] - first_entry).tolist())
        p, a, b, of, single = p[~sure], a[~sure], b[~sure], of[~sure], single[~sure]
        open_pairs = np.bincount(of, weights=~single, minlength=len(starts))[of]
        done = (a >= first_leaf) & (open_pairs == 0)
        if done.any():
            rest += _by_point(points, entries, p[done], a[done], b[done] - first_entry)
            p, a, b = p[~done], a[~done], b[~done]
        # Both nodes of a pair are replaced by their children, a leaf by itself.
        at, a = _children(a, first_leaf)
        p, b = p[at], b[at]
        at, b = _children(b, first_entry)
        p, a = p[at], a[at]
        full = entries.begin[b] < entries.end[b]
        p, a, b = p[full], a[full], b[full]
        together = np.lexsort((b, a, p))
        p, a, b = p[together], a[together], b[together]
    starts_of = entries.begin[first_entry:]
    nodes = [(i, node, int(entries.order[i, starts_of[e]])) for i, node, e in nodes]
    return nodes, rest


def _by_point(points: Forest, entries: Forest, p: np.ndarray, a: np.ndarray, leaf: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The nearest entry of each point of the leaves ``a``, among the entries paired with its leaf."""
    first_leaf, far = (1 << points.depth) - 1, np.iinfo(np.int64).max
    sizes, out = np.diff(bounds(points.points.shape[1], points.depth)), []
    leaf_starts = entries.begin[(1 << entries.depth) - 1 :]
    for i in np.unique(p):
        mine = p == i
        paired = np.zeros((len(sizes), entries.points.shape[1]), bool)
        paired[a[mine] - first_leaf, entries.order[i, leaf_starts[leaf[mine]]]] = True
        of_leaf = np.repeat(np.arange(len(sizes)), sizes)
        places = np.flatnonzero(paired.any(1)[of_leaf])
        by_index = np.empty_like(entries.points[i])
        by_index[entries.order[i]] = entries.points[i]
        less = (by_index * by_index).sum(1) - 2 * (points.points[i, places] @ by_index.T)  # the square of the point is the same for all
        out.append((int(i), places, np.argmin(np.where(paired[of_leaf[places]], less, far), axis=1)))
    return out


def codes(points: Forest, entries: Forest) -> np.ndarray:
    """(positions, n): each part's entry, by the index of the vector."""
    found = np.empty(points.order.shape, np.int64)
    nodes, rest = nearest(points, entries)
    for i, node, entry in nodes:
        found[i, points.begin[node] : points.end[node]] = entry
    for i, places, entry in rest:
        found[i, places] = entry
    out = np.empty_like(found)
    np.put_along_axis(out, points.order, found, 1)
    return out


def totals(points: Forest, entries: Forest) -> tuple[np.ndarray, np.ndarray]:
    """(counts (positions, entries), sums (positions, entries, width)): a node with one entry adds the sum that it keeps."""
    positions, k, width = entries.points.shape
    counts, sums = np.zeros((positions, k), np.int64), np.zeros((positions, k, width), np.int64)
    nodes, rest = nearest(points, entries)
    if nodes:
        i, node, entry = np.array(nodes).T
        np.add.at(counts, (i, entry), points.end[node] - points.begin[node])
        np.add.at(sums, (i, entry), points.sums[i, node])
    for i, places, entry in rest:
        counts[i] += np.bincount(entry, minlength=k)
        np.add.at(sums[i], entry, points.points[i, places])
    return counts, sums
