"""Exact top-k by inner product: ball trees per shard, searched by branch and bound.

A tree is a flat set of arrays: nodes with centre, radius, smallest id and the range of their points; the points
stand in the order of the leaves. The inner product of a query q with any point of a node is at most
q.centre + |q| * radius. Nodes are taken in falling order of that bound, and a node goes once its bound is below
the k-th score so far, or equal to it while all its ids are larger than the k-th id.
"""

from __future__ import annotations

import io

import numpy as np

LEAF = 256
#: Above this, products of doubles may round; then whole numbers of any size are used.
EXACT = 2.0**52
INT_MIN, INT_MAX = -(2**63), 2**63 - 1


def exact_scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors (as doubles), as int64; what a long can't hold becomes the nearest long."""
    if queries.size and points.size and queries.shape[1] * np.abs(queries).max() * np.abs(points).max() >= EXACT:
        big = np.array([[int(x) for x in q] for q in queries], object) @ np.array([[int(x) for x in p] for p in points], object).T
        return np.clip(big, INT_MIN, INT_MAX).astype(np.int64)
    return np.rint(queries @ points.T).astype(np.int64)


class BallTree:
    """Points of one dimension with ids. Equal points split by their place, so depth is bounded by their number."""

    FIELDS = ("ids", "rows", "points", "centre", "radius", "least", "begin", "end", "left", "right")

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, rows: np.ndarray | None = None):
        """rows tell points apart where ids repeat; without them the ids do."""
        rows = ids if rows is None else rows
        order = np.arange(len(ids))
        nodes: list[list] = []

        def grow(begin: int, end: int) -> int:
            own = points[order[begin:end]]
            centre = own.mean(axis=0)
            far = np.sqrt(((own - centre) ** 2).sum(axis=1))
            me = len(nodes)
            nodes.append([centre, float(far.max()), int(ids[order[begin:end]].min()), begin, end, -1, -1])
            if end - begin > leaf:
                # Split at the median along the line between two far points; ties by place.
                a = own[int(far.argmax())]
                b = own[int(((own - a) ** 2).sum(axis=1).argmax())]
                half = (end - begin) // 2
                along = np.argsort(own @ (b - a), kind="stable")
                order[begin:end] = order[begin:end][along]
                nodes[me][5], nodes[me][6] = grow(begin, begin + half), grow(begin + half, end)
            return me

        if len(ids):
            grow(0, len(ids))
        self.ids, self.rows, self.points = ids[order], rows[order], points[order]
        self.centre = np.array([n[0] for n in nodes]).reshape(len(nodes), points.shape[1])
        self.radius, self.least = np.array([n[1] for n in nodes], float), np.array([n[2] for n in nodes], np.int64)
        self.begin, self.end, self.left, self.right = (np.array([n[i] for n in nodes], np.int64) for i in (3, 4, 5, 6))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, content: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(content)) as held:
            for k in cls.FIELDS:
                setattr(tree, k, held[k])
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that any point of each node can score, rounding included."""
        most = queries @ self.centre.T + np.linalg.norm(queries, axis=1)[:, None] * self.radius
        return most + 1e-9 * np.abs(most) + 1e-6 * (1 + np.linalg.norm(queries, axis=1))[:, None]

    def search(self, query_rows: np.ndarray, queries: np.ndarray, best: TopK) -> int:
        """Offer best every point that can be among a query's k, the query's own row excepted; the number of points scored."""
        if not len(self.ids) or not len(queries):
            return 0
        bounds = self.bounds(queries)
        leaves = np.flatnonzero(self.left < 0)
        alive = self._descend(bounds, best)[:, leaves]
        ranked = np.argsort(-np.where(alive, bounds[:, leaves], -np.inf), axis=1, kind="stable")
        left = alive.sum(axis=1)
        scored, rows = 0, np.arange(len(queries))
        for turn in range(int(left.max(initial=0))):
            rows = rows[left[rows] > turn]
            node = leaves[ranked[rows, turn]]
            keep = best.open(rows, bounds[rows, node], self.least[node])
            for leaf in np.unique(node[keep]):
                mine = rows[keep][node[keep] == leaf]
                part = slice(self.begin[leaf], self.end[leaf])
                scores = exact_scores(queries[mine], self.points[part])
                scored += scores.size
                best.offer(mine, scores, self.ids[part], self.rows[part], query_rows[mine])
        return scored

    def _descend(self, bounds: np.ndarray, best: TopK) -> np.ndarray:
        """Which nodes each query may have to open, judged from the root down by its current k-th score."""
        alive = np.zeros(bounds.shape, bool)
        everyone = np.arange(len(bounds))
        alive[:, 0] = best.open(everyone, bounds[:, 0], np.broadcast_to(self.least[0], len(bounds)))
        for node in np.flatnonzero(self.left >= 0):  # parents stand before their children
            for child in (self.left[node], self.right[node]):
                alive[:, child] = alive[:, node] & best.open(everyone, bounds[:, child], np.broadcast_to(self.least[child], len(bounds)))
        return alive


def spread(points: np.ndarray, leaves: int, least: int = 16) -> dict[str, np.ndarray]:
    """Cuts of a space into at most so many cells, fitted to some points: each cut halves the points of a part at the median along the
    line between two far ones, while a part has 2 * least. Arrays by node: line, cut, left, right (cells are -1 - cell) and the cells' centres."""
    line, cut, left, right, centres = [], [], [], [], []

    def grow(own: np.ndarray, room: int) -> int:
        if room > 1 and len(own) >= 2 * least:
            far = own[int(((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax())]
            other = own[int(((own - far) ** 2).sum(axis=1).argmax())]
            along = own @ (other - far)
            middle = float(np.median(along))
            low = along < middle
            if 0 < low.sum() < len(own):
                me = len(line)
                line.append(other - far)
                cut.append(middle)
                left.append(0)
                right.append(0)
                left[me] = grow(own[low], room // 2)
                right[me] = grow(own[~low], room - room // 2)
                return me
        centres.append(own.mean(axis=0))
        return -len(centres)

    grow(points, max(1, leaves))
    dim = points.shape[1]
    return {"line": np.array(line).reshape(-1, dim), "cut": np.array(cut), "left": np.array(left, np.int64), "right": np.array(right, np.int64), "centres": np.array(centres).reshape(-1, dim)}


def cell_of(cuts: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    at = np.zeros(len(points), np.int64) if len(cuts["line"]) else np.full(len(points), -1, np.int64)
    while (todo := np.flatnonzero(at >= 0)).size:
        node = at[todo]
        low = np.einsum("ij,ij->i", points[todo], cuts["line"][node]) < cuts["cut"][node]
        at[todo] = np.where(low, cuts["left"][node], cuts["right"][node])
    return -1 - at


class TopK:
    """The k best (score, id) of each query so far: higher scores first, ties to the smaller id.

    floor: a score that k points elsewhere reach for certain, so nothing below it can be among a query's k.
    """

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(n, INT_MIN, np.int64) if floor is None else floor
        self.scores, self.ids, self.count = np.full((n, k), INT_MIN, np.int64), np.full((n, k), INT_MAX, np.int64), np.zeros(n, np.int64)

    def open(self, rows: np.ndarray, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether a point of at most this bound and at least this id could still get in."""
        bound, kth = np.floor(bound), self.scores[rows, -1].astype(float)
        room = (self.count[rows] < self.k) | (bound > kth) | ((bound == kth) & (least < self.ids[rows, -1]))
        return room & (bound >= self.floor[rows].astype(float))

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, places: np.ndarray, own: np.ndarray) -> None:
        """scores[i, j] is of the query in row rows[i] with ids[j]; the point whose place is own[i], the query itself, is left out."""
        least = np.maximum(self.floor[rows], np.where(self.count[rows] >= self.k, self.scores[rows, -1], INT_MIN))
        near = scores >= least[:, None]
        for i in np.flatnonzero(near.any(axis=1)):
            row, found = rows[i], np.flatnonzero(near[i])
            found = found[places[found] != own[i]]
            if len(found) > 4 * self.k:  # of many, first those that can stay
                cut = np.partition(scores[i][found], -self.k)[-self.k]
                found = found[scores[i][found] >= cut]
            n = int(self.count[row])
            all_s, all_i = np.concatenate([self.scores[row, :n], scores[i][found]]), np.concatenate([self.ids[row, :n], ids[found]])
            top = np.lexsort((all_i, -all_s))[: self.k]
            self.count[row] = len(top)
            self.scores[row, : len(top)], self.ids[row, : len(top)] = all_s[top], all_i[top]
