"""A cover tree over norm-augmented vectors, and windows of inner products searched in it.

A vector x gets one more component, the root of M^2 - |x|^2 with M the longest length in the tree, so all lie on one
sphere and a large inner product is a small distance. Nodes of a level cover their points within the level's radius and
lie further apart than it; the next level's radius is smaller by ``BASE``. Children with few points are kept as one
run of their parent. With q = (query, 0), c the centre and r the covering radius of a node, every point's inner product lies
in q.c -+ |q| r, so a node outside a query's window is skipped; runs of points are scored exactly in integers.
"""

from __future__ import annotations

import heapq
import io

import numpy as np

BASE = 1.5
#: A node with at most so many points is a leaf; children below ``LOOSE`` share their parent's run.
LEAF, LOOSE = 64, 8
BATCH = 256
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return dict(found)


def augmented(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    lengths = (v**2).sum(axis=1)
    return np.column_stack([v, np.sqrt(np.maximum(lengths.max(initial=0) - lengths, 0))])


def _net(x: np.ndarray, radius: float) -> np.ndarray:
    """Number of the child of each point: centres lie further apart than ``radius``, the first point is one of them."""
    child = np.zeros(len(x), np.int64)
    centres = x[:1].copy()
    limit = radius**2
    for start in range(1, len(x), BATCH):
        part = x[start : start + BATCH]
        gaps = (part**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * (part @ centres.T)
        near = gaps.argmin(axis=1)
        child[start : start + BATCH] = near
        left = np.flatnonzero(gaps[np.arange(len(part)), near] > limit)
        if not len(left):
            continue
        own = part[left]
        among = (own**2).sum(axis=1)[:, None] + (own**2).sum(axis=1)[None, :] - 2 * (own @ own.T)
        closest, to, fresh = np.full(len(left), np.inf), np.zeros(len(left), np.int64), []
        for i in range(len(left)):
            if closest[i] > limit:
                fresh.append(i)
                nearer = among[i] < closest
                nearer[: i + 1] = False  # a centre stays the first of its points
                nearer[i] = True
                closest[nearer], to[nearer] = among[i][nearer], len(centres) + len(fresh) - 1
                closest[i] = -1.0
        child[start + left] = to
        centres = np.concatenate([centres, own[fresh]])
    return child


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Arrays of a tree: points in the order of its runs, and of each node the centre, radius, run and children."""
    x = augmented(vectors)
    order = np.lexsort((ids,))
    nodes, centres, radii = [[0, len(ids), 0, 0]], [x[order[0]]], [float(np.sqrt(((x - x[order[0]]) ** 2).sum(axis=1)).max())]
    at = 0
    while at < len(nodes):
        start, end, _, _ = nodes[at]
        if end - start > leaf and radii[at] > 0 and nodes[at][2] == 0:
            part = order[start:end]
            child = _net(x[part], radii[at] / BASE)
            sizes = np.bincount(child)
            loose = sizes[child] < LOOSE
            rank = np.where(loose, len(sizes), child)
            by = np.argsort(rank, kind="stable")
            part, rank = part[by], rank[by]
            order[start:end] = part
            first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            if len(first) > 1:
                nodes[at][2:] = [len(nodes), len(first)]
                for a, b in zip(first, [*first[1:], len(part)], strict=True):
                    run = rank[a] == len(sizes)
                    centre = centres[at] if run else x[part[a]]
                    nodes.append([start + a, start + b, -1 if run else 0, 0])
                    centres.append(centre)
                    radii.append(float(np.sqrt(((x[part[a:b]] - centre) ** 2).sum(axis=1)).max()))
        at += 1
    return {"ids": ids[order], "labels": labels[order], "vectors": vectors[order], "nodes": np.array(nodes, np.int64), "centres": np.array(centres)[:, :-1], "radii": np.array(radii)}


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every sum stays below 2**53, else in Python integers, clipped to a long."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ v.astype(object).T, LOWEST, HIGHEST).astype(np.int64)


def reach(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every query with the points of every node, widened by the rounding of doubles."""
    lengths = np.sqrt((q**2).sum(axis=1))[:, None]
    middle = q @ centres.T
    slack = lengths * radii[None, :] + 1e-6 * (1 + np.abs(middle) + lengths * (np.abs(centres).max(axis=1, initial=0) + radii)[None, :])
    return middle - slack, middle + slack


class Windows:
    """Queries of a block: anchor vectors, and for each query its anchor, label and window; the ``k`` best of each window."""

    def __init__(self, block: dict[str, np.ndarray], k: int, same: bool):
        self.ids, self.vectors, self.labels = block["ids"], block["vectors"], block["labels"]
        self.of, self.low, self.high = block["of"], block["low"].copy(), block["high"]
        self.k, self.same = k, same
        self.points = self.vectors.astype(np.float64)
        self.best = tuple(np.zeros(0, np.int64) for _ in range(3))  # query, vec_id, score

    def open(self, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which queries may still gain from scores between ``low`` and ``high``; a tie may win by its id."""
        return (high >= self.low[of]) & (low <= self.high[of])

    def search(self, tree: dict[str, np.ndarray]) -> None:
        nodes, centres, radii = tree["nodes"], tree["centres"], tree["radii"]
        everyone = np.arange(len(self.of))
        low, high = (b[self.of, 0] for b in reach(self.points, centres[:1], radii[:1]))
        heap = [(-high.max(initial=-np.inf), 0, everyone, low, high)]
        while heap:
            _, node, of, low, high = heapq.heappop(heap)
            of = of[self.open(of, low, high)]
            if not len(of):
                continue
            start, end, first, n = nodes[node]
            if n == 0:
                self._verify(tree, start, end, of)
                continue
            anchors, back = np.unique(self.of[of], return_inverse=True)
            low, high = reach(self.points[anchors], centres[first : first + n], radii[first : first + n])
            for i in range(n):
                lo, hi = low[back, i], high[back, i]
                may = self.open(of, lo, hi)
                if may.any():
                    heapq.heappush(heap, (-hi[may].max(), int(first + i), of[may], lo[may], hi[may]))

    def _verify(self, tree: dict[str, np.ndarray], start: int, end: int, of: np.ndarray) -> None:
        anchors, back = np.unique(self.of[of], return_inverse=True)
        ids = tree["ids"][start:end]
        fits = (tree["labels"][start:end][None, :] == self.labels[anchors][:, None]) == self.same
        fits &= ids[None, :] != self.ids[anchors][:, None]
        scores = products(self.vectors[anchors], tree["vectors"][start:end])[back]
        fits = fits[back] & (scores >= self.low[of][:, None]) & (scores <= self.high[of][:, None])
        if scores.shape[1] > self.k:
            shown = np.where(fits, scores, LOWEST)
            fits &= scores >= np.partition(shown, -self.k, axis=1)[:, -self.k][:, None]
        row, col = np.nonzero(fits)
        if len(row):
            self.add(of[row], ids[col], scores[row, col])

    def add(self, query: np.ndarray, who: np.ndarray, score: np.ndarray) -> None:
        """Keeps the ``k`` best of each query, ties to the smaller id, and raises the floors of full ones."""
        query, who, score = (np.concatenate(x) for x in zip(self.best, (query, who, score), strict=True))
        at = np.lexsort((who, -score, query))
        query, who, score = query[at], who[at], score[at]
        rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        full = rank == self.k - 1
        self.low[query[full]] = np.maximum(self.low[query[full]], score[full])
        self.best = query[rank < self.k], who[rank < self.k], score[rank < self.k]
