"""Forests of BK-trees over 64-bit fingerprints, built and searched level by level in NumPy."""

from __future__ import annotations

import numpy as np

#: Distances are 0 to 64: an edge is parent * SPAN + distance.
SPAN = 65


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One tree for each bucket. prints: distinct within a bucket; bucket: sorted, from 0 up."""

    def __init__(self, prints: np.ndarray, bucket: np.ndarray):
        n = len(prints)
        self.prints = prints
        self.root = np.searchsorted(bucket, bucket, "left")  # the first print of a bucket is its root
        at, waiting = self.root.copy(), np.flatnonzero(self.root != np.arange(n))
        edges, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(waiting):
            edge = at[waiting] * SPAN + hamming(prints[waiting], prints[at[waiting]])
            kinds, first, which = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(kinds)
            children.append(waiting[first])  # the first to come by an edge becomes the child at its end
            at[waiting] = waiting[first][which]
            waiting = waiting[at[waiting] != waiting]
        self.edges, self.children = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(self.edges)
        self.edges, self.children = self.edges[order], self.children[order]

    def links(self, query: np.ndarray, radius: int):
        """Yields (query, other) index pairs within the radius, a tree level at a time; each pair at least once."""
        node = self.root[query]
        while len(query):
            d = hamming(self.prints[query], self.prints[node])
            near = (d <= radius) & (query != node)
            yield query[near], node[near]
            lo = np.searchsorted(self.edges, node * SPAN + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.edges, node * SPAN + np.minimum(d + radius, SPAN - 1), "right")
            count = hi - lo
            query = np.repeat(query, count)
            node = self.children[np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]

    def components(self, radius: int, block: int = 2048, pivots: int = 6) -> np.ndarray:
        """For each print the smallest index of those that links within its bucket reach.

        First a few prints of each bucket look for theirs, each the first that is still outside the
        bucket's largest class. A link between two prints of that class adds nothing, so only the
        prints outside it search then; every other link has an end among them.
        """
        n = len(self.prints)
        label = np.arange(n)
        size = np.bincount(self.root, minlength=n)[self.root]
        busy = np.flatnonzero(size > 1)
        outside = busy
        for _ in range(pivots):
            if len(outside) <= len(busy) // 16:
                break
            _, at = np.unique(self.root[outside], return_index=True)
            label = self._searched(label, outside[at], radius, block)
            outside = busy[~self._in_largest(label)[busy]]
        return self._searched(label, outside, radius, block)

    def _searched(self, label: np.ndarray, query: np.ndarray, radius: int, block: int) -> np.ndarray:
        for i in range(0, len(query), block):
            for a, b in self.links(query[i : i + block], radius):
                label = join(label, a, b)
        return label

    def _in_largest(self, label: np.ndarray) -> np.ndarray:
        """Which prints belong to the largest class of their bucket, if it has two members or more."""
        count = np.bincount(label, minlength=len(label))
        order = np.lexsort((-count[label], self.root))
        root = self.root[order]
        best = np.full(len(label), -1)
        first = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1])))
        best[root[first]] = label[order[first]]
        return (best[self.root] == label) & (count[label] > 1)


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of linked a and b; label: each item's smallest member so far."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label
