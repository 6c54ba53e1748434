"""Exact search among queries by inner product without most of the products: balls of queries and what they can reach.

The queries of a ball with centre p and radius r have a product of at most x . p + |x| r with a row x. For the largest product a row
first meets the ball of the largest x . p; another ball is left out where its bound is below the best so far. For thresholds a
ball is left out where its bound is not above the lowest threshold in it. Where bounds leave out little, a slice of rows meets
all queries in one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .nearest import CELLS, PLAIN, ROWS, Groups

#: Rounding of a product as a share of the lengths of both vectors.
ROUNDING = 1e-12
_NONE = np.iinfo(np.int64).max


def reach(x: np.ndarray, g: Groups) -> tuple[np.ndarray, np.ndarray]:
    """(largest product that a row can have in each ball, its product with the ball's centre)."""
    length = np.sqrt((x * x).sum(1))[:, None]
    middle = x @ g.pivots.T
    return middle + length * (g.radii + ROUNDING * (1 + np.sqrt(g.squares.max()))), middle


def largest(x: np.ndarray, g: Groups, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, products, products computed): each row's largest product with a query, ties to the lowest id; `start` is what other
    tables gave."""
    parts = [_largest(x[i : i + ROWS], g, None if start is None else tuple(s[i : i + ROWS] for s in start)) for i in range(0, len(x), ROWS)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0), 0
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sum(p[2] for p in parts)


def _largest(x: np.ndarray, g: Groups, start: tuple | None) -> tuple[np.ndarray, np.ndarray, int]:
    n, k, sizes = len(x), len(g.ids), np.diff(g.begins)
    who, best = (np.full(n, _NONE), np.full(n, -np.inf)) if start is None else (start[0].copy(), start[1].copy())
    computed = 0

    def meet(rows: np.ndarray, own: slice) -> None:
        nonlocal computed
        step = max(1, CELLS // max(own.stop - own.start, 1))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            sims = x[some] @ g.centers[own].T
            computed += sims.size
            top = sims.max(1)
            ids = np.where(sims == top[:, None], g.names[own], _NONE).min(1)
            better = (top > best[some]) | ((top == best[some]) & (ids < who[some]))
            best[some], who[some] = np.where(better, top, best[some]), np.where(better, ids, who[some])

    everyone, all_queries = np.arange(n), slice(0, k)
    if len(sizes) == 1:
        meet(everyone, all_queries)
        return who, best, computed
    most, middle = reach(x, g)
    computed += n * len(sizes)
    seen = np.zeros(most.shape, bool)
    first = middle.argmax(1)
    order = np.argsort(first, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
        at = int(first[rows[0]])
        meet(rows, slice(g.begins[at], g.begins[at + 1]))
        seen[rows, at] = True
    # Balls that could give as much count too, for ties.
    open_ = (most >= best[:, None]) & ~seen
    if computed + int((open_ @ sizes).sum()) > PLAIN * n * k:
        meet(everyone, all_queries)
        return who, best, computed
    for at in np.argsort(-open_.sum(0), kind="stable").tolist():
        rows = np.flatnonzero(open_[:, at])
        rows = rows[most[rows, at] >= best[rows]]
        if len(rows):
            meet(rows, slice(g.begins[at], g.begins[at + 1]))
    return who, best, computed


def over(x: np.ndarray, g: Groups, limit: np.ndarray) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """(rows, queries, products) that hold every product above the query's `limit`, given in the order of `g`."""
    for i in range(0, len(x), ROWS):
        yield from ((i + rows, own, sims) for rows, own, sims in _over(x[i : i + ROWS], g, limit))


def _over(x: np.ndarray, g: Groups, limit: np.ndarray) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    n, k, sizes = len(x), len(g.ids), np.diff(g.begins)
    if len(sizes) > 1:
        most, _ = reach(x, g)
        open_ = most >= np.minimum.reduceat(limit, g.begins[:-1])
    if len(sizes) == 1 or n * len(sizes) + int((open_ @ sizes).sum()) > PLAIN * n * k:
        step = max(1, CELLS // k)
        for i in range(0, n, step):
            yield np.arange(i, min(i + step, n)), slice(0, k), x[i : i + step] @ g.centers.T
        return
    for at in np.flatnonzero(open_.any(0)).tolist():
        rows, own = np.flatnonzero(open_[:, at]), slice(g.begins[at], g.begins[at + 1])
        yield rows, own, x[rows] @ g.centers[own].T
