"""Exact nearest centres without most of the distances: groups of centres, the triangle inequality, and how far centres moved.

A centre of a group with pivot p and radius r is at least d(x, p) - r away from x. A row first meets the group of its nearest
pivot; another group is left out where that bound is above the best distance so far. Between two sets of centres no distance
changes by more than the largest movement, so that most rows are known to keep their centre. Where bounds leave out little, a
slice of rows meets all centres in one product.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Centres up to which no groups are made; rows handled at once; cells of a product; share from which one product is made.
FEW, ROWS, CELLS, PLAIN = 64, 4096, 1 << 22, 0.5
#: Rounding of a distance as a share of the lengths: squares near 0 lose half of their digits.
ROUNDING = 1e-7


class Groups(NamedTuple):
    """Centres sorted by group, inside a group by id; names are the lowest ids of equal centres, which decide ties."""

    ids: np.ndarray
    centers: np.ndarray
    squares: np.ndarray
    begins: np.ndarray
    pivots: np.ndarray
    radii: np.ndarray
    member: np.ndarray
    names: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in self)


class Found(NamedTuple):
    """For each row the id of the nearest centre, its squared distance less the row's own square, what all others are at least
    away, and the distances computed."""

    ids: np.ndarray
    gaps: np.ndarray
    others: np.ndarray
    computed: int


def _nearest_pivot(c: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    step = max(1, CELLS // len(pivots))
    half = (pivots * pivots).sum(1) / 2
    return np.concatenate([(half - c[i : i + step] @ pivots.T).argmin(1) for i in range(0, len(c), step)])


def grouped(ids: np.ndarray, c: np.ndarray, member: np.ndarray | None = None) -> Groups:
    """Groups of about sqrt(k) centres by nearness, or those of `member` with the pivots and radii that the centres have now."""
    k = len(ids)
    if member is None:
        if k <= FEW:
            member = np.zeros(k, np.int64)
        else:
            pivots = c[np.linspace(0, k - 1, int(k**0.5)).astype(int)]
            for _ in range(4):
                member = _nearest_pivot(c, pivots)
                counts = np.bincount(member, minlength=len(pivots))
                sums = np.zeros_like(pivots)
                np.add.at(sums, member, c)
                pivots = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], pivots)
            member = _nearest_pivot(c, pivots)
    order = np.lexsort((ids, member))
    of = member[order]
    begins = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), k]
    own = c[order]
    pivots = np.add.reduceat(own, begins[:-1], 0) / np.diff(begins)[:, None]
    gaps = np.sqrt(((own - np.repeat(pivots, np.diff(begins), 0)) ** 2).sum(1))
    # Products of equal centres may differ in the last bit with their place.
    cells = np.ascontiguousarray(own + 0.0).view(np.dtype((np.void, 8 * own.shape[1]))).ravel()
    _, same = np.unique(cells, return_inverse=True)
    least = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids[order])
    return Groups(ids[order], own, (own * own).sum(1), begins, pivots, np.maximum.reduceat(gaps, begins[:-1]), member, least[same])


def _all(x: np.ndarray, g: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, gaps and second gaps by one product for each CELLS distances; ties to the lowest id."""
    who, best, second = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
    step = max(1, CELLS // len(g.ids))
    for i in range(0, len(x), step):
        own = slice(i, i + step)
        gaps = g.squares - 2 * x[own] @ g.centers.T
        best[own] = gaps.min(1)
        who[own] = np.where(gaps == best[own, None], g.names, np.iinfo(np.int64).max).min(1)
        if gaps.shape[1] > 1:
            second[own] = np.partition(gaps, 1, 1)[:, 1]
    return who, best, second


def nearest(x: np.ndarray, g: Groups, start: tuple[np.ndarray, np.ndarray] | None = None) -> Found:
    """The nearest centre of each row, ties to the lowest id; `start` has ids and gaps of centres to begin with, of this table or another."""
    parts = [_nearest(x[i : i + ROWS], g, None if start is None else tuple(s[i : i + ROWS] for s in start)) for i in range(0, len(x), ROWS)]
    if not parts:
        return Found(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0)
    return Found(*(np.concatenate([p[a] for p in parts]) for a in range(3)), sum(p.computed for p in parts))


def _nearest(x: np.ndarray, g: Groups, start: tuple | None) -> Found:
    n, k, sizes = len(x), len(g.ids), np.diff(g.begins)
    squares = (x * x).sum(1)
    slack = ROUNDING * (np.sqrt(squares) + np.sqrt(g.squares.max()))
    distance = lambda gaps: np.sqrt(np.maximum(squares + gaps, 0))

    def by_one_product(more: int) -> Found:
        who, best, second = _all(x, g)
        if start is not None:
            old = (start[1] < best) | ((start[1] == best) & (start[0] < who))
            who, best = np.where(old, start[0], who), np.where(old, start[1], best)
        return Found(who, best, distance(second) - slack, more + n * k)

    if len(sizes) == 1:
        return by_one_product(0)
    away = np.sqrt(np.maximum(squares[:, None] + (g.pivots * g.pivots).sum(1) - 2 * x @ g.pivots.T, 0))
    least = away - g.radii - slack[:, None]
    second = np.full(n, np.inf)
    computed = n * len(sizes)
    seen = np.zeros(least.shape, bool)
    if start is None:
        who, best = np.full(n, np.iinfo(np.int64).max), np.full(n, np.inf)
    else:
        who, best = start[0].copy(), start[1].copy()

    def meet(rows: np.ndarray, at: int) -> None:
        nonlocal computed
        own = slice(g.begins[at], g.begins[at + 1])
        gaps = g.squares[own] - 2 * x[rows] @ g.centers[own].T
        computed += gaps.size
        first = gaps.argmin(1)
        value, ids = gaps[np.arange(len(rows)), first], g.names[own][first]
        next_best = np.partition(gaps, 1, 1)[:, 1] if gaps.shape[1] > 1 else np.full(len(rows), np.inf)
        old, old_ids = best[rows], who[rows]
        # The centre to begin with is met again in its own group.
        other = np.where(ids == old_ids, np.inf, np.maximum(old, value))
        second[rows] = np.minimum(np.minimum(second[rows], next_best), other)
        better = (value < old) | ((value == old) & (ids < old_ids))
        best[rows], who[rows] = np.where(better, value, old), np.where(better, ids, old_ids)
        seen[rows, at] = True

    if start is None:
        first = away.argmin(1)
        order = np.argsort(first, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
            meet(rows, int(first[rows[0]]))
    open_ = (least <= distance(best)[:, None]) & ~seen
    if computed + int((open_ @ sizes).sum()) > PLAIN * n * k:
        return by_one_product(computed)
    # Groups that are nearest to many rows first, as they lower the bounds of most.
    for at in np.argsort(-open_.sum(0), kind="stable").tolist():
        rows = np.flatnonzero(open_[:, at])
        rows = rows[least[rows, at] <= np.sqrt(np.maximum(squares[rows] + best[rows], 0))]
        if len(rows):
            meet(rows, at)
    unseen = np.where(seen, np.inf, least).min(1)
    return Found(who, best, np.minimum(distance(second) - slack, unseen), computed)


def moved(x: np.ndarray, now: Found, g: Groups, before: Groups) -> tuple[np.ndarray, int]:
    """The nearest centre of each row among those `before`, which have the ids of `g`; and the distances computed."""
    at = np.argsort(before.ids)
    same = at[np.searchsorted(before.ids, now.ids, sorter=at)]
    own = before.centers[same]
    place = np.argsort(g.ids)
    movement = np.sqrt(((g.centers[place] - before.centers[at]) ** 2).sum(1)).max()
    gap = (own * own).sum(1) - 2 * (x * own).sum(1)
    squares = (x * x).sum(1)
    slack = ROUNDING * (np.sqrt(squares) + np.sqrt(before.squares.max()))
    # All other centres were farther then than this one was.
    unsure = np.flatnonzero(now.others - movement <= np.sqrt(np.maximum(squares + gap, 0)) + slack)
    found = before.names[same]
    again = nearest(x[unsure], before, (found[unsure], gap[unsure]))
    found[unsure] = again.ids
    return found, len(x) + again.computed
