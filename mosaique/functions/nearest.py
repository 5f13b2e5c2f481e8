"""Nearest rows by Gower distance without all pairs: boxes of rows against candidates, which are left out once they cannot be near."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Distances closer than this are decided by their exact values, not by bounds. It is above the rounding to 9 digits.
SLACK = 4e-9


class Points:
    """Rows as arrays: numbers, and categories as codes of a common list of values (-1: none of them)."""

    def __init__(self, num: list[np.ndarray], cat: list[np.ndarray]):
        self.num, self.cat, self.n = num, cat, len((num or cat)[0]) if num or cat else 0

    def take(self, at: np.ndarray | slice) -> Points:
        return Points([x[at] for x in self.num], [x[at] for x in self.cat])


def values_of(rows: pd.DataFrame, cat: list[str]) -> list[pa.Array]:
    return [pa.array(pd.unique(rows[c]), pa.string()) for c in cat]


def points(table: pa.Table, num: list[str], cat: list[str], values: list[pa.Array]) -> Points:
    codes = [pc.fill_null(pc.index_in(table.column(c), value_set=v), -1).to_numpy() for c, v in zip(cat, values, strict=True)]
    return Points([table.column(c).to_numpy() for c in num], [np.ascontiguousarray(x) for x in codes])


def block(a: Points, b: Points, scale: list[float]) -> np.ndarray:
    """(a, b) distances, as :func:`mosaique.functions.gower.gower_block` has them."""
    out = np.zeros((a.n, b.n))
    for x, y, s in zip(a.num, b.num, scale, strict=True):
        d = np.subtract.outer(x, y)
        np.abs(d, out=d)
        d *= s
        out += d
    for x, y in zip(a.cat, b.cat, strict=True):
        out += x[:, None] != y[None, :]
    out /= len(a.num) + len(a.cat)
    return out


def _bounds(box: list[tuple[float, float]], held: list[np.ndarray], b: Points, scale: list[float], p: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each candidate the least and the greatest distance that it can have to rows in the box."""
    low, high = np.zeros(b.n), np.zeros(b.n)
    for (lo, hi), y, s in zip(box, b.num, scale, strict=True):
        under, over = lo - y, y - hi
        low += np.maximum(np.maximum(under, over), 0.0) * s
        high -= np.minimum(under, over) * s
    for codes, y in zip(held, b.cat, strict=True):
        if len(codes) == 1:
            miss = (y != codes[0]).astype(float)
            low += miss
            high += miss
        else:
            low += ~np.isin(y, codes)
            high += 1.0
    return low / p, high / p


def near(a: Points, b: Points, scale: list[float], groups: list[np.ndarray], k: int, least: float = -1.0, leaf: int = 64) -> Iterator[tuple[np.ndarray, Points, list[np.ndarray]]]:
    """(rows of ``a``, the same as points, per group the places in ``b``), a few rows at a time and every row once.

    For each row the places hold the group's ``k`` nearest ones farther than ``least``, all that are as near as the last of
    them, and all within ``least``. Rows are halved along their widest column; a box's candidates are those of the box around
    it that can be nearer than the k-th greatest possible distance.
    """
    p = len(a.num) + len(a.cat)
    order, own = np.arange(a.n), Points([x.copy() for x in a.num], [x.copy() for x in a.cat])
    todo = [(0, a.n, [(g, b.take(g)) for g in groups])]
    while todo:
        lo, hi, left = todo.pop()
        here = own.take(slice(lo, hi))
        box = [(x.min(), x.max()) for x in here.num]
        held = [np.flatnonzero(np.bincount(x + 1)) - 1 for x in here.cat]
        some = []
        for at, c in left:
            if len(at) > 2 * k + 16:
                low, high = _bounds(box, held, c, scale, p)
                sure = high[low > least]
                if len(sure) >= k:
                    keep = ~(low > np.partition(sure, k - 1)[k - 1] + SLACK)  # what is not a number stays
                    if np.count_nonzero(keep) < len(at):
                        at, c = at[keep], c.take(keep)
            some.append((at, c))
        if hi - lo <= leaf:
            yield order[lo:hi], here, [at for at, _ in some]
            continue
        wide = [(u - v) * s for (v, u), s in zip(box, scale, strict=True)] + [float(len(x) > 1) for x in held]
        i, mid = int(np.argmax(wide)), (hi - lo) // 2
        if i < len(box):
            by = np.argpartition(here.num[i], mid)
        else:
            x = here.cat[i - len(box)]
            by = np.argsort(x, kind="stable")
            ends = np.flatnonzero(np.diff(x[by])) + 1
            if len(ends):
                mid = int(ends[np.abs(ends - mid).argmin()])
        for x in (order, *own.num, *own.cat):
            x[lo:hi] = x[lo:hi][by]
        todo += [(lo, lo + mid, some), (lo + mid, hi, some)]


def least_of(d: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) least values of each row, least first; inf where there are fewer. ``d`` is written over."""
    if d.size and np.isnan(d.min()):
        d[np.isnan(d)] = np.inf
    out = np.full((len(d), k), np.inf)
    every = np.arange(len(d))
    for i in range(min(k, d.shape[1])):
        at = d.argmin(axis=1)
        out[:, i] = d[every, at]
        d[every, at] = np.inf
    return out


def first_of(d: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) places of the least values of each row, least first; of equals the first ones."""
    if d.shape[1] > 4 * k:
        # Values up to the k-th least come first; the order of places is kept among them.
        edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        most = int((d <= edge).sum(axis=1).max())
        if 2 * most < d.shape[1]:
            some = np.sort(np.argsort(d > edge, axis=1, kind="stable")[:, :most], axis=1)
            return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable")[:, :k], axis=1)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def first_of_equals(rows: Points, most: int) -> np.ndarray:
    """The places of at most ``most`` rows of each combination of values, the first ones; in order."""
    by = np.lexsort([np.arange(rows.n), *rows.num, *rows.cat])
    new = np.zeros(rows.n, bool)
    for x in (*rows.num, *rows.cat):
        new[1:] |= np.diff(x[by]) != 0
    new[:1] = True
    start = np.maximum.accumulate(np.where(new, np.arange(rows.n), 0))
    return np.sort(by[np.arange(rows.n) - start < most])


def chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
