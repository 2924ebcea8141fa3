"""Ratio of matching blocks of two strings, and the vendor test built on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import VENDOR_SIMILARITY

# From this length on, letters of the second string that make up more than a share of it are common.
COMMON_FROM, COMMON_SHARE = 200, 100

#: Cells of the tables of common runs that one step holds, over all pairs of strings.
CELLS = 1 << 20


def _codes(strings: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(strings), width), fill, np.int64)
    for k, s in enumerate(strings):
        out[k, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _longest(a: np.ndarray, b: np.ndarray, common: np.ndarray, box: np.ndarray) -> np.ndarray:
    """(begin in a, begin in b, length) of the longest common run within each box (a from, a to, b from, b to).

    The earliest in a, of these the earliest in b. Runs count without letters
    of b that are `common`, and are then drawn out over equal ones of any kind.
    """
    n, m = len(a), b.shape[1]
    at = np.arange(m)
    inside = (at >= box[:, 2:3]) & (at < box[:, 3:4]) & ~common
    best = np.zeros((n, 3), np.int64)
    best[:, 0], best[:, 1] = box[:, 0], box[:, 2]
    run = np.zeros((n, m + 1), np.int64)
    for i in range(int(box[:, 0].min()), int(box[:, 1].max())):
        reads = (box[:, 0] <= i) & (i < box[:, 1])
        equal = inside & (b == a[:, i : i + 1]) & reads[:, None]
        run[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
        run[:, 0] = 0
        j = run[:, 1:].argmax(1)
        long = run[np.arange(n), j + 1]
        better = long > best[:, 2]
        best[better] = np.column_stack([i - long + 1, j - long + 1, long])[better]
    rows = np.arange(n)
    while True:  # drawn out to the left, then to the right
        i, j = best[:, 0] - 1, best[:, 1] - 1
        more = (i >= box[:, 0]) & (j >= box[:, 2]) & (a[rows, np.maximum(i, 0)] == b[rows, np.maximum(j, 0)])
        if not more.any():
            break
        best[more] += (-1, -1, 1)
    while True:
        i, j = best[:, 0] + best[:, 2], best[:, 1] + best[:, 2]
        more = (i < box[:, 1]) & (j < box[:, 3]) & (a[rows, np.minimum(i, a.shape[1] - 1)] == b[rows, np.minimum(j, m - 1)])
        if not more.any():
            return best
        best[more, 2] += 1


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """Letters in matching blocks of many pairs: the longest common run, then the same to its left and to its right."""
    left, right = _codes(a, max(1, *map(len, a)), -1), _codes(b, max(1, *map(len, b)), -2)
    common = np.zeros(right.shape, bool)
    for k, s in enumerate(b):
        if len(s) >= COMMON_FROM:
            letters, counts = np.unique(right[k, : len(s)], return_counts=True)
            common[k, : len(s)] = np.isin(right[k, : len(s)], letters[counts > len(s) // COMMON_SHARE + 1])
    total = np.zeros(len(a), np.int64)
    owner, box = np.arange(len(a)), np.column_stack([np.zeros(len(a), np.int64), list(map(len, a)), np.zeros(len(a), np.int64), list(map(len, b))])
    while len(owner):
        step = max(1, CELLS // right.shape[1])
        found = np.concatenate([_longest(left[owner[k : k + step]], right[owner[k : k + step]], common[owner[k : k + step]], box[k : k + step]) for k in range(0, len(owner), step)])
        np.add.at(total, owner, found[:, 2])
        i, j, long = found.T
        before = np.column_stack([box[:, 0], i, box[:, 2], j])
        after = np.column_stack([i + long, box[:, 1], j + long, box[:, 3]])
        owner, box = np.concatenate([owner, owner]), np.concatenate([before, after])
        open_ = np.concatenate([long, long]) > 0
        open_ &= (box[:, 0] < box[:, 1]) & (box[:, 2] < box[:, 3])
        owner, box = owner[open_], box[open_]
    return total


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """2 * letters in matching blocks / letters of both; 1 for two empty strings. Pairs of like lengths go together."""
    size = np.array([len(x) for x in a]) + np.array([len(y) for y in b])
    out = np.ones(len(a))
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    for part in np.split(order, range(1024, len(order), 1024)):
        if len(part):
            out[part] = 2 * _matched([a[k] for k in part], [b[k] for k in part]) / size[part]
    return out


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks; the order of the arguments matters. Null where one is null."""
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    out = pd.Series([None] * len(a), dtype="float64")
    if len(known):
        out.iloc[known] = ratios(a.iloc[known].tolist(), b.iloc[known].tolist())
    return out


def vendor_contained(vendor: Column, description: Column) -> Column:
    """Whether the vendor occurs in the description, whatever their case; false for a missing or empty vendor."""
    return F.coalesce((F.length(vendor) > 0) & F.contains(F.lower(description), F.lower(vendor)), F.lit(False))


def ratio_possible(vendor: Column, description: Column) -> Column:
    """A bound that costs nothing: the ratio can't reach the limit if one string is much longer than the other."""
    v, d = F.length(vendor), F.length(description)
    return F.coalesce((v > 0) & (2 * F.least(v, d) >= VENDOR_SIMILARITY * (v + d)), F.lit(False))


def vendor_similar(vendor: Column, description: Column) -> Column:
    return ratio(F.lower(vendor), F.lower(description)) >= VENDOR_SIMILARITY


def vendor_names(vendor: Column, description: Column) -> Column:
    """The vendor test. The ratio is asked only where the plain tests leave it open: elsewhere it gets nulls."""
    inside = vendor_contained(vendor, description)
    open_ = ~inside & ratio_possible(vendor, description)
    return inside | F.coalesce(vendor_similar(F.when(open_, vendor), F.when(open_, description)), F.lit(False))
