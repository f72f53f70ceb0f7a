"""Jaro-Winkler, the one comparator Spark has no expression for, as an Arrow-batched column."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ship the measure itself with each task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values of the measure: share added per common leading character, longest prefix counted,
# and the Jaro value above which the prefix counts at all
PREFIX_WEIGHT = 0.1
PREFIX_LENGTH = 4
BOOST_ABOVE = 0.7

_CELLS = 2_000_000


def _codes(words: np.ndarray, width: int) -> np.ndarray:
    return words.astype(f"U{max(width, 1)}").view(np.uint32).reshape(len(words), max(width, 1))


def _measure(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    ca, cb = _codes(a, int(la.max())), _codes(b, int(lb.max()))
    n, wa = ca.shape
    wb = cb.shape[1]
    at_b = np.arange(wb)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used_a = np.zeros((n, wa), dtype=bool)
    used_b = np.zeros((n, wb), dtype=bool)
    in_b = at_b[None, :] < lb[:, None]
    widest = int(reach.max())
    for i in range(wa):
        lo, hi = max(0, i - widest), min(wb, i + widest + 1)
        if lo >= hi:
            break
        near = np.abs(at_b[lo:hi][None, :] - i) <= reach[:, None]
        hit = (cb[:, lo:hi] == ca[:, i : i + 1]) & near & in_b[:, lo:hi] & ~used_b[:, lo:hi]
        hit &= (i < la)[:, None]
        found = hit.any(axis=1)
        rows = np.nonzero(found)[0]
        used_b[rows, lo + hit[rows].argmax(axis=1)] = True
        used_a[:, i] = found
    m = used_a.sum(axis=1)
    out = np.zeros(n)
    some = np.flatnonzero(m)
    if len(some):
        out[some] = scored_matches(ca[some], cb[some], la[some], lb[some], used_a[some], used_b[some])
    return out


def scored_matches(ca: np.ndarray, cb: np.ndarray, la: np.ndarray, lb: np.ndarray, used_a: np.ndarray, used_b: np.ndarray) -> np.ndarray:
    """Jaro-Winkler of texts (as letter codes) whose matching letters are marked; each pair has some."""
    m = used_a.sum(axis=1)
    k = int(m.max())
    first_a = np.argsort(~used_a, axis=1, kind="stable")[:, :k]
    first_b = np.argsort(~used_b, axis=1, kind="stable")[:, :k]
    differ = np.take_along_axis(ca, first_a, 1) != np.take_along_axis(cb, first_b, 1)
    swaps = (differ & (np.arange(k)[None, :] < m[:, None])).sum(axis=1) // 2
    mm = m.astype(float)
    jaro = (mm / la + mm / lb + (mm - swaps) / mm) / 3.0
    p = min(PREFIX_LENGTH, ca.shape[1], cb.shape[1])
    same = (ca[:, :p] == cb[:, :p]) & (np.arange(p)[None, :] < np.minimum(la, lb)[:, None])
    lead = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(jaro > BOOST_ABOVE, jaro + PREFIX_WEIGHT * lead * (1.0 - jaro), jaro)


def jaro_winkler_pairs(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Similarity per row; each distinct pair of a batch is measured once; null gives NaN."""
    out = np.full(len(a), np.nan)
    ok = (a.notna() & b.notna()).to_numpy()
    if not ok.any():
        return out
    ia, ua = pd.factorize(a[ok])
    ib, ub = pd.factorize(b[ok])
    ua, ub = np.asarray(ua, dtype=object), np.asarray(ub, dtype=object)
    pair, back = np.unique(ia.astype(np.int64) * len(ub) + ib, return_inverse=True)
    wa, wb = ua[pair // len(ub)], ub[pair % len(ub)]
    la = np.fromiter((len(w) for w in wa), dtype=np.int64, count=len(wa))
    lb = np.fromiter((len(w) for w in wb), dtype=np.int64, count=len(wb))
    score = np.zeros(len(pair))
    order = np.argsort(np.maximum(la, lb), kind="stable")
    order = order[(la[order] > 0) & (lb[order] > 0)]
    at = 0
    while at < len(order):
        # rows of similar length together, so that padding stays small and memory bounded
        take = max(1, min(len(order) - at, _CELLS // int(max(la[order[at]], lb[order[at]]))))
        while take > 1 and take * int(max(la[order[at + take - 1]], lb[order[at + take - 1]])) > _CELLS:
            take //= 2
        rows = order[at : at + take]
        score[rows] = _measure(wa[rows], wb[rows], la[rows], lb[rows])
        at += take
    out[ok] = score[back]
    return out


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winkler_pairs(a, b))


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity in [0, 1]; null if a side is null, 0 if a side is empty."""
    return F.nanvl(_jaro_winkler(a, b), F.lit(None).cast("double"))


def jaro_needed(threshold: float) -> float:
    """Least Jaro value of a pair whose Jaro-Winkler reaches ``threshold``.

    Up to BOOST_ABOVE both are the same; above it the prefix closes at most four tenths of the gap.
    """
    return max(min(threshold, BOOST_ABOVE), (threshold - 0.4) / 0.6)


def length_allows(a: Column, b: Column, threshold: float) -> Column:
    """False only where the lengths alone keep Jaro-Winkler below ``threshold``.

    With r = shorter/longer length, Jaro is at most (2 + r)/3.
    """
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return ratio >= 3 * jaro_needed(threshold) - 2 - 1e-9


def register(spark: SparkSession) -> None:
    """Make ``jaro_winkler_similarity`` callable from SQL conditions of stored models."""
    spark.udf.register("jaro_winkler_similarity", _jaro_winkler)
