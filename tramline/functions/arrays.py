"""Lines of one value per column of a frame, kept as arrays; -1 stands for no ground."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def valid(line: Column) -> Column:
    return F.filter(line, lambda v: v != -1)


def valid_fraction(line: Column) -> Column:
    """Share of columns with ground; null for an empty line."""
    return F.when(F.size(line) > 0, F.size(valid(line)) / F.size(line))


def plausible_ground(coverage: Column) -> Column:
    return coverage.between(0.02, 0.60)


def normalized(line: Column, height: Column) -> Column:
    """Line in shares of the frame's height, null where there is no ground."""
    return F.transform(line, lambda v: F.when(v != -1, v / height))


def array_median(values: Column) -> Column:
    """Median of an array without nulls, the mean of the two middle values if their number is even; null if empty."""
    s = F.sort_array(values)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


def line_median(line: Column, height: Column) -> Column:
    """Median of the columns with ground, normalized."""
    return array_median(F.transform(valid(line), lambda v: v / height))


def footprint(line: Column, width: Column, column: float = 0.35, half: float = 0.03) -> Column:
    """The part of a line under the character: columns within `half` of `column`, as shares of the width."""
    lo = F.greatest(F.lit(0), F.floor((column - half) * width)).cast("int")
    hi = F.least(width, F.ceil((column + half) * width)).cast("int")
    return F.slice(line, lo + 1, F.greatest(F.lit(1), hi - lo))


def displaced(values: Column, baseline: Column, threshold: float = 0.035) -> tuple[Column, Column]:
    """(share of values that lie more than threshold below the baseline in the frame, largest such displacement)."""
    d = F.transform(values, lambda v: v - baseline)
    n = F.size(values)
    share = F.when(n > 0, F.size(F.filter(d, lambda x: x > threshold)) / n).otherwise(F.lit(0.0))
    return share, F.coalesce(F.greatest(F.array_max(d), F.lit(0.0)), F.lit(0.0))


def column_median(line: Column, window: int = 9) -> Column:
    """Running median along the columns, ends repeated, columns without value left out; lines shorter than the window stay as they are."""
    h = window // 2
    padded = F.concat(F.array_repeat(F.element_at(line, 1), h), line, F.array_repeat(F.element_at(line, -1), h))
    run = F.transform(F.sequence(F.lit(1), F.size(line)), lambda i: array_median(F.filter(F.slice(padded, i, window), lambda v: v.isNotNull())))
    return F.when(F.size(line) >= window, run).otherwise(line.cast("array<double>"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def clean_line(lines: pd.Series, max_step: pd.Series) -> pd.Series:
    """Lines without jumps: values too far from the line's median go, gaps between kept ones are bridged,
    a box of 15 smooths, and only the observed interior stays. Fewer than 8 values: unchanged."""
    def one(line, step):
        if line is None:
            return None
        y = np.asarray(line, float)
        seen = np.flatnonzero(y != -1)
        if len(seen) < 8:
            return [int(v) for v in y]
        kept = seen[np.abs(y[seen] - np.median(y[seen])) <= step]
        if len(kept) < 8:
            return [int(v) for v in y]
        inside = np.arange(kept[0], kept[-1] + 1)
        full = np.interp(inside, kept, y[kept])
        smooth = np.convolve(np.pad(full, 7, mode="edge"), np.ones(15) / 15, mode="valid")
        out = np.full(len(y), -1, int)
        out[inside] = smooth.astype(int)
        return out.tolist()

    return pd.Series([one(a, b) for a, b in zip(lines, max_step)])


def on_ground(line: Column, row: Column, column: Column) -> Column:
    """Whether a pixel (row, column from 0) lies in the ground: at or below the line of its column."""
    y = F.get(line, column)
    return F.coalesce((y != -1) & (row >= y), F.lit(False))


def mask_coverage(mask: Column, low: float = 0.02, high: float = 0.98) -> Column:
    """Share of true cells of a mask; null outside low .. high, where the mask says nothing of a silhouette."""
    n = F.size(mask)
    share = F.when(n > 0, F.size(F.filter(mask, lambda v: v)) / n)
    return F.when((share > low) & (share < high), share)
