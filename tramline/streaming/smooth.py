"""Recursive smoothing whose rate depends on its own last value; one fold a key."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructType


def _fold(df: DataFrame, keys: Sequence[str], t: str, out: str, body) -> DataFrame:
    schema = StructType([*[f for f in df.schema.fields if f.name != out]]).add(out, DoubleType())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t, kind="stable")
        return pdf.assign(**{out: body(pdf)})[schema.names]

    return df.groupBy(*keys).applyInPandas(run, schema)


def asymmetric_ema(df: DataFrame, keys: Sequence[str], t: str, v: str, rise: float = 0.25, fall: float = 0.35, valid: str | None = None, reset: str | None = None, out: str = "smooth") -> DataFrame:
    """v (0 at least) smoothed with one time constant for rises and one for falls, from 0. Rows that are not valid,
    or that reset (a confirmed stop), give 0 and start anew; a time step or constant of 0 takes v at once."""
    def body(pdf: pd.DataFrame) -> list[float]:
        values, now, last = [], 0.0, None
        ok = pdf[valid].fillna(False) if valid else [True] * len(pdf)
        stop = pdf[reset].fillna(False) if reset else [False] * len(pdf)
        for at, x, good, halt in zip(pdf[t], pdf[v], ok, stop):
            dt, last = 0.0 if last is None else at - last, at
            if not good or halt or pd.isna(x):
                now = 0.0
            else:
                x = max(0.0, x)
                tau = rise if x > now else fall
                now = x if tau <= 1e-4 or dt <= 0 else now + (x - now) * (1 - math.exp(-dt / tau))
            values.append(now)
        return values

    return _fold(df, keys, t, out, body)


def condition_rate(df: DataFrame, keys: Sequence[str], t: str, v: str, entry: float = 0.15, stop: float = 0.05, lowest: float = 0.35, highest: float = 1.6, rise: float = 0.35, fall: float = 0.5, snap: float = 0.05, out: str = "rate") -> DataFrame:
    """A playback rate: on from `entry`, off at `stop`, held to a band while on, eased, and 0 once it has nearly stopped."""
    if entry <= stop:
        raise ValueError("entry must exceed stop")

    def body(pdf: pd.DataFrame) -> list[float]:
        values, now, on, last = [], 0.0, False, None
        for at, x in zip(pdf[t], pdf[v]):
            dt, last = 0.0 if last is None else at - last, at
            on = x > stop if on else x >= entry
            goal = min(max(x, lowest), highest) if on else 0.0
            tau = fall if goal < now else rise
            now = goal if tau <= 0 or dt <= 0 else now + (goal - now) * (1 - math.exp(-dt / tau))
            if goal <= 0 and now <= snap:
                now = 0.0
            values.append(now)
        return values

    return _fold(df, keys, t, out, body)
