"""Returns, differencing and rolling statistics: windows over ordered series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.frame import each_series, nonzero, ordered, with_seq


def compute_returns(df: DataFrame, value: str, key: Sequence[str], order: Sequence[str], kind: str = "log", out: str = "r", keep_first: bool = False) -> DataFrame:
    """Log or simple returns; rows after a zero, negative-ratio or missing price have a null return. The first row of a
    series goes unless asked for."""
    w = ordered(key, order)
    p, before = nonzero(value), nonzero(F.lag(value).over(w))
    r = F.log(F.try_divide(p, before)) if kind == "log" else F.try_divide(F.col(value) - before, before)
    res = with_seq(df, key, order).withColumn(out, r)
    return res if keep_first else res.filter("seq > 0")


def log_returns(df: DataFrame, value: str, key: Sequence[str], order: Sequence[str], out: str = "r") -> DataFrame:
    return compute_returns(df, value, key, order, "log", out)


def simple_returns(df: DataFrame, value: str, key: Sequence[str], order: Sequence[str], out: str = "r") -> DataFrame:
    return compute_returns(df, value, key, order, "simple", out)


def difference(df: DataFrame, value: str, d: int, key: Sequence[str], order: Sequence[str], out: str = "dy") -> DataFrame:
    """d-th difference; the first d rows of a series go."""
    from math import comb

    w = ordered(key, order)
    x = sum((-1) ** k * comb(d, k) * F.lag(value, k).over(w) for k in range(1, d + 1)) + F.col(value) if d else F.col(value)
    return with_seq(df, key, order).withColumn(out, x).filter(F.col("seq") >= d)


def undifference(df: DataFrame, value: str, last: Sequence[float], key: Sequence[str], order: Sequence[str], out: str = "y") -> DataFrame:
    """Integrates d = len(last) times: last[i] is the last level of the i-th difference of the original series."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    res = df.withColumn(out, F.col(value).cast("double"))
    for level in reversed(last):
        res = res.withColumn(out, F.lit(float(level)) + F.sum(out).over(w))
    return res


ROLLING = {"mean": F.avg, "sum": F.sum, "variance": F.var_samp, "min": F.min, "max": F.max}


def rolling(df: DataFrame, value: str, window: int, stats: Sequence[str], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rolling_<stat> over the last ``window`` rows, of full windows only."""
    w = ordered(key, order).rowsBetween(-(window - 1), 0)
    return with_seq(df, key, order).withColumns({f"rolling_{s}": ROLLING[s](value).over(w) for s in stats}).filter(F.col("seq") >= window - 1)


def rolling_apply(df: DataFrame, value: str, window: int, fn: Callable[[pd.Series], float], key: Sequence[str], order: Sequence[str], out: str = "value_applied") -> DataFrame:
    """A user function of each full window. Rows of a series come to a task once, in order, and windows are views of them."""
    return _applied(df, value, lambda x: np.lib.stride_tricks.sliding_window_view(x, window) if len(x) >= window else [], window, fn, key, order, out)


def expanding_apply(df: DataFrame, value: str, min_obs: int, fn: Callable[[pd.Series], float], key: Sequence[str], order: Sequence[str], out: str = "value_applied") -> DataFrame:
    """A user function of each series up to each row, from min_obs rows on."""
    return _applied(df, value, lambda x: (x[:k] for k in range(min_obs, len(x) + 1)), min_obs, fn, key, order, out)


def _applied(df, value, windows, first, fn, key, order, out):
    names = df.columns
    schema = df.withColumn("seq", F.lit(0).cast("long")).withColumn(out, F.lit(0.0)).schema

    def run(series: list[pd.DataFrame]) -> pd.DataFrame:
        parts = []
        for s in series:
            got = [float(fn(pd.Series(w))) for w in windows(s[value].to_numpy(float))]
            parts.append(s.iloc[first - 1 :].assign(seq=np.arange(first - 1, max(first - 1, len(s)), dtype=np.int64), **{out: got}))
        return pd.concat(parts, ignore_index=True)[[c.name for c in schema]]

    return each_series(df, key, order, names, run, schema)


def expanding(df: DataFrame, value: str, min_obs: int, stats: Sequence[str], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return with_seq(df, key, order).withColumns({f"expanding_{s}": ROLLING[s](value).over(w) for s in stats}).filter(F.col("seq") >= min_obs - 1)
