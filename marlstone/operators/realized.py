"""Realised measures and event studies."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.frame import ordered
from .returns import compute_returns


def realized_measures(df: DataFrame, r: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per series: n_obs, realised variance and volatility, bipower variation, jump, both semivariances.

    A null return breaks the pair of its neighbours; a series of fewer than two returns has no bipower variation.
    """
    w = ordered(key, order)
    x, n = F.col(r), F.count(F.col(r))
    pair = F.abs(x) * F.abs(F.lag(r).over(w))
    rows = df.withColumn("__pair", pair)
    bv = F.lit(pi / 2) * F.try_divide(n, n - 1) * F.sum("__pair")
    rv = F.sum(x * x)
    half = lambda c: F.sum(F.when(x.isNotNull(), F.when(c, x * x).otherwise(0.0)))
    return rows.groupBy(*key).agg(
        n.alias("n_obs"), rv.alias("rv"), F.sqrt(rv).alias("rvol"), bv.alias("bv"), F.greatest(rv - bv, F.lit(0.0)).alias("jump"),
        half(x > 0).alias("rsv_pos"), half(x < 0).alias("rsv_neg"),
    )


def measures_of_prices(df: DataFrame, value: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return realized_measures(compute_returns(df, value, key, order), "r", key, order)


def event_windows(returns: DataFrame, events: DataFrame, r: str, key: Sequence[str], before: int = 60, after: int = 60, pad: str | None = "zero") -> DataFrame:
    """(key, event_id, offset, ret) around each event (key, event_id, seq); positions outside the series are 0, or null
    with pad='null'. An equi-join on (key, seq), so it scales with events * window."""
    if before < 0 or after < 0:
        raise ValueError("window ends must not be negative")
    at = events.select(*key, "event_id", F.col("seq").alias("__at"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"))
    at = at.withColumn("seq", F.col("__at") + F.col("offset"))
    res = at.join(returns.select(*key, "seq", F.col(r).alias("ret")), [*key, "seq"], "left")
    ret = F.coalesce("ret", F.lit(0.0)) if pad == "zero" else F.col("ret")
    return res.select(*key, "event_id", F.col("offset").cast("long").alias("offset"), ret.alias("ret"))


def cumulative_abnormal(windows: DataFrame, key: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*key, "event_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    return windows.withColumn("car", F.sum("ret").over(w))


def event_study(returns: DataFrame, events: DataFrame, r: str, key: Sequence[str], before: int = 60, after: int = 60, pad: str = "zero", by: Sequence[str] = ()) -> DataFrame:
    """Per offset (and group of events): n events, mean abnormal return, mean CAR, and the spread of returns over events."""
    win = cumulative_abnormal(event_windows(returns, events, r, key, before, after, pad), key)
    return win.groupBy(*by, "offset").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("ret").alias("mean_ar"), F.avg("car").alias("mean_car"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("volatility"))
