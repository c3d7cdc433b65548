"""Risk measures and portfolios."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import normal_pdf, normal_quantile
from ..plans.frame import ordered, with_seq
from .linalg import covariance_matrix


def value_at_risk(df: DataFrame, r: str, by: Sequence[str] = (), confidence: float = 0.95, method: str = "historical") -> DataFrame:
    """(by, n, var, cvar), losses positive. Historical: the sorted return at floor((1-c) n), from 0, and the mean up to it;
    parametric: normal; cornish_fisher: adjusted quantile, with the historical mean of the tail."""
    x = df.filter(F.col(r).isNotNull())
    alpha = 1 - confidence
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = x.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__k", F.row_number().over(w.orderBy(r)) - 1)
    at = F.floor(F.lit(alpha) * F.col("__n"))
    hist = ranked.filter(F.col("__k") <= at).groupBy(*by).agg(F.max("__n").alias("n"), (-F.max(r)).alias("var"), (-F.avg(r)).alias("cvar"))
    if method == "historical":
        return hist
    z = normal_quantile(alpha)
    s = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("sk"), F.kurtosis(r).alias("ku"))
    if method == "parametric":
        return s.select(*by, "n", (-(F.col("m") + z * F.col("sd"))).alias("var"), (-(F.col("m") - F.col("sd") * (normal_pdf(z) / alpha))).alias("cvar"))
    q = F.lit(z) + (z * z - 1) / 6 * F.col("sk") + (z**3 - 3 * z) / 24 * F.col("ku") - (2 * z**3 - 5 * z) / 36 * F.col("sk") ** 2
    cf = s.select(*by, "n", (-(F.col("m") + q * F.col("sd"))).alias("var"))
    tail = x.join(cf, list(by)) if by else x.join(F.broadcast(cf))  # one row
    mean = tail.filter(F.col(r) <= -F.col("var")).groupBy(*by).agg((-F.avg(r)).alias("cvar"))
    return (cf.join(mean, list(by), "left") if by else cf.join(F.broadcast(mean), how="left")).select(*by, "n", "var", F.coalesce("cvar", "var").alias("cvar"))


def drawdown_analysis(df: DataFrame, r: str, by: Sequence[str], order: Sequence[str], compounding: bool = False) -> DataFrame:
    """Additive cumulative returns by default; drawdowns from the running maximum, which starts at the first value. Gives the
    largest and the mean drawdown, peak, trough (the first, of drawdowns alike to 12 digits), recovery (n if there is none)
    and duration, by position."""
    w = ordered(by, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = with_seq(df.filter(F.col(r).isNotNull()), by, order)
    level = F.exp(F.sum(F.log(1 + F.col(r))).over(upto)) if compounding else F.sum(r).over(upto)
    s = s.withColumn("__c", level).withColumn("__m", F.max("__c").over(upto))
    dd = (F.col("__m") - F.col("__c")) / F.col("__m") if compounding else F.col("__m") - F.col("__c")
    s = s.withColumn("__d", dd).withColumn("__pk", F.max(F.when(F.col("__c") == F.col("__m"), F.col("seq"))).over(upto))
    top = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("__d").alias("max_drawdown"), F.avg("__d").alias("avg_drawdown"), F.max(F.struct(F.round("__d", 12).alias("__d"), (-F.col("seq")).alias("s"), F.col("__pk").alias("p"), F.col("__m").alias("m"))).alias("t"))
    top = top.select(*by, "n", "max_drawdown", "avg_drawdown", (-F.col("t.s")).alias("trough"), F.col("t.p").alias("peak"), F.col("t.m").alias("__pm"))
    j = s.select(*by, "seq", "__c").join(top.select(*by, "trough", "__pm"), list(by)) if by else s.select("seq", "__c").join(F.broadcast(top.select("trough", "__pm")))  # one row
    back = j.filter((F.col("seq") > F.col("trough")) & (F.col("__c") >= F.col("__pm"))).groupBy(*by).agg(F.min("seq").alias("__rec"))
    res = top.join(back, list(by), "left") if by else top.join(F.broadcast(back), how="left")
    return res.select(*by, "n", "max_drawdown", "avg_drawdown", "peak", "trough", F.coalesce("__rec", "n").alias("recovery"), (F.col("trough") - F.col("peak")).alias("duration"))


def performance_metrics(df: DataFrame, r: str, by: Sequence[str], order: Sequence[str], risk_free: float = 0.0, periods: int = 252) -> DataFrame:
    """Annual return and volatility, Sharpe, Sortino, Omega, Calmar, of series of at least 10 returns."""
    ex = F.col(r) - risk_free / periods
    a = df.filter(F.col(r).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("__m"), F.avg(ex).alias("__x"), F.stddev_samp(ex).alias("__s"), F.sqrt(F.sum(F.when(ex < 0, ex * ex).otherwise(0.0)) / F.count(F.lit(1))).alias("__d"),
        F.sum(F.when(ex > 0, ex).otherwise(0.0)).alias("__g"), F.sum(F.when(ex < 0, -ex).otherwise(0.0)).alias("__l")).filter("n >= 10")
    d = drawdown_analysis(df, r, by, order).select(*by, "max_drawdown")
    a = a.join(d, list(by)) if by else a.join(F.broadcast(d))  # one row
    root = math.sqrt(periods)
    down = F.when(F.col("__d") > 0, F.col("__d")).otherwise(F.col("__s"))
    return a.select(*by, "n", (F.col("__m") * periods).alias("annual_return"), (F.col("__s") * root).alias("annual_volatility"), (F.try_divide("__x", "__s") * root).alias("sharpe"),
                    (F.try_divide(F.col("__x"), down) * root).alias("sortino"), F.when(F.col("__l") > 0, F.try_divide("__g", "__l")).otherwise(F.lit(1e10)).alias("omega"),
                    F.try_divide(F.col("__m") * periods, F.col("max_drawdown")).alias("calmar"), "max_drawdown")


def _weights(raw: np.ndarray, long_only: bool) -> np.ndarray:
    w = raw / raw.sum()
    if long_only:
        w = np.maximum(w, 0)
        w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
    return w


def _frame(df: DataFrame, assets: Sequence[str], w: np.ndarray, mean: np.ndarray, cov: np.ndarray, rf: float) -> DataFrame:
    ret, vol = float(w @ mean), float(math.sqrt(w @ cov @ w))
    return df.sparkSession.createDataFrame([(a, float(x), ret, vol, (ret - rf) / vol if vol else 0.0) for a, x in zip(assets, w)], "asset string, weight double, ret double, volatility double, sharpe double")


def minimum_variance_portfolio(df: DataFrame, assets: Sequence[str], long_only: bool = True) -> DataFrame:
    """Inverse covariance times 1, normalised; long only: negatives are clipped, then it's normalised again."""
    mean, cov, _ = covariance_matrix(df, assets)
    return _frame(df, assets, _weights(np.linalg.solve(cov, np.ones(len(assets))), long_only), mean, cov, 0.0)


def max_sharpe_portfolio(df: DataFrame, assets: Sequence[str], risk_free: float = 0.0, long_only: bool = True) -> DataFrame:
    mean, cov, _ = covariance_matrix(df, assets)
    return _frame(df, assets, _weights(np.linalg.solve(cov, mean - risk_free), long_only), mean, cov, risk_free)


def efficient_frontier(df: DataFrame, assets: Sequence[str], n_points: int = 50, long_only: bool = False) -> DataFrame:
    """Two-fund closed form over a grid of target means from the least to the greatest asset mean."""
    if n_points < 2:
        raise ValueError("a frontier has at least two points")
    mean, cov, _ = covariance_matrix(df, assets)
    inv, one = np.linalg.inv(cov), np.ones(len(assets))
    a, b, c = one @ inv @ one, one @ inv @ mean, mean @ inv @ mean
    d = a * c - b * b
    if abs(d) < 1e-300:
        raise ValueError("the assets have equal means")
    rows = []
    for i, goal in enumerate(np.linspace(mean.min(), mean.max(), n_points)):
        w = inv @ (one * (c - b * goal) + mean * (a * goal - b)) / d
        w = _weights(w, long_only)
        rows.append((i, float(goal), float(w @ mean), float(math.sqrt(w @ cov @ w)), [float(x) for x in w]))
    return df.sparkSession.createDataFrame(rows, "point int, target double, ret double, volatility double, weights array<double>")
