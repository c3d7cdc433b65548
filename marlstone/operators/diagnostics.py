"""Descriptive statistics and specification tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import chi2_sf, newey_west_auto_lag
from ..plans.frame import ordered, with_seq
from ..plans.gram import gram, solve_rows, unpack
from .regression import solve_gram


def descriptive_stats(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, sample variance and deviation, population skewness and excess kurtosis, range and linear quartiles."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("skewness"),
        F.kurtosis(x).alias("kurtosis"), F.min(x).alias("min"), F.max(x).alias("max"), q.alias("__q"),
    ).select(*by, "n", "mean", "variance", "std", "skewness", "kurtosis", "min", "max", *[F.get("__q", F.lit(i)).alias(a) for i, a in enumerate(("q25", "median", "q75"))])


def jarque_bera(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """n / 6 (S^2 + K^2 / 4); the tail of chi2(2) is exp(-JB / 2). A constant series gives 0 and 1."""
    s = df.groupBy(*by).agg(F.count(x).alias("n"), F.skewness(x).alias("s"), F.kurtosis(x).alias("k"), F.var_samp(x).alias("v")).filter("n >= 8")
    jb = F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.col("n") / 6 * (F.col("s") ** 2 + F.col("k") ** 2 / 4))
    return s.select(*by, "n", jb.alias("statistic")).withColumn("p", F.exp(-F.col("statistic") / 2))


def durbin_watson(df: DataFrame, e: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    d = df.withColumn("__d", F.col(e) - F.lag(e).over(ordered(by, order)))
    s = d.groupBy(*by).agg(F.count(e).alias("n"), F.sum(F.col("__d") ** 2).alias("a"), F.sum(F.col(e) ** 2).alias("b")).filter("n >= 3")
    return s.select(*by, "n", F.when(F.col("b") == 0, F.lit(2.0)).otherwise(F.try_divide("a", "b")).alias("statistic"))


def autocorrelation(df: DataFrame, x: str, max_lag: int, by: Sequence[str], order: Sequence[str], lag0: bool = False) -> DataFrame:
    """(by, lag, acf): lags 1..max_lag (and 0 if asked for); zeros for a constant series."""
    d = df.withColumn("__d", F.col(x) - F.avg(x).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))
    w = ordered(by, order)
    ks = range(0 if lag0 else 1, max_lag + 1)
    d = d.withColumns({f"__l{k}": F.lag("__d", k).over(w) if k else F.col("__d") for k in ks})
    s = d.groupBy(*by).agg(F.count(x).alias("n"), F.sum(F.col("__d") ** 2).alias("__v"), *[F.sum(F.col("__d") * F.col(f"__l{k}")).alias(f"__c{k}") for k in ks])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.coalesce(F.try_divide(F.col(f"__c{k}"), F.nullif("__v", F.lit(0.0))), F.lit(0.0)).alias("acf")) for k in ks]))
    return s.select(*by, "n", pairs.alias("p")).select(*by, "n", "p.lag", "p.acf")


def ljung_box(df: DataFrame, x: str, m: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """n (n + 2) sum(acf^2 / (n - k)) over m lags, against chi2(m)."""
    a = autocorrelation(df, x, m, by, order).groupBy(*by).agg(F.max("n").alias("n"), (F.max("n") * (F.max("n") + 2) * F.sum(F.col("acf") ** 2 / (F.col("n") - F.col("lag")))).alias("statistic"))
    return solve_rows(a, [*by, "n", "statistic"], lambda r: [{"p": chi2_sf(r["statistic"], m)}], "p double")


def _aux(g: np.ndarray, n: int, y_at: int, x_at: list[int]) -> dict:
    at = [0, *x_at, y_at]
    return solve_gram(g[np.ix_(at, at)], n, True)


def breusch_pagan(df: DataFrame, e: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Half the explained sum of squares of e^2 / mean(e^2) on the regressors and a constant; chi2 with their number."""
    g = gram(df.withColumn("__e2", F.col(e) ** 2), [*xs, "__e2"], by)

    def solve(r):
        n, m = int(r["n"]), unpack(r["__gram"], len(xs) + 1)
        f = _aux(m, n, len(xs) + 1, list(range(1, len(xs) + 1)))
        s2 = m[0, -1] / m[0, 0]
        if f["status"] != "ok" or s2 == 0:
            return [{"statistic": None, "df": len(xs), "p": None}]
        lm = (f["tss"] - f["ssr"]) / (2 * s2 * s2)
        return [{"statistic": lm, "df": len(xs), "p": chi2_sf(lm, len(xs))}]

    return solve_rows(g, by, solve, "statistic double, df long, p double")


def white_test(df: DataFrame, e: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n R^2 of e^2 on the regressors, their squares and products; degrees of freedom are the rank of these less a constant."""
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    rows = df.withColumns({f"__p{i}": F.col(a) * F.col(b) for i, (a, b) in enumerate(pairs)}).withColumn("__e2", F.col(e) ** 2)
    cols = [*xs, *[f"__p{i}" for i in range(len(pairs))]]
    g = gram(rows, [*cols, "__e2"], by)

    def solve(r):
        n, m = int(r["n"]), unpack(r["__gram"], len(cols) + 1)
        mean = m[0, 1:] / n
        s = m[1:, 1:] - n * np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(s), 0))
        use = [i for i in range(len(cols)) if sd[i] > 1e-12]
        c = s[np.ix_(use, use)] / np.outer(sd[use], sd[use])
        rank = int(np.linalg.matrix_rank(c, tol=1e-9))
        y = s[use, -1] / sd[use]
        r2 = float(y @ np.linalg.pinv(c, rcond=1e-10) @ y / s[-1, -1]) if s[-1, -1] > 0 else 0.0
        return [{"statistic": n * r2, "df": rank, "p": chi2_sf(n * r2, rank)}]

    return solve_rows(g, by, solve, "statistic double, df long, p double")


def arch_lm(df: DataFrame, e: str, q: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """T R^2 of e^2 on its q lags, T = n - q, against chi2(q)."""
    w = ordered(by, order)
    rows = df.withColumn("__e2", F.col(e) ** 2)
    rows = rows.withColumns({f"__l{k}": F.lag("__e2", k).over(w) for k in range(1, q + 1)})
    cols = [f"__l{k}" for k in range(1, q + 1)]

    def solve(r):
        n, m = int(r["n"]), unpack(r["__gram"], q + 1)
        f = _aux(m, n, q + 1, list(range(1, q + 1)))
        if f["status"] != "ok" or not f["tss"] > 0:
            return [{"t": n, "statistic": None, "p": None}]
        lm = n * (1 - f["ssr"] / f["tss"])
        return [{"t": n, "statistic": lm, "p": chi2_sf(lm, q)}]

    return solve_rows(gram(rows, [*cols, "__e2"], by), by, solve, "t long, statistic double, p double")


#: Critical values at 1, 5 and 10 % (asymptotic), by deterministic terms.
ADF_CRITICAL = {"none": (-2.58, -1.95, -1.62), "constant": (-3.43, -2.86, -2.57), "trend": (-3.96, -3.41, -3.12)}
KPSS_CRITICAL = {"level": (0.739, 0.463, 0.347), "trend": (0.216, 0.146, 0.119)}


def adf_test(df: DataFrame, y: str, by: Sequence[str], order: Sequence[str], max_lag: int | None = None, kind: str = "constant") -> DataFrame:
    """t statistic of y_{t-1} in the regression of the difference on it, deterministic terms and lagged differences;
    by default floor((n-1)^(1/3)) lags, of the longest series. p_bucket: 0.01, 0.05, 0.10 by critical value, else 0.5."""
    w = ordered(by, order)
    rows = with_seq(df, by, order).withColumn("__d", F.col(y) - F.lag(y).over(w)).withColumn("__y1", F.lag(y).over(w))
    if max_lag is None:
        n = with_seq(df, by, order).agg(F.max("seq").alias("m")).first()["m"] or 1
        max_lag = newey_west_auto_lag(int(n))
    rows = rows.withColumns({f"__l{k}": F.lag("__d", k).over(w) for k in range(1, max_lag + 1)})
    xs = ["__y1", *(["seq"] if kind == "trend" else []), *[f"__l{k}" for k in range(1, max_lag + 1)]]
    crit = ADF_CRITICAL[kind]

    def solve(r):
        n, m = int(r["n"]), unpack(r["__gram"], len(xs) + 1)
        f = solve_gram(m, n, kind != "none")
        if f["status"] != "ok" or n < 10:
            return [{"lags": max_lag, "statistic": None, "p_bucket": None, "stationary": None}]
        i = int(kind != "none")
        t = f["beta"][i] / math.sqrt(f["inv"][i, i] * f["ssr"] / (n - f["k"]))
        p = next((q for q, c in zip((0.01, 0.05, 0.10), crit) if t < c), 0.5)
        return [{"lags": max_lag, "statistic": float(t), "p_bucket": p, "stationary": bool(t < crit[1])}]

    return solve_rows(gram(rows, [*xs, "__d"], by), by, solve, "lags long, statistic double, p_bucket double, stationary boolean")


def kpss_test(df: DataFrame, y: str, by: Sequence[str], order: Sequence[str], trend: bool = False, n_lags: int | None = None) -> DataFrame:
    """Sum of squared partial sums of the detrended series over n^2 and its Bartlett long-run variance."""
    s = with_seq(df, by, order)
    wk = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    if trend:
        slope = F.regr_slope(y, "seq").over(wk)
        s = s.withColumn("__e", F.col(y) - F.regr_intercept(y, "seq").over(wk) - slope * F.col("seq"))
    else:
        s = s.withColumn("__e", F.col(y) - F.avg(y).over(wk))
    w = ordered(by, order)
    if n_lags is None:
        n = s.agg(F.max("seq").alias("m")).first()["m"] or 0
        n_lags = math.ceil(0.75 * math.sqrt(n + 1))
    s = s.withColumn("__s", F.sum("__e").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumns({f"__l{k}": F.lag("__e", k).over(w) for k in range(1, n_lags + 1)})
    lrv = F.sum(F.col("__e") ** 2) + sum((2 * (1 - k / (n_lags + 1)) * F.coalesce(F.sum(F.col("__e") * F.col(f"__l{k}")), F.lit(0.0)) for k in range(1, n_lags + 1)), F.lit(0.0))
    a = s.groupBy(*by).agg(F.count(y).alias("n"), F.sum(F.col("__s") ** 2).alias("__ss"), lrv.alias("__lrv")).filter("n >= 20")
    stat = F.try_divide(F.col("__ss") / F.col("n"), F.col("__lrv"))
    crit = KPSS_CRITICAL["trend" if trend else "level"]
    p = F.when(stat > crit[0], 0.01).when(stat > crit[1], 0.05).when(stat > crit[2], 0.10).otherwise(0.5)
    return a.select(*by, "n", stat.alias("statistic"), p.alias("p_bucket"))


