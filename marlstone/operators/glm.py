"""Logit and probit by reweighted least squares: a weighted cross-product aggregate a step."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import normal_cdf, normal_pdf, two_sided_p


def binary_model(df: DataFrame, y: str, xs: Sequence[str], link: str = "logit", intercept: bool = True, tol: float = 1e-8, max_iter: int = 100) -> DataFrame:
    """Coefficients with errors from the information matrix, marginal effects at the means, log likelihoods, McFadden's R2,
    AIC and BIC. Regressors are centred and scaled for the steps and the results put back; the data are cached, and each
    step is one aggregate of k^2 sums."""
    terms = (["const"] if intercept else []) + list(xs)
    rows = df.select(F.col(y).cast("double").alias("__y"), *[F.col(x).cast("double").alias(f"__x{i}") for i, x in enumerate(xs)]).dropna()
    stat = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("s"), F.sum(F.when(~F.col("__y").isin(0.0, 1.0), 1).otherwise(0)).alias("bad"),
                    *[f(f"__x{i}").alias(f"{a}{i}") for i in range(len(xs)) for f, a in ((F.avg, "m"), (F.stddev_pop, "d"))]).first()
    if not stat["n"] or stat["bad"]:
        raise ValueError("the outcome must be 0 or 1, of some rows")
    n, ybar = stat["n"], stat["s"] / stat["n"]
    mean = np.array([stat[f"m{i}"] for i in range(len(xs))])
    sd = np.array([stat[f"d{i}"] or 1.0 for i in range(len(xs))])
    if not intercept:
        mean = np.zeros(len(xs))
    z = rows.select("__y", *[((F.col(f"__x{i}") - float(mean[i])) / float(sd[i])).alias(f"__x{i}") for i in range(len(xs))]).cache()
    x = [F.lit(1.0)] * intercept + [F.col(f"__x{i}") for i in range(len(xs))]
    k = len(x)
    b = np.zeros(k)
    converged, it, h, ll = False, 0, None, -math.inf
    for it in range(1, max_iter + 1):
        eta = sum(F.lit(float(b[i])) * x[i] for i in range(k))
        p, dens = _link(eta, link)
        p = F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))
        g = (F.col("__y") - p) * dens / (p * (1 - p))
        w = dens * dens / (p * (1 - p))
        one = z.agg(F.sum(F.col("__y") * F.log(p) + (1 - F.col("__y")) * F.log(1 - p)).alias("ll"), *[F.sum(g * c).alias(f"g{i}") for i, c in enumerate(x)], *[F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        ll = one["ll"]
        h = np.array([[one[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        step = np.linalg.solve(h, np.array([one[f"g{i}"] for i in range(k)]))
        if np.abs(step).max() < tol:
            converged = True
            break
        b = b + step
    z.unpersist()
    v = np.linalg.inv(h)
    a = np.zeros((k, k))  # back to the given units
    for i in range(len(xs)):
        a[i + intercept, i + intercept] = 1 / sd[i]
        if intercept:
            a[0, i + 1] = -mean[i] / sd[i]
    if intercept:
        a[0, 0] = 1.0
    beta, v = a @ b, a @ v @ a.T
    null = n * (ybar * math.log(ybar) + (1 - ybar) * math.log(1 - ybar)) if 0 < ybar < 1 else 0.0
    at = float(beta @ np.concatenate(([1.0] * intercept, [stat[f"m{i}"] for i in range(len(xs))])))
    dens = normal_pdf(at) if link == "probit" else (lambda q: q * (1 - q))(1 / (1 + math.exp(-at)))
    out = []
    for i, t in enumerate(terms):
        se = math.sqrt(v[i, i])
        out.append((t, float(beta[i]), se, float(beta[i] / se), two_sided_p(beta[i] / se), float(beta[i] * dens), n, ll, null, 1 - ll / null if null else math.nan, -2 * ll + 2 * k, -2 * ll + k * math.log(n), it, converged))
    return df.sparkSession.createDataFrame(out, "term string, beta double, se double, z double, p double, marginal_effect double, n long, ll double, ll_null double, pseudo_r2 double, aic double, bic double, iterations int, converged boolean")


def _link(eta, link):
    if link == "logit":
        e = F.greatest(F.least(eta, F.lit(500.0)), F.lit(-500.0))
        p = 1 / (1 + F.exp(-e))
        return p, p * (1 - p)
    @F.pandas_udf("double")
    def cdf(v: pd.Series) -> pd.Series:  # there is no erf in Spark SQL
        return v.map(normal_cdf)

    return cdf(eta), F.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)


def logit(df: DataFrame, y: str, xs: Sequence[str], **options) -> DataFrame:
    return binary_model(df, y, xs, "logit", **options)


def probit(df: DataFrame, y: str, xs: Sequence[str], **options) -> DataFrame:
    return binary_model(df, y, xs, "probit", **options)
