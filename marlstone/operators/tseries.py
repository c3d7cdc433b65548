"""Time-series models: lags by windows, coefficients from cross products, k x k recursions on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import f_sf, normal_quantile, two_sided_p
from ..plans.frame import lags, leads, ordered, with_seq
from ..plans.gram import gram, solve_rows, unpack
from .regression import ols, solve_gram

BLOCK, SLICE = 128, 65536  # rows that a recursion takes by one product, rows of a long regression's slice


def ar(df: DataFrame, y: str, p: int, by: Sequence[str], order: Sequence[str], intercept: bool = True, cov: str = "newey_west") -> DataFrame:
    """Autoregression on p lags, a row a coefficient, with AIC and BIC from the variance per degree of freedom."""
    rows = lags(df, [y], p, by, order)
    fit = ols(rows, y, [f"{y}_lag{k}" for k in range(1, p + 1)], by, cov=cov, intercept=intercept, order=order)
    base = F.col("n") * (math.log(2 * math.pi) + 2 * F.log("sigma") + 1)
    return fit.withColumn("aic", base + 2 * F.col("k")).withColumn("bic", base + F.log("n") * F.col("k"))


def har_rv(df: DataFrame, rv: str, by: Sequence[str], order: Sequence[str], horizons: Sequence[int] = (1, 5, 22), cov: str = "newey_west") -> DataFrame:
    """Realised variance on the means of its last 1, 5 and 22 values."""
    return ols(har_features(df, rv, by, order, horizons), rv, [f"rv_{h}" for h in horizons], by, cov=cov, order=order)


def har_features(df: DataFrame, rv: str, by: Sequence[str], order: Sequence[str], horizons: Sequence[int] = (1, 5, 22)) -> DataFrame:
    w = ordered(by, order)
    s = with_seq(df, by, order)
    return s.withColumns({f"rv_{h}": F.avg(rv).over(w.rowsBetween(-h, -1)) for h in horizons}).filter(F.col("seq") >= max(horizons))


def var(df: DataFrame, ys: Sequence[str], p: int, order: Sequence[str], by: Sequence[str] = ()) -> dict:
    """Vector autoregression of one system from one aggregate (``by``: lags stay within a key, coefficients are common;
    var_systems gives each key its own): coefficients (equation x [1, lag 1 of each, ..]), residual
    covariance U'U / T, log likelihood, AIC, BIC, and a DataFrame of coefficients."""
    if len(ys) < 2:
        raise ValueError("fewer than two variables")
    rows = lags(df, ys, p, by, order)
    xs = [f"{y}_lag{k}" for k in range(1, p + 1) for y in ys]
    r = gram(rows, [*xs, *ys]).first()
    g, n, k = unpack(r["__gram"], len(xs) + len(ys)), int(r["n"]), len(xs) + 1
    fits = [solve_gram(g[np.ix_(at, at)], n, True) for j in range(len(ys)) for at in [[*range(k), k + j]]]
    if any(f["status"] != "ok" for f in fits):
        raise ValueError("the lags are collinear or too many")
    b = np.array([f["beta"] for f in fits])
    xx, xy, yy = g[:k, :k], g[:k, k:], g[k:, k:]
    sigma = (yy - b @ xy - (b @ xy).T + b @ xx @ b.T) / n
    sigma = (sigma + sigma.T) / 2
    m = len(ys)
    ll = -0.5 * n * (m * math.log(2 * math.pi) + np.linalg.slogdet(sigma)[1] + m)
    out = []
    for j, f in enumerate(fits):
        s2 = f["ssr"] / (n - k)
        for i, t in enumerate(["const", *xs]):
            se = math.sqrt(f["inv"][i, i] * s2)
            out.append((ys[j], t, float(b[j, i]), se, float(b[j, i] / se), two_sided_p(b[j, i] / se), n))
    coefs = df.sparkSession.createDataFrame(out, "equation string, term string, beta double, se double, t double, p double, n long")
    return {"coefficients": b, "sigma": sigma, "n": n, "p": p, "names": list(ys), "ll": ll, "aic": -2 * ll + 2 * b.size, "bic": -2 * ll + math.log(n) * b.size, "table": coefs}


def var_systems(df: DataFrame, ys: Sequence[str], p: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A vector autoregression for each key: (by, equation, term, beta, se, t, p, n, sigma, status), an aggregate an equation."""
    rows = lags(df, ys, p, by, order)
    xs = [f"{y}_lag{k}" for k in range(1, p + 1) for y in ys]
    parts = [ols(rows, y, xs, by).select(*by, F.lit(y).alias("equation"), "term", "beta", "se", "t", "p", "n", "sigma", "status") for y in ys]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def impulse_responses(fit: dict, horizon: int) -> np.ndarray:
    """Orthogonal responses [h, response, shock] by the Cholesky factor of the residual covariance."""
    m, p = len(fit["names"]), fit["p"]
    a = [fit["coefficients"][:, 1 + k * m : 1 + (k + 1) * m] for k in range(p)]
    phi = [np.eye(m)]
    for h in range(1, horizon + 1):
        phi.append(sum(a[k] @ phi[h - 1 - k] for k in range(min(p, h))))
    return np.array(phi) @ np.linalg.cholesky(fit["sigma"])


def var_irf(spark, fit: dict, horizon: int) -> DataFrame:
    r = impulse_responses(fit, horizon)
    rows = [(h, y, s, float(r[h, i, j])) for h in range(horizon + 1) for i, y in enumerate(fit["names"]) for j, s in enumerate(fit["names"])]
    return spark.createDataFrame(rows, "h int, response string, shock string, value double")


def var_fevd(spark, fit: dict, horizon: int) -> DataFrame:
    """Shares of forecast error variance by shock; they sum to 1."""
    c = np.cumsum(impulse_responses(fit, horizon) ** 2, 0)
    share = c / c.sum(2, keepdims=True)
    rows = [(h, y, s, float(share[h, i, j])) for h in range(horizon + 1) for i, y in enumerate(fit["names"]) for j, s in enumerate(fit["names"])]
    return spark.createDataFrame(rows, "h int, response string, shock string, share double")


def granger_causality(df: DataFrame, y: str, x: str, n_lags: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """F test that lags of x add nothing to lags of y; both fits are parts of one cross-product matrix."""
    rows = lags(df, [y, x], n_lags, by, order)
    cols = [*[f"{y}_lag{k}" for k in range(1, n_lags + 1)], *[f"{x}_lag{k}" for k in range(1, n_lags + 1)]]

    def solve(r):
        n, g, q = int(r["n"]), unpack(r["__gram"], 2 * n_lags + 1), n_lags
        full = solve_gram(g, n, True)
        at = [*range(q + 1), 2 * q + 1]
        part = solve_gram(g[np.ix_(at, at)], n, True)
        dof = n - 2 * q - 1
        if full["status"] != "ok" or part["status"] != "ok" or dof <= 0 or full["ssr"] <= 0:
            return [{"t": n, "f": None, "p": None}]
        f = (part["ssr"] - full["ssr"]) / q / (full["ssr"] / dof)
        return [{"t": n, "f": f, "p": f_sf(f, q, dof)}]

    return solve_rows(gram(rows, [*cols, y], by), by, solve, "t long, f double, p double")


def local_projections(df: DataFrame, y: str, x: str, horizon: int, by: Sequence[str], order: Sequence[str], n_lags: int = 2, controls: Sequence[str] = (), max_lag: int | None = None) -> DataFrame:
    """Response of y at t + h to x at t, h = 0..horizon, given lags of both and controls; Newey-West errors of lag h + 1,
    95 % bands, and the cumulative response. With x = y the duplicate lags are left out. All horizons are one regression by
    (key, horizon): one window pass makes the leads, and a row goes on once a horizon."""
    rows = leads(lags(df, list(dict.fromkeys([y, x])), n_lags, by, order), y, horizon, by, order).withColumn("__x", F.col(x))
    xs = ["__x", *controls, *[f"{c}_lag{k}" for c in dict.fromkeys([y, x]) for k in range(1, n_lags + 1)]]
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"{y}_lead{h}").alias("__lead")) for h in range(0 if x != y else 1, horizon + 1)]))
    long = rows.select(*dict.fromkeys([*by, *order, *xs]), each.alias("__e")).select("*", "__e.h", "__e.__lead").drop("__e")
    fit = ols(long, "__lead", xs, [*by, "h"], cov="newey_west", order=order, max_lag=F.col("h") + 1 if max_lag is None else max_lag).filter("term = '__x'")
    out = fit.select(*by, "h", F.col("beta").alias("irf"), "se", (F.col("beta") - 1.96 * F.col("se")).alias("lower"), (F.col("beta") + 1.96 * F.col("se")).alias("upper"), "n", "status")
    return out.withColumn("cumulative", F.sum("irf").over(ordered(by, ["h"])))


def forecast_eval(df: DataFrame, actual: str, forecast: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """MAE, MSE, RMSE, MAPE (zeros left out of the sum, not of the count), Theil's U against a random walk, R2."""
    e = F.col(actual) - F.col(forecast)
    rows = df.withColumn("__w", F.col(actual) - F.lag(actual).over(ordered(by, order)))
    a = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), (100 * F.sum(F.when(F.abs(F.col(actual)) > 1e-15, F.abs(e / F.col(actual))).otherwise(0.0)) / F.count(F.lit(1))).alias("mape"),
                              F.sum(e * e).alias("__s"), F.sum(F.col("__w") ** 2).alias("__w2"), (F.var_pop(actual) * F.count(F.lit(1))).alias("__t"))
    return a.select(*by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), "mape", F.sqrt(F.try_divide("__s", "__w2")).alias("theil_u"), (1 - F.try_divide("__s", "__t")).alias("r2"))


def _unfold(u: np.ndarray, m: np.ndarray) -> np.ndarray:
    """e with e[t] = u[t] - m[0] e[t-1] - m[1] e[t-2] .., zeros before the start: blocks by matrix products, then a state a block."""
    q, n, wide = len(m), len(u), max(BLOCK, len(m))
    if not q or not n:
        return np.array(u, float)
    h = np.zeros((wide + q, q + 1))  # to a one at the block's start, and to ones 1 .. q rows before it
    h[q, 0] = 1.0
    h[np.arange(q)[::-1], np.arange(1, q + 1)] = 1.0
    for t in range(q, wide + q):
        h[t] -= m @ h[t - q : t][::-1]
    psi, h = h[q:, 0], h[q:, 1:]
    at = np.arange(wide)[None, :] - np.arange(wide)[:, None]
    blocks = -(-n // wide)
    with np.errstate(all="ignore"):  # an m that isn't invertible overflows
        e = np.concatenate((u, np.zeros(blocks * wide - n))).reshape(blocks, wide) @ np.where(at >= 0, psi[at], 0.0)
        ends, back = e[:, : -q - 1 : -1], h[: -q - 1 : -1]
        state = np.zeros((blocks, q))
        for k in range(1, blocks):
            state[k] = ends[k - 1] + back @ state[k - 1]
        e += state @ h.T
    return e.reshape(-1)[:n]


def _css(beta: np.ndarray, z: np.ndarray, p: int, q: int) -> np.ndarray:
    """Residuals of z given [const, ar.., ma..], with zeros before the start."""
    u = z[p:] - beta[0]
    for j in range(p):
        u = u - beta[1 + j] * z[p - 1 - j : len(z) - 1 - j]
    return np.concatenate((np.zeros(p), _unfold(u, beta[1 + p :])))


def _css_slopes(e: np.ndarray, beta: np.ndarray, z: np.ndarray, p: int, q: int, first: int = 0) -> np.ndarray:
    """Derivatives of the residuals e from row p on by each of beta, from number first on: they follow the recursion that
    the residuals do."""
    x = [np.ones(len(z) - p), *[z[p - j : len(z) - j] for j in range(1, p + 1)]]
    x += [np.concatenate((np.zeros(max(0, j - p)), e[max(0, p - j) : len(e) - j])) for j in range(1, q + 1)]
    return np.column_stack([_unfold(-c, beta[1 + p :]) for c in x[first:]])


def _averages(r: np.ndarray) -> np.ndarray:
    """Moving averages from partial autocorrelations; invertible where these lie between -1 and 1, all that are come so."""
    m = np.empty(0)
    for x in r:
        m = np.concatenate((m + x * m[::-1], [x]))
    return m


def _partials(m: np.ndarray) -> np.ndarray:
    """The inverse of _averages; roots outside the unit circle are mirrored in it first, and those near it drawn in."""
    roots = np.roots(np.concatenate(([1.0], m))).astype(complex)
    roots = np.where(abs(roots) > 1, roots / np.maximum(abs(roots), 1) ** 2, roots)
    m, r = np.poly(roots / np.maximum(abs(roots) / 0.98, 1)).real[1:], []
    while len(m):
        r.append(m[-1])
        m = (m[:-1] - m[-1] * m[:-1][::-1]) / (1 - m[-1] ** 2)
    return np.array(r[::-1])


def _css_at(m: np.ndarray, z: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[const, ar.., ma..] of the least conditional squares that moving averages allow (a linear problem), its residuals
    and their slopes by const and ar."""
    b = np.concatenate((np.zeros(1 + p), m))
    x, e = _css_slopes(z, b, z, p, 0), _css(b, z, p, len(m))
    r = np.linalg.qr(np.column_stack((x, e[p:])), mode="r")
    size = np.linalg.norm(r[:, :-1], axis=0)
    size[size == 0] = 1.0
    b[: 1 + p] = -np.linalg.lstsq(r[:, :-1] / size, r[:, -1], rcond=None)[0] / size
    e[p:] += x @ b[: 1 + p]
    return b, e, x


def _fit_css(m: np.ndarray, z: np.ndarray, p: int) -> tuple[np.ndarray, bool]:
    """[const, ar.., ma..] of the least conditional squares near m with invertible moving averages, and whether the steps
    came to their end: damped Gauss-Newton on the arctanh w of partial autocorrelations, so that no step leaves the unit circle."""
    w = np.arctanh(_partials(m))
    q, damp, moved = len(w), 1e-3, True
    b, e, x = _css_at(_averages(np.tanh(w)), z, p)
    cur = float(e @ e)
    for _ in range(500):
        if moved:
            r, k = np.tanh(w), np.arange(q)
            turn = np.column_stack([_averages(np.where(k == i, 1.0, r)) - _averages(np.where(k == i, -1.0, r)) for i in k]) / 2 * np.cosh(w) ** -2.0
            j = np.column_stack((x, _css_slopes(e, b, z, p, q, 1 + p) @ turn))
            size = np.linalg.norm(j, axis=0)
            size[size == 0] = 1.0
            jj, je, moved = j.T @ j / np.outer(size, size), j.T @ e[p:] / size, False
        step = (np.linalg.solve(jj + damp * np.eye(len(jj)), -je) / size)[1 + p :]
        step /= max(1.0, abs(step).max())
        if damp <= 1 and abs(je[1 + p :] * size[1 + p :] @ step) <= 1e-13 * cur:
            return b, True
        new = _css_at(_averages(np.tanh(w + step)), z, p)
        if float(new[1] @ new[1]) < cur:
            w, (b, e, x), damp, moved = w + step, new, max(damp / 5, 1e-9), True
            cur = float(e @ e)
        else:
            damp *= 5
            if damp > 1e8:
                return b, True
    return b, False


def _long_residuals(z: np.ndarray, lags: int) -> np.ndarray:
    """Residuals of a long autoregression, zeros for its first rows; by QR over slices of rows, so that lags take little memory."""
    seen, r = np.lib.stride_tricks.sliding_window_view(z, lags + 1), np.empty((0, lags + 2))
    rows = [slice(lo, lo + SLICE) for lo in range(0, len(seen), SLICE)]
    with_one = lambda at: np.column_stack([np.ones(len(seen[at])), seen[at]])
    for at in rows:
        r = np.linalg.qr(np.concatenate((r, with_one(at))), mode="r")
    b = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=None)[0]
    return np.concatenate([np.zeros(lags), *[seen[at, -1] - b[0] - seen[at, :-1] @ b[1:] for at in rows]])


def fit_arima(y: np.ndarray, p: int, d: int, q: int) -> dict:
    """The series is differenced d times. Least squares for q = 0; else a long autoregression's residuals start it, and
    conditional squares are minimised over invertible moving averages by damped Gauss-Newton steps."""
    z = np.diff(y, d) if d else np.asarray(y, float)
    n, k, ended = len(z), 1 + p + q, True
    if n < p + q + 10:
        return {"status": "too few rows"}
    lagm = lambda s, m, t0: np.column_stack([s[t0 - j : len(s) - j] for j in range(1, m + 1)]) if m else np.empty((len(s) - t0, 0))
    if q == 0:
        x = np.column_stack([np.ones(n - p), lagm(z, p, p)])
        b = np.linalg.lstsq(x, z[p:], rcond=None)[0]
    else:
        long = min(n // 4, max(p, q) + math.ceil(math.log(n) ** 1.5))
        e = _long_residuals(z, long)
        t0 = long + q
        x = np.column_stack([np.ones(n - t0), lagm(z, p, t0), lagm(e, q, t0)])
        b = np.linalg.lstsq(x, z[t0:], rcond=None)[0]
        b, ended = _fit_css(b[1 + p :], z, p)
    e = _css(b, z, p, q)[p:]
    t = len(e)
    s2 = float((e**2).sum() / (t - k))
    ll = -0.5 * t * (math.log(2 * math.pi) + math.log(max(1e-300, float((e**2).mean()))) + 1)
    return {"status": "ok" if ended else "not converged", "beta": b, "sigma2": s2, "ll": ll, "aic": -2 * ll + 2 * (k + 1), "bic": -2 * ll + math.log(t) * (k + 1), "n": t, "z": z, "resid": np.concatenate((np.zeros(p), e))}


def forecast_arima(y: np.ndarray, fit: dict, p: int, d: int, q: int, steps: int, level: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forecasts on the scale of y, with bands from the psi weights of the integrated process."""
    z, e, b = list(fit["z"]), list(fit["resid"]), fit["beta"]
    a, m = b[1 : 1 + p], b[1 + p :]
    for _ in range(steps):
        z.append(b[0] + sum(a[j] * z[-1 - j] for j in range(p)) + sum(m[j] * e[-1 - j] for j in range(q)))
        e.append(0.0)
    f = np.array(z[-steps:])
    for k in range(d):
        f = np.diff(y, d - 1 - k)[-1] + np.cumsum(f) if d - 1 - k else y[-1] + np.cumsum(f)
    poly = np.concatenate(([1.0], -np.asarray(a)))
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    psi = [1.0]
    for h in range(1, steps):
        psi.append((m[h - 1] if h <= q else 0.0) - sum(poly[j] * psi[h - j] for j in range(1, min(h, len(poly) - 1) + 1)))
    half = normal_quantile(0.5 + level / 2) * np.sqrt(fit["sigma2"] * np.cumsum(np.square(psi)))
    return f, f - half, f + half


def arima(df: DataFrame, y: str, p: int, d: int, q: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A fit of ARIMA(p, d, q) for each series; a series must fit in a worker."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "const double, ar array<double>, ma array<double>, sigma2 double, ll double, aic double, bic double, n long, status string"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in by}
        r = fit_arima(pdf.sort_values(list(order))[y].dropna().to_numpy(float), p, d, q)
        if "beta" not in r:
            return pd.DataFrame([{**head, "const": None, "ar": None, "ma": None, "sigma2": None, "ll": None, "aic": None, "bic": None, "n": len(pdf), "status": r["status"]}])
        b = r["beta"]
        return pd.DataFrame([{**head, "const": b[0], "ar": b[1 : 1 + p].tolist(), "ma": b[1 + p :].tolist(), **{k: r[k] for k in ("sigma2", "ll", "aic", "bic", "n", "status")}}])

    return df.select(*dict.fromkeys([*by, *order, y])).groupBy(*by).applyInPandas(fit, schema)


def arima_forecast(df: DataFrame, y: str, p: int, d: int, q: int, steps: int, by: Sequence[str], order: Sequence[str], level: float = 0.95, scale: str = "level") -> DataFrame:
    """(by, h, forecast, lower, upper); scale='differenced' stays on the differenced scale."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "h long, forecast double, lower double, upper double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in by}
        v = pdf.sort_values(list(order))[y].dropna().to_numpy(float)
        if scale == "differenced" and d:
            v, dd = np.diff(v, d), 0
        else:
            dd = d
        r = fit_arima(v, p, dd, q)
        if "beta" not in r:
            return pd.DataFrame(columns=[*by, "h", "forecast", "lower", "upper"])
        f, lo, hi = forecast_arima(v, r, p, dd, q, steps, level)
        return pd.DataFrame([{**head, "h": h + 1, "forecast": f[h], "lower": lo[h], "upper": hi[h]} for h in range(steps)])

    return df.select(*dict.fromkeys([*by, *order, y])).groupBy(*by).applyInPandas(run, schema)


__all__ = ["ar", "har_rv", "har_features", "var", "var_irf", "var_fevd", "granger_causality", "local_projections", "forecast_eval", "arima", "arima_forecast", "difference", "fit_arima", "forecast_arima", "impulse_responses"]
