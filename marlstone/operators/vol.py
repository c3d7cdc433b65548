"""Volatility models: variance recursions in numpy over many series side by side, fitted by simplex searches all at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.frame import each_series

BAD = -1e30
WINDOWS_A_FIT = 512


def _variance(kind: str, p: Sequence[float], e: np.ndarray) -> np.ndarray | None:
    """Conditional variances of the demeaned returns e; None if the parameters or the path aren't admissible."""
    if kind != "egarch":
        h, ok = _variances(kind, np.asarray(p, float)[None], _Batch([np.asarray(e, float)]), np.zeros(1, int))
        return h[:, 0] if ok[0] else None
    # log h = w + a |z| + g z + b log h
    w, a, g, b = p[:4]
    if abs(b) >= 1:
        return None
    h = np.empty(len(e))
    lh = math.log(max(1e-20, float((e**2).mean())))
    for t in range(len(e)):
        if t:
            z = e[t - 1] / math.sqrt(h[t - 1])
            lh = w + a * abs(z) + g * z + b * lh
        if not -200 < lh < 200:
            return None
        h[t] = math.exp(lh)
    return np.maximum(h, 1e-20)


def log_likelihood(kind: str, p: Sequence[float], e: np.ndarray) -> float:
    """Gaussian, or with kind garch_t the standardised t of p[3] degrees of freedom."""
    return float(likelihoods(kind, np.asarray(p, float)[None], _Batch([np.asarray(e, float)]), np.zeros(1, int))[0])


class _Batch:
    """Series side by side: e[t, i], 0 beyond the end of a series."""

    def __init__(self, series: Sequence[np.ndarray]):
        self.n = np.array([len(x) for x in series])
        self.e = np.zeros((int(self.n.max(initial=0)), len(series)))
        for i, x in enumerate(series):
            self.e[: len(x), i] = x
        self.inside = np.arange(len(self.e))[:, None] < self.n
        self.mean2 = (self.e**2).sum(0) / np.maximum(self.n, 1)


def _decay(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """h[t] = b h[t - 1] + a[t] of all columns, by doubling: no step in time waits for the one before it."""
    step, power = 1, b.copy()
    while step < len(a) and power.max(initial=0.0) > 1e-20:
        more = a.copy()
        more[step:] += power * a[:-step]
        a, power, step = more, power * power, 2 * step
    return a


def _variances(kind: str, p: np.ndarray, x: _Batch, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variances [t, i] of series at[i] under parameters p[i], and whether parameters and path are admissible."""
    e, m2 = x.e[:, at], x.mean2[at]
    if kind == "egarch":
        if len(at) < 8:  # few series: a step in time is cheaper by itself than over columns
            paths = [_variance(kind, q, e[: x.n[i], k]) for k, (q, i) in enumerate(zip(p, at))]
            h = np.ones(e.shape)
            for k, v in enumerate(paths):
                if v is not None:
                    h[: len(v), k] = v
            return h, np.array([v is not None for v in paths])
        w, a, g, b = p.T
        ok = np.abs(b) < 1
        h, lh = np.empty(e.shape), np.log(np.maximum(1e-20, m2))
        for t in range(len(e)):
            if t:
                z = e[t - 1] / np.sqrt(h[t - 1])
                lh = w + a * np.abs(z) + g * z + b * lh
            ok &= (np.abs(lh) < 200) | (t >= x.n[at])
            lh = np.clip(lh, -200, 200)
            np.exp(lh, out=h[t])
        return np.maximum(h, 1e-20), ok
    w, a, b = p[:, 0], p[:, 1], p[:, 3 if kind == "gjr" else 2]
    if kind == "gjr":
        g = p[:, 2]
        ok = (w > 0) & (a >= 0) & (b >= 0) & (a + g >= 0) & (a + g / 2 + b < 1)
        shock = (a + g * (e < 0)) * e * e
    else:
        ok = (w > 0) & (a >= 0) & (b >= 0) & (a + b < 1)
        shock = a * e * e
    add = np.empty(e.shape)
    add[1:] = w + shock[:-1]
    with np.errstate(all="ignore"):
        add[:1] = w / (1 - a - b) if kind == "garch" else m2
    return np.maximum(_decay(np.where(ok, add, 1.0), np.where(ok, b, 0.0)), 1e-20), ok


def likelihoods(kind: str, p: np.ndarray, x: _Batch, at: np.ndarray) -> np.ndarray:
    """Log likelihood of series at[i] under parameters p[i]; BAD where they aren't admissible."""
    h, ok = _variances(kind, p, x, at)
    e = x.e[:, at]
    if kind == "garch_t":
        nu = p[:, 3]
        ok = ok & (nu > 2.01)
        nu = np.where(ok, nu, 8.0)
        c = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi * (v - 2)) for v in nu])
        terms = c - 0.5 * np.log(h) - (nu + 1) / 2 * np.log1p(e * e / (h * (nu - 2)))
    else:
        terms = -0.5 * (math.log(2 * math.pi) + np.log(h) + e * e / h)
    return np.where(ok, np.where(x.inside[:, at], terms, 0.0).sum(0), BAD)


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


#: The ends that keep searches admissible, of alpha, of gjr's alpha and gamma, of persistence, of t's freedom (and its logarithm).
MOST_ALPHA, MOST_GJR, MOST_PERSISTENCE, LEAST_NU, MOST_LOG_NU = 0.5, 0.3, 0.999, 2.01, 6.0


def _garch(v):
    a = MOST_ALPHA * _sig(v[:, 1])
    return np.stack([np.exp(np.clip(v[:, 0], -700, 700)), a, (MOST_PERSISTENCE - a) * _sig(v[:, 2])], 1)


def _gjr(v):
    a, g = MOST_GJR * _sig(v[:, 1]), MOST_GJR * _sig(v[:, 2])
    return np.stack([np.exp(np.clip(v[:, 0], -700, 700)), a, g, (MOST_PERSISTENCE - a - g / 2) * _sig(v[:, 3])], 1)


def _egarch(v):
    return np.stack([v[:, 0], v[:, 1], v[:, 2], np.tanh(v[:, 3])], 1)


def _garch_t(v):
    return np.column_stack([_garch(v), np.exp(np.minimum(v[:, 3], MOST_LOG_NU)) + LEAST_NU])


#: From free coordinates (a row a series) to admissible parameters, where the search starts given the sample variance, and names.
TRANSFORM: dict[str, tuple[Callable, Callable, list[str]]] = {
    "garch": (_garch, lambda s: [math.log(0.05 * s), -2.0, 2.2], ["omega", "alpha", "beta"]),
    "gjr": (_gjr, lambda s: [math.log(0.05 * s), -1.5, -1.5, 2.2], ["omega", "alpha", "gamma", "beta"]),
    "egarch": (_egarch, lambda s: [0.1 * math.log(s) - 0.08, 0.1, 0.0, 1.5], ["omega", "alpha", "gamma", "beta"]),
    "garch_t": (_garch_t, lambda s: [math.log(0.05 * s), -2.0, 2.2, 1.8], ["omega", "alpha", "beta", "nu"]),
}


def simplexes(f: Callable[[np.ndarray, np.ndarray], np.ndarray], x0: np.ndarray, max_iter: int = 500, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Downhill simplexes from unit steps along the axes, one for each row of x0, all at once; each stops when its values
    agree to ``tol``. f(points, which rows) gives values. Returns points, values, and which came to an end."""
    many, n = x0.shape
    pts = np.concatenate((x0[:, None], x0[:, None] + np.eye(n)), 1)
    val = np.stack([f(pts[:, j], np.arange(many)) for j in range(n + 1)], 1)
    done = np.zeros(many, bool)
    for _ in range(max_iter):
        order = np.argsort(val, 1, kind="stable")
        val = np.take_along_axis(val, order, 1)
        pts = np.take_along_axis(pts, order[:, :, None], 1)
        done |= np.abs(val[:, -1] - val[:, 0]) < tol
        go = np.flatnonzero(~done)
        if not len(go):
            break
        p, v = pts[go], val[go]
        mid = p[:, :-1].mean(1)
        away = mid - p[:, -1]
        new = mid + away
        fr = f(new, go)
        best, middling = fr < v[:, 0], fr < v[:, -2]
        factor = np.where(best, 2.0, np.where(fr < v[:, -1], 0.5, -0.5))
        other, fo, ask = mid + factor[:, None] * away, np.full(len(go), np.inf), np.flatnonzero(best | ~middling)
        if len(ask):
            fo[ask] = f(other[ask], go[ask])
        take = np.where(best, fo < fr, ~middling & (fo < np.minimum(fr, v[:, -1])))
        keep = np.where(best, ~take, middling)
        p[:, -1] = np.where(take[:, None], other, np.where(keep[:, None], new, p[:, -1]))
        v[:, -1] = np.where(take, fo, np.where(keep, fr, v[:, -1]))
        shrink = np.flatnonzero(~take & ~keep)
        if len(shrink):
            p[shrink, 1:] = (p[shrink, 1:] + p[shrink, :1]) / 2
            for j in range(1, n + 1):
                v[shrink, j] = f(p[shrink, j], go[shrink])
        pts[go], val[go] = p, v
    k = val.argmin(1)
    return pts[np.arange(many), k], val[np.arange(many), k], done


def simplex(f: Callable[[np.ndarray], float], x0: Sequence[float], max_iter: int = 500, tol: float = 1e-8) -> tuple[np.ndarray, float, bool]:
    """One downhill simplex."""
    x, v, ok = simplexes(lambda p, _: np.array([f(q) for q in p]), np.asarray(x0, float)[None], max_iter, tol)
    return x[0], float(v[0]), bool(ok[0])


def fit_volatility(kind: str, r: np.ndarray, se: str = "diagonal") -> dict:
    return fit_many(kind, [r], se)[0]


def fit_many(kind: str, returns: Sequence[np.ndarray], se: str = "diagonal") -> list[dict]:
    """Maximum likelihood on demeaned returns of each series, all searched side by side; errors from second differences of
    the log likelihood, one parameter at a time or (se='full') of all together; 0 where it isn't concave."""
    out: list[dict] = []
    series, where = [], []
    for r in returns:
        r = np.asarray(r, float)
        out.append({"status": "too few rows" if len(r) < 10 else "constant"})
        if len(r) >= 10 and r.std() > 0:
            where.append(len(out) - 1)
            series.append(r)
    if not series:
        return out
    to, start, names = TRANSFORM[kind]
    mu = np.array([r.mean() for r in series])
    x = _Batch([r - m for r, m in zip(series, mu)])
    every, k = np.arange(len(series)), len(names)
    free, low, ok = simplexes(lambda v, at: -likelihoods(kind, to(v), x, at), np.array([start(float(s)) for s in x.mean2]))
    p, ll = to(free), -low
    step = np.maximum(1e-4 * np.abs(p), 1e-8)

    def off(*moves):
        q = p.copy()
        for i, sign in moves:
            q[:, i] += sign * step[:, i]
        return likelihoods(kind, q, x, every)

    if se == "full":
        hess = np.empty((len(series), k, k))
        for i in range(k):
            for j in range(k):
                hess[:, i, j] = (off((i, 1), (j, 1)) - off((i, 1), (j, -1)) - off((i, -1), (j, 1)) + off((i, -1), (j, -1))) / (4 * step[:, i] * step[:, j])
        v = np.zeros((len(series), k))
        for i, h in enumerate(hess):
            try:
                v[i] = np.diag(np.linalg.inv(-h))
            except np.linalg.LinAlgError:
                pass
    else:
        curve = np.stack([(off((i, 1)) - 2 * ll + off((i, -1))) / step[:, i] ** 2 for i in range(k)], 1)
        v = np.where(curve < 0, -1 / np.where(curve < 0, curve, -1), 0)
    lasting = {"garch": lambda: p[:, 1] + p[:, 2], "garch_t": lambda: p[:, 1] + p[:, 2], "gjr": lambda: p[:, 1] + p[:, 2] / 2 + p[:, 3], "egarch": lambda: p[:, 3]}[kind]()
    hs, _ = _variances(kind, p, x, every)
    for i, at in enumerate(where):
        n, h = int(x.n[i]), hs[: x.n[i], i]
        pers = float(lasting[i])
        uncond = float(p[i, 0] / (1 - pers)) if kind != "egarch" and pers < 1 else float(np.mean(h))
        out[at] = {"status": "ok", "mu": float(mu[i]), "params": dict(zip(names, map(float, p[i]))), "se": {a: math.sqrt(c) if c > 0 else 0.0 for a, c in zip(names, v[i])},
                   "ll": float(ll[i]), "aic": float(-2 * ll[i] + 8), "bic": float(-2 * ll[i] + 4 * math.log(n)), "persistence": pers, "unconditional": uncond, "h": h,
                   "z": x.e[:n, i] / np.sqrt(h), "n": n, "converged": bool(ok[i]), "n_params": 4}
    return out


FIT = "mu double, params map<string,double>, se map<string,double>, ll double, aic double, bic double, persistence double, unconditional double, n long, n_params long, converged boolean, status string"


def volatility_model(df: DataFrame, r: str, by: Sequence[str], order: Sequence[str], kind: str = "garch", se: str = "diagonal", paths: bool = False) -> DataFrame:
    """A fit for each series, or (paths) its variances h and standardised residuals z by position. kind: garch, gjr, egarch,
    garch_t; all of order (1, 1). A task fits the many series of its partition side by side; a series must fit in a worker.
    Short ones have a status."""
    kinds = dict(df.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in by)
    names = [*by, *[c.split(" ")[0] for c in FIT.replace("map<string,double>", "map").split(", ")]]

    def fit(series: list[pd.DataFrame]) -> pd.DataFrame:
        own = [{k: s[k].iloc[0] for k in by} for s in series]
        fits = fit_many(kind, [s[r].dropna().to_numpy(float) for s in series], se)
        if paths:
            return pd.concat([pd.DataFrame({**{k: [v] * f.get("n", 0) for k, v in o.items()}, "seq": range(f.get("n", 0)), "h": f.get("h", []), "z": f.get("z", [])}) for o, f in zip(own, fits)], ignore_index=True)
        rows = []
        for o, s, f in zip(own, series, fits):
            row = dict.fromkeys(names) | o | {"n": len(s), "n_params": 4, "status": f["status"]}
            if f["status"] == "ok":
                row |= {k: f[k] for k in ("mu", "params", "se", "ll", "aic", "bic", "persistence", "unconditional", "n", "converged")}
            rows.append(row)
        return pd.DataFrame(rows)[names]

    return each_series(df, by, order, [r], fit, f"{head}, " + ("seq long, h double, z double" if paths else FIT))


def garch_likelihood(values: Column, omega: float, alpha: float, beta: float) -> Column:
    """Log likelihood of an ordered array of demeaned returns at given parameters, as a fold: no Python."""
    start = F.struct(F.lit(omega / (1 - alpha - beta)).alias("h"), F.lit(0.0).alias("ll"))

    def step(s, e):
        h = F.greatest(s["h"], F.lit(1e-20))
        return F.struct((F.lit(omega) + F.lit(alpha) * e * e + F.lit(beta) * h).alias("h"), (s["ll"] - 0.5 * (F.lit(math.log(2 * math.pi)) + F.log(h) + e * e / h)).alias("ll"))

    return F.aggregate(values, start, step, lambda s: s["ll"])


def garch_likelihood_grid(df: DataFrame, r: str, by: Sequence[str], order: Sequence[str], grid: Sequence[tuple[float, float, float]]) -> DataFrame:
    """(by, omega, alpha, beta, ll) of each series at each point of a small grid of parameters."""
    rows = df.filter(F.col(r).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(r).alias("__r")))).alias("v"), F.avg(r).alias("__m"))
    e = F.transform("v", lambda x: x["__r"] - F.col("__m"))
    points = [F.struct(F.lit(o).alias("omega"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), garch_likelihood(F.col("e"), o, a, b).alias("ll")) for o, a, b in grid]
    return rows.withColumn("e", e).select(*by, F.explode(F.array(*points)).alias("p")).select(*by, "p.omega", "p.alpha", "p.beta", "p.ll")


def multiplicative_garch(df: DataFrame, r: str, rv: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Long-run variance tau fitted on realised variance of the same day and its weekly and monthly means (a look-ahead
    smoother, no forecast), floored at 1e-10; GARCH on r / sqrt(tau); variance = tau * g. Per row: tau, g, sigma2."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "seq long, tau double, g double, sigma2 double"])

    def fit(series: list[pd.DataFrame]) -> pd.DataFrame:
        parts = []
        for s, out in zip(series, component_many([(s[r].to_numpy(float), s[rv].to_numpy(float)) for s in series])):
            n, cols = (0, ([], [], [])) if out is None else (len(out[0]), out)
            parts.append(pd.DataFrame({**{k: [s[k].iloc[0]] * n for k in by}, "seq": range(len(s) - n, len(s)), "tau": cols[0], "g": cols[1], "sigma2": cols[2]}))
        return pd.concat(parts, ignore_index=True)

    return each_series(df, by, order, [r, rv], fit, schema)


def component_volatility(r: np.ndarray, rv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    return component_many([(r, rv)])[0]


def component_many(series: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """(tau, g, tau g) of each pair of returns and realised variances from the 22nd row on; None under 30 rows."""
    out: list = [None] * len(series)
    taus, rest = [], []
    for i, (r, rv) in enumerate(series):
        if len(r) < 30:
            continue
        s = pd.Series(rv)
        x = np.column_stack([np.ones(len(rv)), rv, s.rolling(5).mean(), s.rolling(22).mean()])[21:]
        b = np.linalg.lstsq(x[:-1], rv[22:], rcond=None)[0]
        taus.append((i, np.maximum(x @ b, 1e-10)))
        rest.append(r[21:] / np.sqrt(taus[-1][1]))
    for (i, tau), f in zip(taus, fit_many("garch", rest)):
        if f["status"] == "ok":
            out[i] = (tau, f["h"], tau * f["h"])
    return out


def rolling_multiplicative_garch(df: DataFrame, r: str, rv: str, by: Sequence[str], order: Sequence[str], window: int = 252, step: int = 21) -> DataFrame:
    """Annualised last volatility of each window, of all windows of a series at once; no row is copied before it is there."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "win long, volatility double"])

    def fit(series: list[pd.DataFrame]) -> pd.DataFrame:
        parts = []
        for s in series:
            x, y = s[r].to_numpy(float), s[rv].to_numpy(float)
            starts = range(0, len(s) - window + 1, step)
            for lo in range(0, len(starts), WINDOWS_A_FIT):
                some = starts[lo : lo + WINDOWS_A_FIT]
                for k, out in enumerate(component_many([(x[a : a + window], y[a : a + window]) for a in some])):
                    if out is not None:
                        parts.append((*[s[c].iloc[0] for c in by], lo + k, math.sqrt(out[2][-1] * 252)))
        return pd.DataFrame(parts, columns=[*by, "win", "volatility"])

    return each_series(df, by, order, [r, rv], fit, schema)
