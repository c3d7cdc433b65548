"""Linear models: cross products in one aggregate, k x k algebra on the aggregated rows, a second pass for robust errors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import chi2_sf, f_sf, newey_west_auto_lag, two_sided_p
from ..plans.frame import ordered, with_seq
from ..plans.gram import gram, inverse_spd, solve_rows, unpack

COEF = "term string, beta double, se double, t double, p double, n long, k long, r2 double, adj_r2 double, sigma double, ssr double, status string"


def design(xs: Sequence[str], intercept: bool) -> list[str]:
    return (["const"] if intercept else []) + list(xs)


def solve_gram(g: np.ndarray, n: int, intercept: bool) -> dict:
    """beta, inverse and fit of the last column on the others; g holds 1 first. Means are taken out first, for accuracy."""
    k = g.shape[0] - 2
    mean = g[0, 1:] / g[0, 0]
    s = g[1:, 1:] - g[0, 0] * np.outer(mean, mean) if intercept else g[1:, 1:]
    kk = k + intercept
    if n <= kk:
        return {"status": "too few rows"}
    inv = inverse_spd(s[:k, :k]) if k else np.zeros((0, 0))
    if inv is None:
        return {"status": "singular"}
    b = inv @ s[:k, k]
    b = b + inv @ (s[:k, k] - s[:k, :k] @ b)  # one step of refinement
    ssr = max(0.0, float(s[k, k] - 2 * b @ s[:k, k] + b @ s[:k, :k] @ b))
    tss = float(g[-1, -1] - g[0, -1] ** 2 / g[0, 0])
    if intercept:
        m = mean[:k]
        top = np.concatenate(([1 / g[0, 0] + m @ inv @ m], -inv @ m))
        inv = np.vstack((top, np.column_stack((-inv @ m, inv))))
        b = np.concatenate(([mean[k] - m @ b], b))
    return {"status": "ok", "beta": b, "inv": inv, "ssr": ssr, "tss": tss, "n": n, "k": kk}


def table(fit: dict, terms: Sequence[str], cov: np.ndarray | None, n: int) -> list[dict]:
    if fit["status"] != "ok":
        return [{"term": t, "n": n, "k": len(terms), "status": fit["status"]} for t in terms]
    k, dof = fit["k"], fit["n"] - fit["k"]
    v = fit["inv"] * fit["ssr"] / dof if cov is None else cov
    r2 = 1 - fit["ssr"] / fit["tss"] if fit["tss"] > 0 else math.nan
    out = []
    for i, t in enumerate(terms):
        se = math.sqrt(max(0.0, v[i, i]))
        ts = fit["beta"][i] / se if se > 0 else math.nan
        out.append({"term": t, "beta": float(fit["beta"][i]), "se": se, "t": ts, "p": two_sided_p(ts), "n": n, "k": k, "r2": r2,
                    "adj_r2": 1 - (1 - r2) * (fit["n"] - 1) / dof, "sigma": math.sqrt(fit["ssr"] / dof), "ssr": fit["ssr"], "status": "ok"})
    return out


def ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), cov: str = "classical", intercept: bool = True, weight: str | None = None,
        order: Sequence[str] = (), max_lag: int | Column | None = None, cluster: Sequence[str] = ()) -> DataFrame:
    """Ordinary (or weighted) least squares per group ``by``: a row a coefficient. cov: classical, white (HC0), newey_west
    (needs ``order``; lag floor(n^(1/3)) by default; may be a column of ``by``), cluster (one or two columns). p-values are two-sided normal. Groups
    that can't be fitted have a status and nulls; rows with a null in y, xs or by's order aren't used."""
    terms, cols = design(xs, intercept), [*xs, y]
    g = gram(df, cols, by, weight)

    def classical(r):
        n = int(r["n"])
        return table(solve_gram(unpack(r["__gram"], len(cols)), n, intercept), terms, None, n)

    if cov == "classical":
        return solve_rows(g, by, classical, COEF)

    def coefs(r):
        fit = solve_gram(unpack(r["__gram"], len(cols)), int(r["n"]), intercept)
        return [{"__b": [float(x) for x in fit["beta"]] if fit["status"] == "ok" else None}]

    beta = solve_rows(g, by, coefs, "__b array<double>")
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    rows = df.filter(ok)
    if by:
        rows = rows.join(beta, list(by))
    else:
        found = beta.first()  # one row
        rows = rows.withColumn("__b", F.array(*[F.lit(x) for x in (found["__b"] or [])]) if found and found["__b"] else F.lit(None).cast("array<double>"))
    x = [F.lit(1.0)] * intercept + [F.col(c).cast("double") for c in xs]
    e = F.col(y) - sum(F.get("__b", F.lit(i)) * c for i, c in enumerate(x))
    wt = F.col(weight) if weight else F.lit(1.0)
    k = len(terms)
    score = {f"__s{i}": e * c * wt for i, c in enumerate(x)}
    names = list(score)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    meat = lambda d, keys: d.groupBy(*keys).agg(F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("__m"))
    scored = rows.select(*{*by, *order, *cluster}, *[c.alias(n) for n, c in score.items()])
    if cov == "white":
        parts = [(1.0, meat(scored, by), None)]
    elif cov == "newey_west":
        parts = [(1.0, _bartlett(scored, names, by, order, max_lag, meat), None)]
    elif cov == "cluster":
        sets = [list(cluster)] if len(cluster) == 1 else [[cluster[0]], [cluster[1]], list(cluster)]
        parts = []
        for sign, s in zip((1.0, 1.0, -1.0), sets):
            sums = scored.groupBy(*by, *s).agg(*[F.sum(n).alias(n) for n in names])
            parts.append((sign, sums.groupBy(*by).agg(F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("__m"), F.count(F.lit(1)).alias("__g")), "g"))
    else:
        raise ValueError(f"unknown covariance: {cov}")
    joined = g
    for i, (_, m, _) in enumerate(parts):
        m = m.withColumnRenamed("__m", f"__m{i}").withColumnRenamed("__g", f"__g{i}")
        joined = joined.join(m, list(by), "left") if by else joined.join(F.broadcast(m))  # one row each

    signs = [(sign, kind) for sign, _, kind in parts]  # what the workers get: no frames

    def sandwich(r):
        n = int(r["n"])
        fit = solve_gram(unpack(r["__gram"], len(cols)), n, intercept)
        if fit["status"] != "ok":
            return table(fit, terms, None, n)
        v = np.zeros((k, k))
        for i, (sign, kind) in enumerate(signs):
            m = np.zeros((k, k))
            m[np.triu_indices(k)] = r[f"__m{i}"]
            m = m + np.triu(m, 1).T
            if kind:
                groups = r[f"__g{i}"]
                m = m * (groups / (groups - 1) * (n - 1) / (n - k) if groups > 1 else math.nan)
            v += sign * fit["inv"] @ m @ fit["inv"]
        return table(fit, terms, v, n)

    return solve_rows(joined, by, sandwich, COEF)


def _bartlett(scored: DataFrame, names: list[str], by: Sequence[str], order: Sequence[str], max_lag: int | Column | None, meat) -> DataFrame:
    """The Bartlett sum as one window and one aggregate: with L zero rows after each series and W the sum of L + 1 scores,
    S = sum(W W') / (L + 1), whatever L is."""
    if not order:
        raise ValueError("newey_west needs order columns")
    key = list(by) or ["__all"]
    s = with_seq(scored.withColumn("__all", F.lit(0)), key, list(order), "__seq")
    n = s.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    auto = F.floor(F.pow(F.col("__n").cast("double"), F.lit(1 / 3))) if max_lag is None else max_lag if isinstance(max_lag, Column) else F.lit(max_lag)
    n = n.withColumn("__L", auto.cast("long"))
    pad = n.filter("`__L` > 0").withColumn("__seq", F.explode(F.sequence(F.col("__n"), F.col("__n") + F.col("__L") - 1)))
    rows = s.select(*key, "__seq", *names).unionByName(pad.select(*key, "__seq", *[F.lit(0.0).alias(c) for c in names]))
    w = Window.partitionBy(*key).orderBy("__seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    cum = rows.withColumns({c: F.sum(c).over(upto) for c in names}).join(n.select(*key, "__L"), key)
    # frames have constant ends, lags may differ by series: look the earlier prefix up
    back = cum.select(*key, (F.col("__seq") + F.col("__L") + 1).alias("__seq"), *[F.col(c).alias(f"{c}b") for c in names])
    both = cum.join(back, [*key, "__seq"], "left")
    both = both.select(*by, "__L", *[((F.col(c) - F.coalesce(F.col(f"{c}b"), F.lit(0.0))) / F.sqrt(F.col("__L") + 1.0)).alias(c) for c in names])
    return meat(both, by)


def batched_ols(df: DataFrame, key: Sequence[str], y: str, xs: Sequence[str], **options) -> DataFrame:
    """A regression for each key."""
    return ols(df, y, xs, by=key, **options)


def batched_ols_columns(df: DataFrame, ys: Sequence[str], xs: Sequence[str], intercept: bool = True) -> DataFrame:
    """Many left-hand sides on the same regressors: one aggregate for all."""
    g = gram(df, [*xs, *ys])
    k = len(xs)

    def solve(r):
        m, n, out = unpack(r["__gram"], k + len(ys)), int(r["n"]), []
        for j, name in enumerate(ys):
            at = [*range(k + 1), k + 1 + j]
            out += [{"y": name, **x} for x in table(solve_gram(m[np.ix_(at, at)], n, intercept), design(xs, intercept), None, n)]
        return out

    return solve_rows(g, [], solve, "y string, " + COEF)


def _window_ols(df, y, xs, key, order, frame, keep, intercept):
    cols = ["__one", *xs, y]
    s = with_seq(df, key, order).withColumn("__one", F.lit(1.0))
    w = ordered(key, order).rowsBetween(*frame)
    sums = [F.sum(F.col(a).cast("double") * F.col(b)).over(w) for i, a in enumerate(cols) for b in cols[i:]]
    g = s.select(*key, F.col("seq").alias("end_seq"), F.count(F.lit(1)).over(w).alias("n"), F.array(*sums).alias("__gram")).filter(keep)

    def solve(r):
        n = int(r["n"])
        return table(solve_gram(unpack(r["__gram"], len(xs) + 1), n, intercept), design(xs, intercept), None, n)

    return solve_rows(g, [*key, "end_seq"], solve, COEF)


def rolling_ols(df: DataFrame, y: str, xs: Sequence[str], window: int, key: Sequence[str], order: Sequence[str], step: int = 1, intercept: bool = True, cov: str = "classical") -> DataFrame:
    """OLS of each window of rows, at every ``step``: sums of cross products slide; robust errors go by (window, row)."""
    if window <= len(xs) + intercept:
        raise ValueError("window has no more rows than coefficients")
    if cov == "classical":
        return _window_ols(df, y, xs, key, order, (-(window - 1), 0), (F.col("end_seq") >= window - 1) & (F.pmod(F.col("end_seq") - (window - 1), F.lit(step)) == 0), intercept)
    s = with_seq(df, key, order)
    last = s.groupBy(*key).agg(F.max("seq").alias("__last"))
    lo = F.greatest(F.lit(0), F.ceil((F.col("seq") - window + 1) / step)).cast("long")
    hi = F.least(F.floor(F.col("seq") / step), F.floor((F.col("__last") + 1 - window) / step)).cast("long")
    rows = s.join(last, list(key)).withColumns({"__lo": lo, "__hi": hi}).filter("`__hi` >= `__lo`").withColumn("__w", F.explode(F.sequence("__lo", "__hi")))
    rows = rows.withColumn("end_seq", F.col("__w") * step + window - 1)
    return ols(rows, y, xs, by=[*key, "end_seq"], cov=cov, intercept=intercept, order=["seq"])


def expanding_ols(df: DataFrame, y: str, xs: Sequence[str], min_obs: int, key: Sequence[str], order: Sequence[str], step: int = 1, intercept: bool = True) -> DataFrame:
    keep = (F.col("end_seq") >= min_obs - 1) & (F.pmod(F.col("end_seq") - (min_obs - 1), F.lit(step)) == 0)
    return _window_ols(df, y, xs, key, order, (Window.unboundedPreceding, 0), keep, intercept)


def fgls(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), intercept: bool = True, method: str = "squared_residual") -> DataFrame:
    """Feasible GLS with a diagonal weight: 1 / max(e^2, 1e-15), or, by method='modelled', the exponential of a regression
    of log e^2 on the regressors. No n x n matrix: two weighted aggregates."""
    rows = residuals(df, y, xs, by, intercept, "__e").withColumn("__e2", F.greatest(F.col("__e") ** 2, F.lit(1e-15)))
    if method == "squared_residual":
        rows = rows.withColumn("__wt", 1 / F.col("__e2"))
    else:
        rows = residuals(rows.withColumn("__le", F.log("__e2")), "__le", xs, by, intercept, "__u").withColumn("__wt", F.exp(F.col("__u") - F.col("__le")))
    return ols(rows, y, xs, by, intercept=intercept, weight="__wt")


def residuals(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), intercept: bool = True, out: str = "resid") -> DataFrame:
    fit = ols(df, y, xs, by, intercept=intercept)
    terms = design(xs, intercept)
    wide = fit.groupBy(*by).agg(*[F.max(F.when(F.col("term") == t, F.col("beta"))).alias(f"__c{i}") for i, t in enumerate(terms)])
    rows = df.join(wide, list(by)) if by else df.join(F.broadcast(wide))  # one row
    x = [F.lit(1.0)] * intercept + [F.col(c) for c in xs]
    return rows.withColumn(out, F.col(y) - sum(F.col(f"__c{i}") * c for i, c in enumerate(x))).drop(*[f"__c{i}" for i in range(len(terms))])


def gls(y: np.ndarray, x: np.ndarray, omega: np.ndarray) -> dict:
    """Generalised least squares with a full n x n covariance, on the driver: for small n only."""
    if len(y) > 5000:
        raise ValueError("a full covariance of over 5000 rows is not for this operator; give diagonal weights to ols")
    low = np.linalg.cholesky(omega)
    ys, xs = np.linalg.solve(low, y), np.linalg.solve(low, x)
    inv = np.linalg.inv(xs.T @ xs)
    b = inv @ (xs.T @ ys)
    e = y - x @ b
    s2 = float(((ys - xs @ b) ** 2).sum() / (len(y) - x.shape[1]))
    se = np.sqrt(np.diag(inv) * s2)
    return {"beta": b, "se": se, "r2": 1 - float((e**2).sum() / ((y - y.mean()) ** 2).sum()), "p": np.array([two_sided_p(t) for t in b / se])}


IV = "term string, beta double, se double, t double, p double, n long, first_stage_f double, partial_f double, partial_r2 double, weak boolean, sargan double, sargan_p double, status string"


def iv_2sls(df: DataFrame, y: str, xs: Sequence[str], zs: Sequence[str], by: Sequence[str] = (), intercept: bool = True, cov: str = "classical",
            order: Sequence[str] = (), max_lag: int | None = None) -> DataFrame:
    """Two-stage least squares: xs may be endogenous; zs are all instruments (exogenous xs included). One aggregate of the
    cross products of [z x y]; a second for white or newey_west (needs ``order``; lag floor(n^(1/3)) by default) errors. Weak: first-stage F under 10. Sargan's chi2 has l - k degrees."""
    if len(zs) < len(xs):
        raise ValueError("fewer instruments than regressors")
    if cov not in ("classical", "white", "newey_west"):
        raise ValueError(f"unknown covariance: {cov}")
    names = list(dict.fromkeys([*zs, *xs]))
    g = gram(df, [*names, y], by)
    zi, xi = [0] * intercept + [1 + names.index(z) for z in zs], [0] * intercept + [1 + names.index(x) for x in xs]
    terms = design(xs, intercept)

    def fit(m, n):
        zz, zx, zy = m[np.ix_(zi, zi)], m[np.ix_(zi, xi)], m[zi, -1]
        inv = inverse_spd(zz)
        if inv is None or n <= len(xi):
            return None
        a = inverse_spd(zx.T @ inv @ zx)
        if a is None:
            return None
        return inv, a, a @ (zx.T @ inv @ zy), zz, zx, zy

    def solve(r):
        n, m = int(r["n"]), unpack(r["__gram"], len(names) + 1)
        f = fit(m, n)
        if f is None:
            return [{"term": t, "n": n, "status": "singular"} for t in terms]
        inv, a, b, zz, zx, zy = f
        ssr = float(m[-1, -1] - 2 * b @ m[xi, -1] + b @ m[np.ix_(xi, xi)] @ b)
        v = a * ssr / (n - len(xi))
        if cov != "classical":
            meat = np.zeros((len(zi), len(zi)))
            meat[np.triu_indices(len(zi))] = r["__m"]
            meat = meat + np.triu(meat, 1).T
            p = a @ zx.T @ inv
            v = p @ meat @ p.T
        # first stage of the first regressor that isn't an instrument
        endo = next((x for x in xs if x not in zs), xs[0])
        e = 1 + names.index(endo)
        tss = m[e, e] - m[0, e] ** 2 / m[0, 0]
        ess = m[zi, e] @ inv @ m[zi, e] - m[0, e] ** 2 / m[0, 0]
        rss = max(1e-300, tss - ess)
        q = len(zi) - len(xi) + 1
        first_f = (ess / max(1, q)) / (rss / (n - len(zi)))
        shared = [i for i in zi if i in xi]
        base = m[e, e] - (m[shared, e] @ np.linalg.pinv(m[np.ix_(shared, shared)]) @ m[shared, e] if shared else 0.0)
        q2 = len(zi) - len(shared)
        part = ((base - rss) / q2) / (rss / (n - len(zi))) if q2 else math.nan
        ze = zy - zx @ b
        sargan = n * float(ze @ inv @ ze) / ssr if len(zi) > len(xi) and ssr > 0 else 0.0
        df_s = len(zi) - len(xi)
        out = []
        for i, t in enumerate(terms):
            se = math.sqrt(max(0.0, v[i, i]))
            ts = b[i] / se if se else math.nan
            out.append({"term": t, "beta": float(b[i]), "se": se, "t": ts, "p": two_sided_p(ts), "n": n, "first_stage_f": first_f, "partial_f": part, "partial_r2": 1 - rss / base if base > 0 else math.nan,
                        "weak": bool(first_f < 10), "sargan": sargan, "sargan_p": chi2_sf(sargan, df_s) if df_s else 1.0, "status": "ok"})
        return out

    if cov != "classical":
        beta = solve_rows(g, by, lambda r: [{"__b": None if (f := fit(unpack(r["__gram"], len(names) + 1), int(r["n"]))) is None else [float(x) for x in f[2]]}], "__b array<double>")
        ok = F.lit(True)
        for c in [*names, y]:
            ok = ok & F.col(c).isNotNull()
        rows = df.filter(ok)
        rows = rows.join(beta, list(by)) if by else rows.join(F.broadcast(beta))  # one row
        x = [F.lit(1.0)] * intercept + [F.col(c) for c in xs]
        z = [F.lit(1.0)] * intercept + [F.col(c) for c in zs]
        e = F.col(y) - sum(F.get("__b", F.lit(i)) * c for i, c in enumerate(x))
        own = [f"__s{i}" for i in range(len(z))]
        scored = rows.select(*{*by, *order}, *[(e * c).alias(k) for k, c in zip(own, z)])
        sums = lambda d, keys: d.groupBy(*keys).agg(F.array(*[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(own) for b in own[i:]]).alias("__m"))
        meat = sums(scored, by) if cov == "white" else _bartlett(scored, own, by, order, max_lag, sums)
        g = g.join(meat, list(by)) if by else g.join(F.broadcast(meat))
    return solve_rows(g, by, solve, IV)


def summary(rows: list, title: str = "OLS", **facts) -> str:
    """A fit's rows as text, under its title, the number of rows and R2, and whatever else is given (entities, periods, ..)."""
    first = rows[0].asDict() if hasattr(rows[0], "asDict") else dict(rows[0])
    known = {"n": first.get("n"), "r2": first.get("r2"), "adj. r2": first.get("adj_r2")} | facts
    line = "   ".join(f"{k} = {v:.6g}" if isinstance(v, float) else f"{k} = {v}" for k, v in known.items() if v is not None)
    head = f"{'term':<16}{'beta':>14}{'se':>14}{'t':>10}{'p':>10}"
    return "\n".join([title, line, "-" * len(head), head, *[f"{r['term']:<16}{r['beta']:>14.6g}{r['se']:>14.6g}{r['t']:>10.3f}{r['p']:>10.4f}" for r in rows]])


__all__ = ["ols", "batched_ols", "batched_ols_columns", "rolling_ols", "expanding_ols", "fgls", "gls", "iv_2sls", "residuals", "summary", "newey_west_auto_lag", "f_sf"]
