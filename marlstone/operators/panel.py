"""Panels: fixed effects by demeaning windows, and cross-sections by period."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import newey_west_auto_lag, two_sided_p
from ..plans.gram import gram, solve_rows, unpack
from .regression import COEF, design, ols, solve_gram
from .regression import summary as regression_summary


def demean_by_group(df: DataFrame, cols: Sequence[str], group: str) -> DataFrame:
    w = Window.partitionBy(group)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in cols})


def count_unique(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.countDistinct(col).alias("n"))


SOLVED = 512  # periods up to which their effects come from one system of equations


def within(df: DataFrame, cols: Sequence[str], entity: str, time: str, effects: str, rounds: int = 20, tol: float = 1e-7) -> DataFrame:
    """Takes entity or time means out; for both, as the panel may be unbalanced, the periods' effects that solve the normal
    equations (one cell for two periods of an entity, summed), and then entity means. With more than SOLVED periods, means are
    taken out by turns; if an entity's mean is after ``rounds`` still over ``tol`` times a column's spread, that is an error.
    """
    if effects == "entity":
        return demean_by_group(df, cols, entity)
    if effects == "time":
        return demean_by_group(df, cols, time)
    inner = demean_by_group(df, cols, entity)
    sums = inner.groupBy(time).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"c{i}") for i, c in enumerate(cols)]).limit(SOLVED + 1).collect()
    if len(sums) <= SOLVED:
        return _solved(df, inner, cols, entity, time, sorted(sums))
    for _ in range(rounds):
        df = demean_by_group(demean_by_group(df, cols, entity), cols, time)
    means = df.groupBy(entity).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.sum(F.col(c) * F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)], F.count(F.lit(1)).alias("n"))
    left = means.agg(*[F.max(F.abs(f"m{i}")).alias(f"m{i}") for i in range(len(cols))], *[F.sqrt(F.sum(f"s{i}") / F.sum("n")).alias(f"s{i}") for i in range(len(cols))]).first()
    for i, c in enumerate(cols):
        if left[f"m{i}"] is not None and left[f"m{i}"] > tol * max(left[f"s{i}"], 1e-300):
            raise RuntimeError(f"{rounds} rounds of demeaning leave means of {left[f'm{i}']:.3g} in {c}; give more")
    return df


def _solved(df: DataFrame, inner: DataFrame, cols: Sequence[str], entity: str, time: str, sums: list) -> DataFrame:
    """df less the periods' effects, entity means taken out: exact."""
    place = {r[time]: i for i, r in enumerate(sums)}
    cells = df.groupBy(entity, time).agg(F.count(F.lit(1)).alias("__n"))
    cells = cells.withColumn("__all", F.sum("__n").over(Window.partitionBy(entity)))
    other = cells.select(entity, F.col(time).alias("__s"), F.col("__n").alias("__m"))
    pairs = cells.join(other, entity).groupBy(time, "__s").agg(F.sum(F.col("__n") * F.col("__m") / F.col("__all")).alias("v")).collect()  # SOLVED ** 2 rows at most
    a = np.diag([float(r["n"]) for r in sums])
    for r in pairs:
        a[place[r[time]], place[r["__s"]]] -= r["v"]
    effect = np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ np.array([[r[f"c{i}"] for i in range(len(cols))] for r in sums]).reshape(len(sums), len(cols))
    kind = df.schema[time].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(r[time], *map(float, effect[i])) for i, r in enumerate(sums)], ", ".join([f"`{time}` {kind}", *[f"__e{i} double" for i in range(len(cols))]]))
    rows = df.join(F.broadcast(table), time).withColumns({c: F.col(c) - F.col(f"__e{i}") for i, c in enumerate(cols)})  # SOLVED rows at most
    return demean_by_group(rows, cols, entity).select(*df.columns)


def fixed_effects(df: DataFrame, y: str, xs: Sequence[str], entity: str, time: str, effects: str = "entity", cov: str = "entity", rounds: int = 20) -> DataFrame:
    """Within estimator. cov: classical, entity, time or both (clusters). Classical degrees of freedom leave absorbed effects
    out; r2 is within."""
    d = within(df.select(entity, time, y, *xs).dropna(), [y, *xs], entity, time, effects, rounds)
    clusters = {"classical": [], "entity": [entity], "time": [time], "both": [entity, time]}[cov]
    return ols(d, y, xs, intercept=False, cov="cluster" if clusters else "classical", cluster=clusters)


def summary(df: DataFrame, rows: list, entity: str, time: str, effects: str = "entity") -> str:
    """Text of a within fit: the effects, entities, periods and rows an entity on average, then the coefficients."""
    n = df.agg(F.countDistinct(entity).alias("e"), F.countDistinct(time).alias("t"), F.count(F.lit(1)).alias("n")).first()
    return regression_summary(rows, f"Fixed effects ({effects})", entities=n["e"], periods=n["t"], rows_an_entity=n["n"] / max(1, n["e"]))


def fama_macbeth(df: DataFrame, y: str, xs: Sequence[str], time: str, intercept: bool = False, hac_lag: int | None = None) -> DataFrame:
    """Cross-section regressions by period and the means of their coefficients; errors by Newey-West over periods (lag
    floor(T^(1/3)); 0 for plain ones). Periods that can't be fitted are left out, and counted."""
    terms, cols = design(xs, intercept), [*xs, y]

    def fit(r):
        f = solve_gram(unpack(r["__gram"], len(cols)), int(r["n"]), intercept)
        return [{"ok": f["status"] == "ok", "b": [float(x) for x in f["beta"]] if f["status"] == "ok" else None}]

    rows = solve_rows(gram(df, cols, [time]), [time], fit, "ok boolean, b array<double>").orderBy(time).collect()  # a row a period
    b = np.array([r["b"] for r in rows if r["ok"]])
    t = len(b)
    if t < 2:
        raise ValueError("fewer than two periods could be fitted")
    mean = b.mean(0)
    e = b - mean
    lag = newey_west_auto_lag(t) if hac_lag is None else hac_lag
    if lag:
        s = (e**2).sum(0) / t
        for k in range(1, lag + 1):
            s = s + 2 * (1 - k / (lag + 1)) * (e[k:] * e[:-k]).sum(0) / t
        se = np.sqrt(np.maximum(s, 0) / t)
    else:
        se = np.sqrt((e**2).sum(0) / (t - 1) / t)
    out = [(n, float(m), float(s), float(m / s) if s > 0 else math.nan, two_sided_p(m / s) if s > 0 else math.nan, t, len(rows) - t) for n, m, s in zip(terms, mean, se)]
    return df.sparkSession.createDataFrame(out, "term string, gamma double, se double, t double, p double, n_periods long, n_skipped long")


__all__ = ["fixed_effects", "fama_macbeth", "demean_by_group", "count_unique", "within", "summary", "COEF"]
