"""Cross-product plans: one aggregate gives every sum that a linear model needs; k x k algebra follows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """by, n, g: the upper triangle of the cross products of cols (and 1), by rows. Combines before any shuffle."""
    full = ["__one", *cols]
    w = F.col(weight) if weight else F.lit(1.0)
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    rows = df.filter(ok).withColumn("__one", F.lit(1.0))
    sums = [F.sum(w * F.col(a).cast("double") * F.col(b).cast("double")) for i, a in enumerate(full) for b in full[i:]]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("__gram"))


WIDE = 16  # columns from which on sums of products come from matrix products, not from an expression each


def wide_gram(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, int]:
    """(the symmetric matrix of cols and 1 (at index 0), n): a matrix product a batch, summed in the task, then by cell."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    k = len(cols) + 1
    up = np.triu_indices(k)

    def run(batches):
        total = np.zeros((k, k))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[c.to_numpy(zero_copy_only=False) for c in b.columns]])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(up[0]), pa.array(up[1]), pa.array(total[up])], names=["i", "j", "v"])

    rows = df.filter(ok).select(*[F.col(c).cast("double") for c in cols]).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((k, k))
    for r in rows:
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return m, int(m[0, 0])


def unpack(g: Sequence[float], k: int) -> np.ndarray:
    """The symmetric matrix of k columns and 1 (at index 0)."""
    m = np.zeros((k + 1, k + 1))
    m[np.triu_indices(k + 1)] = g
    return m + np.triu(m, 1).T


def solve_rows(df: DataFrame, by: Sequence[str], fn: Callable[[pd.Series], list[dict]], schema: str) -> DataFrame:
    """Applies fn to each row of an aggregate, in Arrow batches; each may give several rows that begin with ``by``."""
    kinds = dict(df.dtypes)
    full = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), schema])
    names = [*by, *(x.strip().split(" ")[0] for x in schema.split(","))]

    def run(batches):
        for b in batches:
            out = [{**{c: r[c] for c in by}, **x} for _, r in b.iterrows() for x in fn(r)]
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, full)


def inverse_spd(a: np.ndarray) -> np.ndarray | None:
    """Inverse by Cholesky, of the matrix scaled to a unit diagonal; None if it isn't positive definite."""
    d = np.sqrt(np.maximum(np.diag(a), 0))
    if (d == 0).any() or not np.isfinite(a).all():
        return None
    s = a / np.outer(d, d)
    try:
        low = np.linalg.cholesky(s)
    except np.linalg.LinAlgError:
        return None
    if np.diag(low).min() < 1e-7:
        return None
    inv = np.linalg.inv(s)
    return inv / np.outer(d, d)
