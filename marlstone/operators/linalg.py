"""Dense algebra: small matrices in numpy on the driver, tall ones through their cross products."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.gram import WIDE, gram, unpack, wide_gram


def cholesky(a: np.ndarray) -> np.ndarray:
    """Lower factor; reads the lower triangle only. Raises if not positive definite."""
    low = np.tril(a)
    return np.linalg.cholesky(low + np.tril(a, -1).T)


def invert_spd(a: np.ndarray) -> np.ndarray:
    cholesky(a)
    inv = np.linalg.inv(a)
    return (inv + inv.T) / 2


def solve_spd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = cholesky(a)
    return np.linalg.solve(low.T, np.linalg.solve(low, b))


def solve_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[0] < a.shape[1]:
        raise ValueError("fewer rows than columns")
    q, r = np.linalg.qr(a)
    if np.abs(np.diag(r)).min() == 0:
        raise ValueError("singular")
    return np.linalg.solve(r, q.T @ b)


def svd(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.linalg.svd(a, full_matrices=False)


def eigen_symmetric(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending values; vectors in columns."""
    return np.linalg.eigh(a)


def condition_number(a: np.ndarray) -> float:
    s = np.linalg.svd(a, compute_uv=False)
    return 1e20 if s[-1] < 1e-30 else float(s[0] / s[-1])


def covariance_matrix(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, sample covariance, n) of numeric columns, from one aggregate; shifted first, so that nothing cancels."""
    shift = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    if shift["m0"] is None:
        raise ValueError("no rows")
    m0 = np.array([shift[f"m{i}"] for i in range(len(cols))])
    names = [f"c{i}" for i in range(len(cols))]
    about = df.select(*[(F.col(c) - float(m0[i])).alias(names[i]) for i, c in enumerate(cols)])
    if len(cols) > WIDE:
        g, n = wide_gram(about, names)
    else:
        r = gram(about, names).first()
        g, n = unpack(r["__gram"], len(cols)), int(r["n"])
    d = g[0, 1:] / n
    return m0 + d, (g[1:, 1:] - n * np.outer(d, d)) / (n - 1), n


def pca(df: DataFrame, cols: Sequence[str], n_components: int = 0) -> tuple[DataFrame, DataFrame]:
    """(components, scores): variance, ratio and loadings by component, largest first; df with score1.. columns. Covariance
    scale; each loading vector's largest entry is positive. 0 or too many components mean all."""
    mean, cov, _ = covariance_matrix(df, cols)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(-val, kind="stable")
    k = n_components if 0 < n_components <= len(cols) else len(cols)
    val, vec = val[order], vec[:, order]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(len(cols))])
    rows = [(j + 1, float(val[j]), float(val[j] / val.sum()), cols[i], float(vec[i, j])) for j in range(k) for i in range(len(cols))]
    comp = df.sparkSession.createDataFrame(rows, "component int, variance double, ratio double, variable string, loading double")
    scores = df.withColumns({f"score{j + 1}": sum((F.col(c) - float(mean[i])) * float(vec[i, j]) for i, c in enumerate(cols)) for j in range(k)})
    return comp, scores


def tall_svd(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(df with u1.., singular values, Vt) of a tall matrix, through its cross products: sound up to a condition of 1e8."""
    g = (wide_gram(df, cols)[0] if len(cols) > WIDE else unpack(gram(df, cols).first()["__gram"], len(cols)))[1:, 1:]
    val, vec = np.linalg.eigh(g)
    order = np.argsort(-val)
    s, v = np.sqrt(np.maximum(val[order], 0)), vec[:, order]
    to = v / np.where(s > 0, s, math.inf)
    at, names = [df.columns.index(c) for c in cols], [f"u{j + 1}" for j in range(len(cols))]
    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in names]])

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(i).cast("double").to_numpy(zero_copy_only=False) for i in at])
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(u) for u in (x @ to).T]], names=[*b.schema.names, *names])

    return df.mapInArrow(run, schema), s, v.T
