"""Ordered series: Spark rows have no order, so operators take key and order columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The one window of a pipeline: reusing it lets Spark plan one exchange and one sort."""
    return Window.partitionBy(*key).orderBy(*order) if key else Window.partitionBy(F.lit(0)).orderBy(*order)


def with_seq(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "seq") -> DataFrame:
    """0-based position in the series. A series without a key is one task's work: give one where there is one."""
    return df.withColumn(name, F.row_number().over(ordered(key, order)).cast("long") - 1)


def lags(df: DataFrame, cols: Sequence[str], n: int, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds <col>_lag1 .. <col>_lagn."""
    w = ordered(key, order)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in range(1, n + 1)})


def leads(df: DataFrame, col: str, n: int, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = ordered(key, order)
    return df.withColumns({f"{col}_lead{k}": F.lead(col, k).over(w) for k in range(n + 1)})


def nonzero(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(0.0))


ROWS_A_FIT = 100_000


def each_series(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], fit: Callable[[list[pd.DataFrame]], pd.DataFrame], schema: str) -> DataFrame:
    """Applies fit to the series of a partition, ROWS_A_FIT rows or one longer series at a time: whole series, in order."""

    def run(batches):
        held: list[pd.DataFrame] = []
        open_: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf[list(by)].astype(object).where(pdf[list(by)].notna(), None)
            key = pd.Series(list(map(tuple, key.to_numpy())), index=pdf.index)
            starts = [0, *(np.flatnonzero((key != key.shift()).to_numpy()[1:]) + 1)] if len(by) else [0]
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                if open_ and open_[-1].attrs["key"] != key.iloc[a]:
                    held.append(pd.concat(open_, ignore_index=True))
                    open_ = []
                    if rows > ROWS_A_FIT:
                        yield fit(held)
                        held, rows = [], 0
                part = pdf.iloc[a:b]
                part.attrs["key"] = key.iloc[a]
                open_.append(part)
                rows += b - a
        if open_:
            held.append(pd.concat(open_, ignore_index=True))
        if held:
            yield fit(held)

    rows = df.select(*dict.fromkeys([*by, *order, *cols]))
    rows = rows.repartition(*by) if by else rows.coalesce(1)
    return rows.sortWithinPartitions(*by, *order).mapInPandas(run, schema)
