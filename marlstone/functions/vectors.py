"""Vector and matrix primitives on array columns and on long form (i, j, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fold(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def vector_sum(a: Column) -> Column:
    return _fold(F.transform(a, lambda x: x.cast("double")))


def vector_mean(a: Column) -> Column:
    return F.try_divide(vector_sum(a), F.size(a))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(k))


def matvec(rows: Column, v: Column) -> Column:
    """Product of an array of row arrays with a vector."""
    return F.transform(rows, lambda r: dot(r, v))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x.cast("double") * y.cast("double")))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of long-form matrices (i, j, value)."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("value").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def column(a: DataFrame, j: int) -> DataFrame:
    """(i, value) of a column of a long-form matrix."""
    return a.filter(F.col("j") == j).select("i", "value")


def with_column(a: DataFrame, j: int, values: DataFrame) -> DataFrame:
    """The matrix with column j replaced by values (i, value)."""
    return a.filter(F.col("j") != j).select("i", "j", "value").unionByName(values.select("i", F.lit(j).cast(a.schema["j"].dataType).alias("j"), "value"))


def filled(spark: SparkSession, rows: int, cols: int, value: float = 0.0) -> DataFrame:
    """A rows x cols matrix of one value: zeros, ones."""
    return spark.range(rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("j"), F.lit(float(value)).alias("value"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return filled(spark, n, n).withColumn("value", (F.col("i") == F.col("j")).cast("double"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def normal_log_likelihood(x: Column, mean: float, variance: float) -> Column:
    """Aggregate: log likelihood of a normal sample."""
    from math import log, pi

    return F.sum(F.lit(-0.5 * log(2 * pi * variance)) - (x - mean) * (x - mean) / (2 * variance))
