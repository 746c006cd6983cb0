"""Generators of cells."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.address import row_major_inverse


def full(spark: SparkSession, shape: Sequence[int], value: float) -> DataFrame:
    n = reduce(lambda a, b: a * b, shape, 1)
    df = spark.range(n)
    return df.select(*(c.alias(f"i{k}") for k, c in enumerate(row_major_inverse(F.col("id"), shape))), F.lit(value).alias("v"))


def zeros(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    return full(spark, shape, 0.0)


def ones(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    return full(spark, shape, 1.0)


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1) -> DataFrame:
    """Integers throughout if all arguments are."""
    if stop is None:
        start, stop = 0, start
    if step == 0 or any(isinstance(x, bool) for x in (start, stop, step)):
        raise ValueError("step must not be zero, and no argument a bool")
    n = -((start - stop) // step) if all(isinstance(x, int) for x in (start, stop, step)) else math.ceil((stop - start) / step)
    return spark.range(max(0, n)).select(F.col("id").alias("i0"), (F.lit(start) + F.col("id") * F.lit(step)).alias("v"))


def linspace(spark: SparkSession, start: float, stop: float, num: int, endpoint: bool = True) -> DataFrame:
    """The last value is stop itself."""
    gaps = num - 1 if endpoint else num
    step = (stop - start) / gaps if gaps > 0 else 0.0
    v = F.lit(float(start)) + F.col("id") * step
    return spark.range(num).select(F.col("id").alias("i0"), (F.when(F.col("id") == num - 1, float(stop)).otherwise(v) if endpoint and num > 1 else v).alias("v"))


def eye(spark: SparkSession, rows: int, columns: int | None = None, k: int = 0) -> DataFrame:
    columns = rows if columns is None else columns
    box = full(spark, [rows, columns], 0.0)
    return box.withColumn("v", (F.col("i1") == F.col("i0") + k).cast("double"))


#: Types of columns that hold an element type's values; others are doubles.
COLUMNS = {"float32": "float", "int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "long", "int64": "long", "uint64": "decimal(20,0)", "bool": "boolean", "int4": "tinyint", "uint4": "tinyint", "int2": "tinyint", "uint2": "tinyint"}


def astype(cells: DataFrame, kind: str) -> DataFrame:
    """Values in the column type of an element type; one that doesn't fit is an error under ANSI mode."""
    return cells.withColumn("v", F.col("v").cast(COLUMNS.get(kind, "double")))


def empty(spark: SparkSession, shape: Sequence[int], kind: str = "float32") -> DataFrame:
    """Values are undefined by contract; here they are zeros."""
    return astype(zeros(spark, shape), kind)


def full_like(cells: DataFrame, value: float, kind: str | None = None) -> DataFrame:
    """The coordinates of a dense tensor's cells with one value, of the same type unless one is given."""
    to = COLUMNS.get(kind, "double") if kind else cells.schema["v"].dataType
    return cells.withColumn("v", F.lit(value).cast(to))


def zeros_like(cells: DataFrame, kind: str | None = None) -> DataFrame:
    return full_like(cells, 0, kind)


def ones_like(cells: DataFrame, kind: str | None = None) -> DataFrame:
    return full_like(cells, 1, kind)


def empty_like(cells: DataFrame, kind: str | None = None) -> DataFrame:
    return zeros_like(cells, kind)


def asarray(spark: SparkSession, values, kind: str | None = None) -> DataFrame:
    """Cells of nested lists, an array or cells."""
    if not isinstance(values, DataFrame):
        import numpy as np

        from gridloom.operators.buffers import from_numpy

        values = from_numpy(spark, np.asarray(values))
    return astype(values, kind) if kind else values
