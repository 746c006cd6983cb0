"""Tensor statistics over all elements, with the catalog's element count: those that aren't stored are zeros. Of no elements, all but the counts and flags are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def summary(cells: DataFrame, total: Column) -> DataFrame:
    v = F.col("v").cast("double")
    ok = F.when(~F.isnan(v), v)
    empty, rest = F.lit(0.0), F.col("total") - F.col("stored")
    out = cells.agg(F.coalesce(F.sum((v != 0).cast("long")), F.lit(0)).alias("nnz"), F.min(ok).alias("value_min"), F.max(ok).alias("value_max"), F.max(F.abs(ok)).alias("value_abs_max"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)).alias("has_nan"), F.coalesce(F.bool_or(F.abs(v) == float("inf")), F.lit(False)).alias("has_inf"), F.count("*").alias("stored"))
    out = out.withColumn("total", total.cast("double"))
    # the rest of the elements are zeros: they shift the mean and widen the spread
    mean, var = F.coalesce("mean", empty), F.coalesce("var", empty)
    spread = (F.col("stored") * var + mean * mean * F.col("stored") * rest / F.col("total")) / F.col("total")
    zero = F.when(rest > 0, empty)
    some = F.col("total") > 0
    return out.select(
        "nnz", F.least("value_min", zero).alias("value_min"), F.greatest("value_max", zero).alias("value_max"), F.greatest("value_abs_max", zero).alias("value_abs_max"),
        F.when(some, F.col("stored") * mean / F.col("total")).alias("value_mean"), F.when(some, F.sqrt(spread)).alias("value_stddev"), "has_nan", "has_inf", "stored",
        F.when(some, (F.col("total") - F.col("nnz")) / F.col("total")).alias("sparsity_ratio"),
    )


def structured(cells: DataFrame, outer: str, axis: str, n: int, m: int) -> DataFrame:
    """Groups of m along the axis, and how many have more than n values that aren't zero."""
    groups = cells.groupBy(outer, F.call_function("div", F.col(axis), F.lit(m)).alias("g")).agg(F.sum((F.col("v") != 0).cast("long")).alias("k"))
    return groups.agg(F.count("*").alias("groups"), F.sum((F.col("k") > n).cast("long")).alias("over"), F.max("k").alias("most"))
