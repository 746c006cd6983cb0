"""Running sums over a dense index, in two levels: no partition ever sees more than a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = 1 << 16


def exclusive_sum(df: DataFrame, index: str, value: str, into: str) -> DataFrame:
    """df with the sum of value over all smaller index; null where the index is, and such rows count nowhere. Sums of chunks are few: one for each CHUNK of index."""
    rows = df.withColumn("__chunk", F.call_function("div", F.col(index), F.lit(CHUNK)))
    sums = rows.where("__chunk is not null").groupBy("__chunk").agg(F.sum(value).alias("__sum"))
    before: Column = F.coalesce(F.sum("__sum").over(Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("__chunk", before.alias("__base"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__in", inside).join(base, "__chunk", "left").withColumn(into, (F.col("__base") + F.col("__in")).cast("long")).drop("__chunk", "__in", "__base")
