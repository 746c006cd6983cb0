"""Layouts as data: classes of tags, buffers that a layout needs, the choice of a layout, and re-layout of stored elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import address
from gridloom.sources.descriptor import LAYOUTS


def tag_class(tag: Column) -> Column:
    """invalid, private, named or reserved; null for null."""
    named = tag.isin(sorted(LAYOUTS.values()))
    return F.when(tag.isin(0, 255), "invalid").when(tag.between(0xF0, 0xFE), "private").when(named, "named").when(tag.isNotNull(), "reserved")


def negotiate(tensors: DataFrame) -> DataFrame:
    """(tensor, chosen) from rows (tensor, native, preferred, may_transcode): the first preferred layout that is stored, or that may be made; else the native one."""
    wanted = tensors.select("tensor", "native", "may_transcode", F.posexplode("preferred").alias("pos", "layout"))
    usable = wanted.where((F.col("layout") == F.col("native")) | F.col("may_transcode")).groupBy("tensor").agg(F.min_by("layout", "pos").alias("layout"))
    return tensors.join(usable, "tensor", "left").select("tensor", F.coalesce("layout", "native").alias("chosen"))


def transcode(stored: DataFrame, shape: Sequence[int], source: dict, target: dict) -> DataFrame:
    """Rows (at, v) of one dense layout to (pos, v) of another, in ranges of pos: two projections and one shuffle by range. Padding of the source, outside the shape, is left out."""
    names = [f"i{k}" for k in range(len(shape))]
    cells = stored.select(*(c.alias(n) for n, c in zip(names, address.inverse(source, F.col("at"), shape))), "v")
    for n, size in zip(names, shape):
        cells = cells.where(F.col(n) < size)
    placed = cells.select(address.element_offset(target, [F.col(n) for n in names], shape).alias("pos"), "v")
    return placed.repartitionByRange("pos").sortWithinPartitions("pos")
