"""Partitions, shards and overlays of tensors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def split(cells: DataFrame, extent: Sequence[int]) -> DataFrame:
    """cells with a shard number for each axis and local coordinates l0, l1, ..."""
    out = cells
    for k, n in enumerate(extent):
        out = out.withColumn(f"s{k}", F.call_function("div", F.col(f"i{k}"), F.lit(n))).withColumn(f"l{k}", F.col(f"i{k}") % n)
    return out


def assemble(shards: DataFrame, extent: Sequence[int]) -> DataFrame:
    return shards.select(*((F.col(f"s{k}") * n + F.col(f"l{k}")).alias(f"i{k}") for k, n in enumerate(extent)), "v")


def grid_keys(boxes: DataFrame, rank: int, size: int) -> DataFrame:
    """A row for each grid cell that a box (lo0, hi0, ...; hi exclusive) touches; empty boxes have none."""
    out = boxes.where(reduce(lambda a, b: a & b, (F.col(f"hi{k}") > F.col(f"lo{k}") for k in range(rank))))
    for k in range(rank):
        out = out.withColumn(f"g{k}", F.explode(F.sequence(F.call_function("div", F.col(f"lo{k}"), F.lit(size)), F.call_function("div", F.col(f"hi{k}") - 1, F.lit(size)))))
    return out


#: Ordinals of equal boxes that are compared as one row, and such rows of a grid cell that one task takes on the left side.
BLOCK, SHARE = 1 << 10, 1 << 10


def _blocks(boxes: DataFrame, sides: Sequence[str]) -> DataFrame:
    """(sides, block, ordinals): boxes with extent, equal ones together in blocks of at most BLOCK."""
    w = Window.partitionBy(*sides).orderBy("ordinal")
    block = F.call_function("div", F.row_number().over(w) - 1, F.lit(BLOCK))
    return boxes.select("ordinal", *sides).where("ordinal is not null").withColumn("block", block).groupBy(*sides, "block").agg(F.collect_list("ordinal").alias("ordinals"))


def overlaps(boxes: DataFrame, rank: int, size: int) -> DataFrame:
    """(a, b): pairs of overlapping boxes, a < b by ordinal. Equal boxes are compared once, in blocks. Blocks meet in a common grid cell, an equi-join; each pair of them is
    given by one cell, where the intersection begins, and only then expanded to ordinals. Full cells are dealt to several tasks."""
    spark, keys, sides = boxes.sparkSession, [f"g{k}" for k in range(rank)], [f"{x}{k}" for k in range(rank) for x in ("lo", "hi")]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    some = boxes.where(reduce(lambda a, b: a & b, (F.col(f"hi{k}") > F.col(f"lo{k}") for k in range(rank))))
    rows = grid_keys(_blocks(some, sides), rank, size).withColumn("id", F.struct(*sides, "block"))
    full = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > SHARE)
    rows = rows.join(full, keys, "left").withColumn("__shares", F.coalesce(F.call_function("div", F.col("__n"), F.lit(SHARE)) + 1, F.lit(1)))
    left = rows.withColumn("share", F.pmod(F.xxhash64("id"), F.col("__shares"))).repartition(tasks, *keys, "share").alias("a")
    right = rows.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__shares") - 1))).repartition(tasks, *keys, "share").alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "share"]]
    low = [F.greatest(F.col(f"a.lo{k}"), F.col(f"b.lo{k}")) for k in range(rank)]
    meets = [low[k] < F.least(F.col(f"a.hi{k}"), F.col(f"b.hi{k}")) for k in range(rank)]
    once = [F.call_function("div", low[k], F.lit(size)) == F.col(f"a.g{k}") for k in range(rank)]
    met = left.join(right, [*same, F.col("a.id") <= F.col("b.id"), *meets, *once])
    pairs = met.select((F.col("a.id") == F.col("b.id")).alias("own"), F.explode("a.ordinals").alias("x"), F.col("b.ordinals").alias("ys")).select("own", "x", F.explode("ys").alias("y"))
    return pairs.where((F.col("x") < F.col("y")) | (~F.col("own") & (F.col("x") > F.col("y")))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def locate(points: DataFrame, boxes: DataFrame, rank: int, size: int) -> DataFrame:
    """points with the ordinal of the box that covers them and their local coordinates: an equi-join on the grid, then the exact test."""
    keyed = points.withColumns({f"g{k}": F.call_function("div", F.col(f"i{k}"), F.lit(size)) for k in range(rank)})
    inside = reduce(lambda a, b: a & b, ((F.col(f"i{k}") >= F.col(f"lo{k}")) & (F.col(f"i{k}") < F.col(f"hi{k}")) for k in range(rank)))
    met = keyed.join(grid_keys(boxes, rank, size), [f"g{k}" for k in range(rank)]).where(inside)
    return met.withColumns({f"l{k}": F.col(f"i{k}") - F.col(f"lo{k}") for k in range(rank)}).drop(*(f"{x}{k}" for k in range(rank) for x in ("g", "lo", "hi")))


def overlay_replace(members: DataFrame, coords: Sequence[str]) -> DataFrame:
    """The stored cell of the latest member (highest ordinal) at each coordinate: one aggregation, combined before the shuffle."""
    return members.groupBy(*coords).agg(F.max_by("v", "ordinal").alias("v"))


def overlay_add(members: DataFrame, coords: Sequence[str]) -> DataFrame:
    return members.groupBy(*coords).agg(F.sum(F.col("v").cast("double")).alias("v"))


def coverage(boxes: DataFrame, rank: int) -> DataFrame:
    """Volume of all boxes together; with no overlaps, equal to the parent's if they cover it."""
    return boxes.agg(F.sum(reduce(lambda a, b: a * b, (F.col(f"hi{k}") - F.col(f"lo{k}") for k in range(rank)))).alias("volume"))


def contiguous(frames: DataFrame, by: str) -> DataFrame:
    """(by, ok): whether frames (offset, length) of each group follow one another from 0 without gap or overlap."""
    w = Window.partitionBy(by).orderBy("offset")
    expected = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w), F.lit(0))
    return frames.withColumn("ok", F.col("offset") == expected).groupBy(by).agg(F.min("ok").alias("ok"))


def shard_faults(shards: DataFrame, rank: int, size: int) -> DataFrame:
    """(fault, n) of shards that were sent in parallel (ordinal, element_type, layout, parent, lo0, hi0, ...): they have one parent shape, type and layout, lie within
    the parent, don't overlap, and have its volume together. Empty shards count nowhere. Of no shards, all faults are 0."""
    zero = F.lit(0).cast("long")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), zero)
    product = lambda xs: reduce(lambda a, b: a * b, xs)
    facts = shards.agg(
        (F.greatest(F.count_distinct(F.struct("parent", "element_type", "layout")), F.lit(1)) - 1).cast("long").alias("mixed"),
        count(reduce(lambda a, b: a | b, ((F.col(f"lo{k}") < 0) | (F.col(f"hi{k}") > F.col("parent")[k]) for k in range(rank)))).alias("outside"),
        F.coalesce(F.max(product([F.col("parent")[k] for k in range(rank)])), zero).alias("__whole"),
        F.coalesce(F.sum(product([F.greatest(F.col(f"hi{k}") - F.col(f"lo{k}"), zero) for k in range(rank)])), zero).alias("__parts"),
    )
    facts = facts.withColumn("volume", (F.col("__whole") != F.col("__parts")).cast("long")).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("mixed", "outside", "volume"))), F.array("mixed", "outside", "volume"))).alias("fault", "n"))
    boxes = shards.select("ordinal", *(f"{x}{k}" for k in range(rank) for x in ("lo", "hi")))
    return facts.unionByName(overlaps(boxes, rank, size).agg(F.count("*").alias("n")).select(F.lit("overlap").alias("fault"), "n"))


def resolve_dimensions(tensors: DataFrame, dims: DataFrame) -> DataFrame:
    """tensors (tensor, shape, ...), also of a stream, with null dimensions taken from a static table (tensor, axis, n) that names each once; those it doesn't name stay null."""
    known = dims.groupBy("tensor").agg(F.map_from_entries(F.collect_list(F.struct("axis", "n"))).alias("__known"))  # no more than 64 axes
    shape = F.transform("shape", lambda x, k: F.coalesce(x, F.col("__known")[k]))
    return tensors.join(known, "tensor", "left").withColumn("shape", shape).drop("__known")
