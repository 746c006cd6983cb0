"""COO, CSR, CSC and CSF as relations: build, expand, look up, validate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.operators.prefix import exclusive_sum


def coo(df: DataFrame, coords: Sequence[str], value: str, tasks: int | None = None) -> DataFrame:
    """One cell per coordinate, values summed as doubles: COO forbids duplicates. A single value is kept as it is. Where few rows share a coordinate, summing before the shuffle
    only fills memory: with tasks, rows go straight to so many tasks by coordinate, and with tasks in proportion to rows, none sees more of them as a table grows."""
    names = [f"i{k}" for k in range(len(coords))]
    rows = df.select(*(F.col(c).cast("long").alias(n) for c, n in zip(coords, names)), F.col(value).cast("double").alias("v"))
    rows = rows if tasks is None else rows.repartition(tasks, *names)
    return rows.groupBy(*names).agg(F.sum("v").alias("v"))


def lookup(points: DataFrame, cells: DataFrame, coords: Sequence[str]) -> DataFrame:
    """points with v, an implicit 0 where no cell is stored, and whether one is."""
    return points.join(cells.select(*coords, "v"), list(coords), "left").withColumn("stored", F.col("v").isNotNull()).withColumn("v", F.coalesce("v", F.lit(0.0)))


def pointers(cells: DataFrame, axis: str, size: int) -> DataFrame:
    """(k, ptr) for k in 0..size: where row or column k begins among the stored cells; empty ones included."""
    counts = cells.groupBy(F.col(axis).alias("k")).agg(F.count("*").alias("n"))
    every = cells.sparkSession.range(size + 1).select(F.col("id").alias("k"))
    return exclusive_sum(every.join(counts, "k", "left").fillna({"n": 0}), "k", "n", "ptr").select("k", "ptr")


def positions(cells: DataFrame, major: str, minor: str, size: int) -> DataFrame:
    """cells with pos, their place in compressed order: the row's pointer and the place within the row, so no global sort."""
    ptr = pointers(cells, major, size).withColumnRenamed("k", major)
    within = F.row_number().over(Window.partitionBy(major).orderBy(minor)) - 1
    return cells.withColumn("__w", within).join(ptr, major).withColumn("pos", F.col("ptr") + F.col("__w")).drop("__w", "ptr")


def expand(ptr: DataFrame, stored: DataFrame, major: str, minor: str) -> DataFrame:
    """CSR or CSC components (k, ptr) and (pos, minor, v) back to cells."""
    spans = ptr.alias("a").join(ptr.alias("b"), F.col("b.k") == F.col("a.k") + 1).where(F.col("b.ptr") > F.col("a.ptr"))
    rows = spans.select(F.col("a.k").alias(major), F.explode(F.sequence(F.col("a.ptr"), F.col("b.ptr") - 1)).alias("pos"))
    return rows.join(stored, "pos").select(major, minor, "v")


def csf_levels(cells: DataFrame, order: Sequence[str]) -> DataFrame:
    """(level, parent, coord, node): nodes of each level, numbered in tree order within their level."""
    out = None
    for level in range(len(order)):
        path = list(order[: level + 1])
        nodes = cells.select(*path).distinct()
        first = nodes.withColumn("__w", F.row_number().over(Window.partitionBy(path[0]).orderBy(*path)) - 1)
        sizes = nodes.groupBy(path[0]).agg(F.count("*").alias("n"))
        base = exclusive_sum(sizes, path[0], "n", "base").select(path[0], "base")
        numbered = first.join(base, path[0]).select(*path, (F.col("base") + F.col("__w")).alias("node"))
        row = numbered.select(F.lit(level).alias("level"), F.col(path[-1]).alias("coord"), "node", *(F.col(p) if p in path else F.lit(None).cast("long").alias(p) for p in order))
        out = row if out is None else out.unionByName(row)
    return out


def csf_pos(levels: DataFrame, order: Sequence[str], level: int) -> DataFrame:
    """(parent, first, n): children of each node of the level above, by number."""
    above = levels.where(F.col("level") == level - 1).select(F.col("node").alias("parent"), *order[:level])
    below = levels.where(F.col("level") == level).select("node", *order[:level])
    return above.join(below, list(order[:level])).groupBy("parent").agg(F.min("node").alias("first"), F.count("*").alias("n"))


def duplicates(cells: DataFrame, coords: Sequence[str]) -> DataFrame:
    return cells.groupBy(*coords).agg(F.count("*").alias("n")).where("n > 1")


def out_of_bounds(cells: DataFrame, coords: Sequence[str], shape: Sequence[int]) -> DataFrame:
    bad = F.lit(False)
    for c, n in zip(coords, shape, strict=True):
        bad = bad | (F.col(c) < 0) | (F.col(c) >= n)
    return cells.where(bad)


#: Places of a box that one stored cell or one end of a run makes at most, and places for each task.
RUN, TASK, MOST_TASKS = 1 << 16, 1 << 22, 1 << 12


def densify(cells: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Every coordinate of a rank-2 box, with 0 where nothing is stored. The box itself is never shuffled: it is cut into runs of RUN places in row-major order, and each
    stored cell, as well as the end of each run, makes the places since the one before it."""
    n, total = shape[1], shape[0] * shape[1]
    inside = (F.col("i0") >= 0) & (F.col("i0") < shape[0]) & (F.col("i1") >= 0) & (F.col("i1") < n)
    stored = cells.where(inside).select((F.col("i0").cast("long") * n + F.col("i1")).alias("__p"), "v", F.lit(True).alias("__cell"))
    last = F.least((F.col("id") + 1) * RUN, F.lit(total).cast("long")) - 1
    ends = cells.sparkSession.range(-(-total // RUN)).select(last.alias("__p"), F.lit(None).cast(cells.schema["v"].dataType).alias("v"), F.lit(False).alias("__cell"))
    run = F.call_function("div", F.col("__p"), F.lit(RUN))
    rows = stored.unionByName(ends).withColumn("__run", run).repartition(min(max(-(-total // TASK), 1), MOST_TASKS), "__run")
    before = F.lag("__p").over(Window.partitionBy("__run").orderBy("__p", F.desc("__cell")))
    rows = rows.withColumn("__first", F.coalesce(before + 1, F.col("__run") * RUN)).where((F.col("__first") <= F.col("__p")) | F.col("__cell"))
    places = rows.select("__p", "v", F.explode(F.sequence(F.least("__first", "__p"), "__p")).alias("__q"))
    value = F.when(F.col("__q") == F.col("__p"), F.coalesce("v", F.lit(0.0))).otherwise(F.lit(0.0))
    return places.select(F.call_function("div", F.col("__q"), F.lit(n)).alias("i0"), (F.col("__q") % n).alias("i1"), value.alias("v"))


def sparsify(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("v") != 0)


# --- compressed components alone: lookups, expansion, faults


def spans(ptr: DataFrame, major: str) -> DataFrame:
    """(major, pos): the row or column of each stored position, from pointers (k, ptr)."""
    pairs = ptr.alias("a").join(ptr.alias("b"), F.col("b.k") == F.col("a.k") + 1).where(F.col("b.ptr") > F.col("a.ptr"))
    return pairs.select(F.col("a.k").alias(major), F.explode(F.sequence(F.col("a.ptr"), F.col("b.ptr") - 1)).alias("pos"))


def compressed_lookup(points: DataFrame, ptr: DataFrame, stored: DataFrame, major: str, minor: str) -> DataFrame:
    """points with pos and v of CSR (major i0) or CSC (major i1) components, null where nothing is stored: one equi-join on both coordinates."""
    cells = spans(ptr, major).join(stored, "pos").select(major, minor, "pos", "v")
    return points.join(cells, [major, minor], "left")


def compressed_faults(ptr: DataFrame, stored: DataFrame, minor: str, extent: int) -> DataFrame:
    """(fault, n) of CSR or CSC components: pointers begin at 0, never fall and end at the number of stored values; indices rise within a row and lie in 0..extent - 1. Faults that don't occur have 0."""
    zero = F.lit(0).cast("long")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), zero)
    first = ptr.agg(count((F.col("k") == 0) & (F.col("ptr") != 0)).alias("n")).select(F.lit("start").alias("fault"), "n")
    steps = ptr.alias("a").join(ptr.alias("b"), F.col("b.k") == F.col("a.k") + 1)
    falling = steps.agg(count(F.col("b.ptr") < F.col("a.ptr")).alias("n")).select(F.lit("falling").alias("fault"), "n")
    ends = ptr.agg(F.max_by("ptr", "k").alias("last")).crossJoin(stored.agg(F.count("*").alias("nnz")))  # one row each
    last = ends.select(F.lit("end").alias("fault"), (F.coalesce("last", zero) != F.col("nnz")).cast("long").alias("n"))
    before = F.lag(minor).over(Window.partitionBy("__row").orderBy("pos"))
    rows = spans(ptr, "__row").join(stored, "pos").withColumn("__before", before)
    order = rows.agg(count(F.col("__before") >= F.col(minor)).alias("n")).select(F.lit("order").alias("fault"), "n")
    outside = stored.agg(count((F.col(minor) < 0) | (F.col(minor) >= extent)).alias("n")).select(F.lit("bounds").alias("fault"), "n")
    return first.unionByName(falling).unionByName(last).unionByName(order).unionByName(outside)


def csf_components(levels: DataFrame, order: Sequence[str]) -> DataFrame:
    """(level, parent, node, coord): the tree alone, without the coordinates above; roots have parent 0."""
    out = levels.where("level = 0").select("level", F.lit(0).cast("long").alias("parent"), F.col("node").cast("long").alias("node"), "coord")
    for k in range(1, len(order)):
        path = list(order[:k])
        above = levels.where(F.col("level") == k - 1).select(F.col("node").cast("long").alias("parent"), *path)
        below = levels.where(F.col("level") == k).select("level", F.col("node").cast("long").alias("node"), "coord", *path)
        out = out.unionByName(below.join(above, path).select("level", "parent", "node", "coord"))
    return out


def csf_expand(tree: DataFrame, values: DataFrame, order: Sequence[str]) -> DataFrame:
    """Components (level, parent, node, coord) and values (pos, v) to cells, in any order of the modes: one join for each level, from the leaves up."""
    last = len(order) - 1
    rows = tree.where(F.col("level") == last).select(F.col("node").alias("pos"), F.col("parent").alias("__at"), F.col("coord").alias(order[last]))
    for k in range(last - 1, -1, -1):
        up = tree.where(F.col("level") == k).select(F.col("node").alias("__at"), F.col("parent").alias("__up"), F.col("coord").alias(order[k]))
        rows = rows.join(up, "__at").drop("__at").withColumnRenamed("__up", "__at")
    return rows.join(values, "pos").select(*sorted(order), "pos", "v")


def csf_find(points: DataFrame, tree: DataFrame, order: Sequence[str]) -> DataFrame:
    """points with pos, the place of their value, or null: one join for each level, from the root down, in any order of the modes."""
    rows = points.withColumn("__at", F.lit(0).cast("long"))
    for k, name in enumerate(order):
        down = tree.where(F.col("level") == k).select(F.col("parent").alias("__at"), F.col("coord").alias(name), F.col("node").alias("__next"))
        rows = rows.join(down, ["__at", name], "left").drop("__at").withColumnRenamed("__next", "__at")
    return rows.withColumnRenamed("__at", "pos")


def csf_faults(tree: DataFrame, order: Sequence[str], shape: Sequence[int]) -> DataFrame:
    """(level, fault, n), n above 0: nodes numbered from 0 without gap, coordinates within the shape and rising among siblings, parents that exist and have a child."""
    out = None
    for k, name in enumerate(order):
        nodes = tree.where(F.col("level") == k)
        extent = shape[int(name.removeprefix("i"))]
        before = F.lag("coord").over(Window.partitionBy("parent").orderBy("node"))
        count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
        parts = [
            nodes.withColumn("__b", before).agg(count(F.col("__b") >= F.col("coord")).alias("n")).select(F.lit("order").alias("fault"), "n"),
            nodes.agg(count((F.col("coord") < 0) | (F.col("coord") >= extent)).alias("n")).select(F.lit("bounds").alias("fault"), "n"),
            nodes.agg((F.coalesce(F.max("node") + 1, F.lit(0)) != F.count_distinct("node")).cast("long").alias("n")).select(F.lit("numbers").alias("fault"), "n"),
        ]
        if k:
            above = tree.where(F.col("level") == k - 1).select(F.col("node").alias("parent"))
            parts.append(nodes.join(above, "parent", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphans").alias("fault"), "n"))
            parts.append(above.join(nodes.select("parent"), "parent", "left_anti").agg(F.count("*").alias("n")).select(F.lit("childless").alias("fault"), "n"))
        for part in parts:
            row = part.where("n > 0").select(F.lit(k).alias("level"), "fault", "n")
            out = row if out is None else out.unionByName(row)
    return out
