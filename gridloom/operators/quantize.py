"""Five quantization schemes over cells (i0, i1, v): calibration, codes, and values in 32-bit floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.elements import decode_e8m0, decode_micro, micro_value

# The sixteen NF4 levels, by code.
NF4 = [-1.0, -0.6961928009986877, -0.5250730514526367, -0.39491748809814453, -0.28444138169288635, -0.18477343022823334, -0.09105003625154495, 0.0, 0.07958029955625534, 0.16093020141124725, 0.24611230194568634, 0.33791524171829224, 0.44070982933044434, 0.5626170039176941, 0.7229568362236023, 1.0]
FP4 = [micro_value(c, "float4_e2m1") for c in range(16)]


def affine(scale: Column, q: Column, zero: Column | int = 0) -> Column:
    """scale * (q - zero): integer difference, 32-bit product."""
    return (scale.cast("float") * (q.cast("int") - zero).cast("float")).cast("float")


def symmetric(df: DataFrame, by: list[str | Column], levels: int = 127) -> DataFrame:
    """Codes in -levels..levels; one scale for each group, the largest magnitude over levels. Groups of a whole tensor or channel are aggregated and joined back, so that none is collected in one task."""
    keys = [f"__k{j}" for j in range(len(by))]
    rows = df.withColumns({k: F.col(b) if isinstance(b, str) else b for k, b in zip(keys, by)}) if keys else df
    most = rows.groupBy(*keys).agg((F.max(F.abs("v")).cast("double") / levels).alias("scale"))
    rows = rows.join(most, keys) if keys else rows.crossJoin(F.broadcast(most))  # one row
    q = F.when(F.col("scale") == 0, 0).otherwise(F.greatest(F.lit(-levels), F.least(F.lit(levels), F.rint(F.col("v").cast("double") / F.col("scale")).cast("int"))))
    return rows.withColumn("q", q).withColumn("x", affine(F.col("scale"), F.col("q"))).drop(*keys)


def per_tensor(df: DataFrame) -> DataFrame:
    return symmetric(df, [])


def per_channel(df: DataFrame, axis: str) -> DataFrame:
    return symmetric(df, [axis])


def block_of(axis: str, size: int) -> Column:
    return F.call_function("div", F.col(axis), F.lit(size))


def per_block(df: DataFrame, axis: str, outer: list[str], size: int) -> DataFrame:
    """Blocks are small: a window over each block, one shuffle."""
    window = Window.partitionBy(*outer, block_of(axis, size))
    rows = df.withColumn("scale", F.max(F.abs("v")).over(window).cast("double") / 127)
    q = F.when(F.col("scale") == 0, 0).otherwise(F.rint(F.col("v").cast("double") / F.col("scale")).cast("int"))
    return rows.withColumn("q", q).withColumn("x", affine(F.col("scale"), F.col("q")))


def nearest(value: Column, table: list[float]) -> Column:
    """The code of the nearest level; the lower code in a tie."""
    out = F.array_min(F.array(*(F.struct(F.abs(value - F.lit(x)).alias("d"), F.lit(k).alias("k")) for k, x in enumerate(table))))
    return out["k"]


def nf4(df: DataFrame, axis: str, outer: list[str], size: int) -> DataFrame:
    window = Window.partitionBy(*outer, block_of(axis, size))
    rows = df.withColumn("absmax", F.max(F.abs("v")).over(window).cast("double"))
    rows = rows.withColumn("q", F.when(F.col("absmax") == 0, 7).otherwise(nearest(F.col("v").cast("double") / F.col("absmax"), NF4)))
    level = F.element_at(F.array(*(F.lit(x) for x in NF4)), F.col("q") + 1)
    return rows.withColumn("x", (F.col("absmax").cast("float") * level.cast("float")).cast("float"))


def mxfp4(df: DataFrame, axis: str, outer: list[str], size: int = 32) -> DataFrame:
    """Shared power-of-two scale of each whole block; elements are 4-bit floats with up to 6.0."""
    window = Window.partitionBy(*outer, block_of(axis, size))
    rows = df.withColumn("absmax", F.max(F.abs("v")).over(window).cast("double"))
    e = F.when(F.col("absmax") == 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(254), F.floor(F.log2("absmax")).cast("int") - 2 + 127)))
    rows = rows.withColumn("e", e).withColumn("scale", F.pow(F.lit(2.0), F.col("e") - 127))
    rows = rows.withColumn("q", nearest(F.col("v").cast("double") / F.col("scale"), FP4))
    return rows.withColumn("x", (F.col("scale").cast("float") * F.element_at(F.array(*(F.lit(x) for x in FP4)), F.col("q") + 1).cast("float")).cast("float"))


# --- values from stored codes and stored parameters


def with_zero(df: DataFrame, by: list[str | Column]) -> DataFrame:
    """Codes 0 to 255 with a scale and a zero point for each group, from its least and greatest value and 0; aggregated and joined back."""
    keys = [f"__k{j}" for j in range(len(by))]
    rows = df.withColumns({k: F.col(b) if isinstance(b, str) else b for k, b in zip(keys, by)})
    v = F.col("v").cast("double")
    ends = rows.groupBy(*keys).agg(F.least(F.min(v), F.lit(0.0)).alias("__lo"), F.greatest(F.max(v), F.lit(0.0)).alias("__hi"))
    scale = (F.col("__hi") - F.col("__lo")) / 255
    ends = ends.withColumn("scale", F.when(scale == 0, 1.0).otherwise(scale)).withColumn("zero", F.rint(-F.col("__lo") / F.col("scale")).cast("int"))
    rows = rows.join(ends.drop("__lo", "__hi"), keys)
    q = F.greatest(F.lit(0), F.least(F.lit(255), (F.rint(F.col("v").cast("double") / F.col("scale")) + F.col("zero")).cast("int")))
    return rows.withColumn("q", q).drop(*keys)


def dequantize(codes: DataFrame, params: DataFrame, scheme: str, keys: list[str], kind: str = "int8") -> DataFrame:
    """codes (keys, q, ...) with x, their value, by the stored parameters of their channel or block (keys): (scale, zero) of affine schemes, where a null zero is 0;
    (absmax) of nf4; (e), a byte of the shared power of two, of mxfp, whose codes are of the type kind. An equi-join, so a small table of parameters is broadcast by its
    size. A code without parameters, or a null one, has a null value; a reserved e gives NaN. For a whole tensor, keys is empty and params has one row."""
    rows = codes.join(params, keys, "left") if keys else codes.crossJoin(F.broadcast(params.limit(1)))  # one row
    if scheme in ("per_tensor", "per_channel", "per_block"):
        return rows.withColumn("x", affine(F.col("scale"), F.col("q"), F.coalesce(F.col("zero"), F.lit(0)))).drop("scale", "zero")
    if scheme == "nf4":
        level = F.element_at(F.array(*(F.lit(x) for x in NF4)), F.col("q") + 1).cast("float")
        return rows.withColumn("x", (F.col("absmax").cast("float") * level).cast("float")).drop("absmax")
    if scheme != "mxfp":
        raise ValueError(f"scheme {scheme}")
    value = F.col("q").cast("float") if kind in ("int8", "int4") else decode_micro(F.col("q"), kind)
    return rows.withColumn("x", (decode_e8m0(F.col("e")).cast("float") * value).cast("float")).drop("e")


def reserved_scales(params: DataFrame) -> DataFrame:
    """Rows whose shared power of two is one of the two reserved bytes."""
    return params.where(F.col("e").isin(0, 255))
