"""Element types, and decoding of codes of fewer than 16 bits, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Name, tag, tier, bits, kind (f float, i signed, u unsigned, b bool, c complex).
TYPES = [
    ("float16", 0x01, 1, 16, "f"),
    ("bfloat16", 0x02, 1, 16, "f"),
    ("float32", 0x03, 1, 32, "f"),
    ("float64", 0x04, 1, 64, "f"),
    ("int8", 0x10, 1, 8, "i"),
    ("uint8", 0x11, 1, 8, "u"),
    ("int16", 0x12, 1, 16, "i"),
    ("uint16", 0x13, 1, 16, "u"),
    ("int32", 0x14, 1, 32, "i"),
    ("uint32", 0x15, 1, 32, "u"),
    ("int64", 0x16, 1, 64, "i"),
    ("uint64", 0x17, 1, 64, "u"),
    ("bool", 0x20, 1, 1, "b"),
    ("float8_e4m3", 0x40, 2, 8, "f"),
    ("float8_e5m2", 0x41, 2, 8, "f"),
    ("float8_e8m0", 0x42, 2, 8, "f"),
    ("float4_e2m1", 0x43, 2, 4, "f"),
    ("float6_e2m3", 0x44, 2, 6, "f"),
    ("float6_e3m2", 0x45, 2, 6, "f"),
    ("float128", 0x46, 2, 128, "f"),
    ("int4", 0x48, 2, 4, "i"),
    ("uint4", 0x49, 2, 4, "u"),
    ("int2", 0x4A, 2, 2, "i"),
    ("uint2", 0x4B, 2, 2, "u"),
    ("complex64", 0x50, 2, 64, "c"),
    ("complex128", 0x51, 2, 128, "c"),
]
BITS = {name: bits for name, _, _, bits, _ in TYPES}
TAGS = {name: tag for name, tag, _, _, _ in TYPES}
NAMES = {tag: name for name, tag, _, _, _ in TYPES}
#: Exponent bits, mantissa bits, bias, whether there are infinities, whether there are NaNs.
MICRO = {"float8_e4m3": (4, 3, 7, False, True), "float8_e5m2": (5, 2, 15, True, True), "float4_e2m1": (2, 1, 1, False, False), "float6_e2m3": (2, 3, 1, False, False), "float6_e3m2": (3, 2, 3, False, False)}


def element_types(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{n}', {tag}, {tier}, {bits}, '{kind}')" for n, tag, tier, bits, kind in TYPES)
    df = spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, tag, tier, bits, kind)")
    return df.select("name", "tag", "tier", "bits", (F.col("bits") < 8).alias("is_sub_byte"), (F.col("kind") == "f").alias("is_float"), F.col("kind").isin("i", "u").alias("is_integer"), F.col("kind").isin("f", "i", "c").alias("is_signed"))


def micro_value(code: int, name: str) -> float:
    e_bits, m_bits, bias, inf, nan = MICRO[name]
    sign = -1.0 if code >> (e_bits + m_bits) & 1 else 1.0
    e, m = code >> m_bits & ((1 << e_bits) - 1), code & ((1 << m_bits) - 1)
    top = (1 << e_bits) - 1
    if inf and e == top:
        return sign * math.inf if m == 0 else math.nan
    if nan and not inf and e == top and m == (1 << m_bits) - 1:
        return math.nan
    return sign * (m / (1 << m_bits) * 2.0 ** (1 - bias) if e == 0 else (1 + m / (1 << m_bits)) * 2.0 ** (e - bias))


def decode_micro(code: Column, name: str) -> Column:
    """A table of all codes as a literal array."""
    e, m = MICRO[name][:2]
    table = F.array(*(F.lit(micro_value(c, name)) for c in range(1 << (1 + e + m))))
    return F.element_at(table, (code + 1).cast("int")).cast("float")


def decode_e8m0(code: Column) -> Column:
    """2 ** (code - 127); the codes 0 and 255 are reserved."""
    return F.when(code.isin(0, 255), F.lit(float("nan"))).otherwise(F.pow(F.lit(2.0), code - 127))


def unpack(byte: Column, bits: int, signed: bool) -> list[Column]:
    """Elements of one byte, lowest bits first."""
    out = [F.shiftright(byte.cast("int"), k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(0, 8, bits)]
    return [F.when(x >= 1 << (bits - 1), x - (1 << bits)).otherwise(x) for x in out] if signed else out


def decode_half(code: Column, kind: str) -> Column:
    """float16 or bfloat16 codes (0 to 65535)."""
    e_bits, m_bits, bias = (5, 10, 15) if kind == "float16" else (8, 7, 127)
    sign = F.when(F.shiftright(code, 15) == 1, -1.0).otherwise(1.0)
    e, m = F.shiftright(code, m_bits).bitwiseAND(F.lit((1 << e_bits) - 1)), code.bitwiseAND(F.lit((1 << m_bits) - 1)) / float(1 << m_bits)
    top = (1 << e_bits) - 1
    value = F.when(e == 0, m * 2.0 ** (1 - bias)).when((e == top) & (m == 0), F.lit(math.inf)).when(e == top, F.lit(math.nan)).otherwise((1 + m) * F.pow(F.lit(2.0), e - bias))
    return sign * value
