"""Buffers to cells and back: bulk decoding in Arrow batches, and arrays of the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.address import row_major_inverse
from gridloom.functions.elements import BITS, MICRO, micro_value

WIDE = {"float16": "<f2", "float32": "<f4", "float64": "<f8", "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "int64": "<i8", "uint64": "<u8", "complex64": "<c8", "complex128": "<c16"}


def decode_bytes(data: bytes, kind: str) -> np.ndarray:
    """All elements of a buffer, as numbers; codes of fewer than eight bits lie lowest first."""
    if kind in WIDE:
        return np.frombuffer(data, WIDE[kind], len(data) // np.dtype(WIDE[kind]).itemsize)
    raw = np.frombuffer(data, np.uint8)
    if kind == "bfloat16":
        return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
    if kind == "float8_e8m0":
        return np.where((raw == 0) | (raw == 255), np.nan, 2.0 ** (raw.astype(float) - 127))
    bits = BITS[kind]
    if bits > 8:
        raise ValueError(f"{kind} has no array type here")
    if bits == 8:
        codes = raw
    else:
        flat = np.unpackbits(raw, bitorder="little")
        flat = flat[: len(flat) // bits * bits].reshape(-1, bits)
        codes = (flat * (1 << np.arange(bits))).sum(1)
    if kind in MICRO:
        return np.array([micro_value(c, kind) for c in range(1 << bits)])[codes]
    if kind in ("int4", "int2"):
        return np.where(codes >= 1 << (bits - 1), codes - (1 << bits), codes)
    return codes


def encode_values(values: np.ndarray, kind: str) -> bytes:
    """Numbers to a buffer; integers are rounded half to even and held within their range."""
    if kind in WIDE and kind.startswith("float"):
        return np.asarray(values).astype(WIDE[kind]).tobytes()
    bits = BITS[kind]
    signed = kind.startswith("int")
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    whole = values if np.asarray(values).dtype.kind in "iu" else np.rint(np.nan_to_num(values))
    whole = np.clip(whole, low, high)
    if bits >= 8:
        return whole.astype(WIDE[kind]).tobytes()
    codes = whole.astype(np.int64) & ((1 << bits) - 1)
    flat = (codes[:, None] >> np.arange(bits) & 1).astype(np.uint8).ravel()
    return np.packbits(flat, bitorder="little").tobytes()


def payload_cells(payload: DataFrame, kind: str, shape: Sequence[int]) -> DataFrame:
    """Row-major payload chunks (chunk_offset, bytes) to cells i0, i1, ..., v: numpy decodes a chunk at once, the plan does the rest. Chunks begin at whole bytes of whole elements."""
    bits = BITS[kind]
    total = int(np.prod(shape, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = decode_bytes(data, kind).astype(float)
                first = at * 8 // bits
                v = v[: max(0, total - first)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(v))), pa.array(v)], ["p", "v"])

    rows = payload.select("chunk_offset", "bytes").mapInArrow(run, "p long, v double")
    return rows.select(*(c.alias(f"i{k}") for k, c in enumerate(row_major_inverse(F.col("p"), shape))), "v")


def from_numpy(spark: SparkSession, a: np.ndarray) -> DataFrame:
    """An array of the driver to cells."""
    idx = np.indices(a.shape).reshape(a.ndim, -1)
    return spark.createDataFrame(pa.table({**{f"i{k}": idx[k] for k in range(a.ndim)}, "v": np.ascontiguousarray(a).ravel()}))


def to_numpy(cells: DataFrame, shape: Sequence[int], dtype=float) -> np.ndarray:
    """Cells to an array of the driver, with 0 where none is stored."""
    t = cells.toArrow()
    out = np.zeros(shape, dtype)
    out[tuple(t.column(f"i{k}").to_numpy() for k in range(len(shape)))] = t.column("v").to_numpy()
    return out


def from_compressed(spark: SparkSession, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, by_row: bool = True) -> DataFrame:
    """CSR or CSC component arrays of the driver to cells."""
    major = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    i, j = (major, indices) if by_row else (indices, major)
    return spark.createDataFrame(pa.table({"i0": np.asarray(i, np.int64), "i1": np.asarray(j, np.int64), "v": np.asarray(values)}))


def preview(cells: DataFrame, shape: Sequence[int], threshold: int = 1000, edge: int = 3) -> str:
    """Text of a small array; of a large one, its first and last elements in row-major order."""
    position = sum((F.col(f"i{k}") * int(np.prod(shape[k + 1 :], dtype=np.int64)) for k in range(len(shape))), F.lit(0))
    total = int(np.prod(shape, dtype=np.int64))
    if total <= threshold:
        return str(to_numpy(cells, shape))
    ends = cells.withColumn("__p", position).where((F.col("__p") < edge) | (F.col("__p") >= total - edge)).orderBy("__p").collect()
    text = [str(r["v"]) for r in ends]
    return f"[{' '.join(text[:edge])} ... {' '.join(text[edge:])}]"
