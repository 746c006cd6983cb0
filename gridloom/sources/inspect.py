"""Bytes of a descriptor, field by field."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession

from gridloom.sources.descriptor import decode, encode_layout


def fields(code: bytes) -> list[tuple[int, str, str]]:
    """(offset, bytes in hex, field): the fixed header, the dimensions, and the rest by section."""
    d, end = decode(code)
    rank, out, at = len(d["shape"]), [], 0

    def take(n: int, what: str) -> None:
        nonlocal at
        if n:
            out.append((at, code[at : at + n].hex(" "), what))
        at += n

    for n, what in ((4, "magic"), (1, "version_major = 1"), (1, f"version_minor = {code[5]}"), (4, f"descriptor_length = {end}"), (4, f"flags = {struct.unpack_from('<I', code, 10)[0]:#010x}"), (1, f"type = {d['type']}"), (1, f"layout = {d['layout']['kind']}"), (4, f"rank = {rank}")):
        take(n, what)
    for k, n in enumerate(d["shape"]):
        take(8, f"shape[{k}] = {'dynamic' if n is None else n}")
    take(8, f"byte_offset = {d['byte_offset']}")
    take(len(encode_layout(d["layout"], rank)), f"layout fields {({k: v for k, v in d['layout'].items() if k != 'kind'})}")
    take(1, f"buffer_count = {len(d['buffers'])}")
    for k, b in enumerate(d["buffers"]):
        take(8, f"buffer[{k}].byte_size = {b['byte_size']}")
        take(4, f"buffer[{k}].alignment = {b['alignment']}")
        take(4, f"buffer[{k}] device {b['device']}, sync {b['sync']}, memory {b['memory']}")
    for name, size in (("quantization", 4 + len(d.get("quantization", b""))), ("shard", 16 * rank), ("statistics", 72), ("extension", 20), ("member", 16)):
        if name in d:
            take(size, name)
    return out


def inspect(spark: SparkSession, code: bytes) -> DataFrame:
    return spark.createDataFrame(fields(code), "offset long, bytes_hex string, field string")
