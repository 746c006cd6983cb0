"""Quantization descriptors of the five schemes, as dictionaries and bytes."""

from __future__ import annotations

import math
import struct

from gridloom.functions.elements import BITS
from gridloom.sources.descriptor import NONE32, Cursor, need

# Fixed values of the format.
SCHEMES = {"per_tensor": 1, "per_channel": 2, "per_block": 3, "nf4": 4, "mxfp": 5}
INTEGERS = ["int8", "uint8", "int4", "uint4", "int2", "uint2"]
STORAGE = {
    "per_tensor": ["int8", "uint8", "int16", "uint16", "int32", "int4", "uint4", "int2", "uint2"],
    "per_channel": ["int8", "uint8", "int16", "uint16", "int4", "uint4", "int2", "uint2"],
    "per_block": INTEGERS,
    "nf4": ["uint4"],
    "mxfp": ["float8_e4m3", "float8_e5m2", "float4_e2m1", "float6_e2m3", "float6_e3m2", "int8", "int4"],
}
SCALE_TAGS = {"float16": 1, "bfloat16": 2, "float32": 3}
BLOCKS = {"per_block": (2, 1 << 31), "nf4": (8, 1 << 31), "mxfp": (16, 2048)}


def check(q: dict) -> None:
    kind = q["scheme"]
    need(kind in SCHEMES, "scheme")
    if kind == "per_tensor":
        need(math.isfinite(q["scale"]) and q["scale"] != 0, "the scale is finite and not zero")
    if kind in BLOCKS:
        low, high = BLOCKS[kind]
        need(low <= q["block_size"] <= high and q["block_size"] & (q["block_size"] - 1) == 0, "block size")
    if kind == "per_channel":
        need(q.get("scale_type", "float32") == "float32", "scales of channels are float32")


def encode(q: dict) -> bytes:
    check(q)
    kind, zero = q["scheme"], q.get("zero_buffer")
    head = struct.pack("<BBH", SCHEMES[kind], 1, int(kind in ("per_channel", "per_block") and zero is None))
    if kind == "per_tensor":
        return head + struct.pack("<fi4x", q["scale"], q.get("zero_point", 0))
    if kind == "per_channel":
        return head + struct.pack("<IIIB3x", q["axis"], q["scale_buffer"], NONE32 if zero is None else zero, SCALE_TAGS["float32"])
    if kind == "per_block":
        return head + struct.pack("<IIIIB3x", q["axis"], q["block_size"], q["scale_buffer"], NONE32 if zero is None else zero, SCALE_TAGS[q.get("scale_type", "float32")])
    return head + struct.pack("<III", q["axis"], q["block_size"], q["scale_buffer"])


def decode(data: bytes) -> dict:
    c = Cursor(data)
    tag, version, flags = c.take("BBH")
    names = {v: k for k, v in SCHEMES.items()}
    need(tag in names and version == 1, "scheme or version")
    kind = names[tag]
    need(flags <= int(kind in ("per_channel", "per_block")), "flags")
    q: dict = {"scheme": kind}
    if kind == "per_tensor":
        q |= dict(zip(("scale", "zero_point"), c.take("fi")))
        c.zeros(4)
    else:
        q["axis"] = c.one("I")
        if kind != "per_channel":
            q["block_size"] = c.one("I")
        q["scale_buffer"] = c.one("I")
        if kind in ("per_channel", "per_block"):
            zero, scale = c.take("IB")
            c.zeros(3)
            need((zero == NONE32) == bool(flags), "a symmetric scheme has no zero points")
            need(scale in SCALE_TAGS.values(), "type of the scales")
            q |= {"zero_buffer": None if flags else zero, "scale_type": {v: k for k, v in SCALE_TAGS.items()}[scale]}
    need(c.at == len(data), "length")
    check(q)
    return q


def blocks_per_axis(q: dict, shape: list[int]) -> int:
    n, size = shape[q["axis"]], q["block_size"]
    need(q["scheme"] != "mxfp" or n % size == 0, "blocks must be whole")
    need(n == 0 or size <= n, "a block is longer than its axis")
    return -(-n // size)


def check_against(q: dict, d: dict) -> None:
    """A scheme against its tensor's descriptor: storage type, axis, blocks, zero point, and where its parameters lie."""
    need(d["type"] in STORAGE[q["scheme"]], f"{d['type']} can't hold {q['scheme']} codes")
    if "axis" in q:
        need(q["axis"] < len(d["shape"]) and d["shape"][q["axis"]] is not None, "axis")
    paged = d["layout"]["kind"] == "paged"
    if "block_size" in q and not paged:
        blocks_per_axis(q, d["shape"])
    if paged:
        need(q["scheme"] != "per_channel" or q["axis"] != 0, "channels can't run along pages")
        need(q["scheme"] != "per_block" or (q["axis"] == 0 and q["block_size"] == d["layout"]["page_size"]), "blocks of pages are pages")
    if q["scheme"] == "per_tensor":
        bits = BITS[d["type"]]
        low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if d["type"].startswith("int") else (0, (1 << bits) - 1)
        need(low <= q["zero_point"] <= high, "zero point")
    data = d["buffers"][0]
    for at in (q.get("scale_buffer"), q.get("zero_buffer")):
        if at is not None:
            need(0 < at < len(d["buffers"]), "parameters have a buffer of their own")
            need(d["buffers"][at]["device"] == data["device"], "parameters lie on the data's device")


def colocated(buffers: list[dict]) -> bool:
    return len({(b.get("device", 0), b.get("memory", 0)) for b in buffers}) <= 1
