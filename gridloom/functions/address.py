"""Element positions as column expressions: coordinates to positions, and back.

Builders return signed positions; integer overflow raises under ANSI mode. Layouts with
bit arithmetic are unrolled while the plan is built, so that whole-stage code generation covers them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce
from operator import add, mul

from pyspark.sql import Column, functions as F

Dim = int | Column


def _lit(x: Dim) -> Column:
    return x if isinstance(x, Column) else F.lit(int(x)).cast("long")


def _dot(idx: Sequence[Column], strides: Sequence[Dim]) -> Column:
    return reduce(add, (i * _lit(s) for i, s in zip(idx, strides, strict=True)), F.lit(0).cast("long"))


def row_strides(shape: Sequence[Dim]) -> list[Dim]:
    return [reduce(mul, map(_lit, shape[k + 1 :]), _lit(1)) for k in range(len(shape))]


def col_strides(shape: Sequence[Dim]) -> list[Dim]:
    return [reduce(mul, map(_lit, shape[:k]), _lit(1)) for k in range(len(shape))]


def row_major(idx: Sequence[Column], shape: Sequence[Dim]) -> Column:
    return _dot(idx, row_strides(shape))


def col_major(idx: Sequence[Column], shape: Sequence[Dim]) -> Column:
    return _dot(idx, col_strides(shape))


def strided(idx: Sequence[Column], strides: Sequence[Dim]) -> Column:
    """Strides may be negative, or zero for a broadcast dimension."""
    return _dot(idx, strides)


def strided_extent(shape: Sequence[int], strides: Sequence[int]) -> int:
    """Elements between the least and the greatest position, both included."""
    if 0 in shape:
        return 0
    reach = [(n - 1) * s for n, s in zip(shape, strides, strict=True)]
    return sum(max(r, 0) for r in reach) - sum(min(r, 0) for r in reach) + 1


def div(a: Column, b: Dim) -> Column:
    """Floor division of non-negative numbers."""
    return F.call_function("div", a, _lit(b))


def tiled(idx: Sequence[Column], shape: Sequence[Dim], tile: Sequence[int], outer="row", inner="row") -> Column:
    """outer: "row", "col" or strides in tiles; inner: those, strides within a tile, or (tile, inner) for nested tiles."""
    grid = [div(_lit(n) + (t - 1), t) for n, t in zip(shape, tile, strict=True)]
    at, within = [div(i, t) for i, t in zip(idx, tile)], [i % t for i, t in zip(idx, tile)]
    number = _place(at, grid, outer)
    if isinstance(inner, tuple):
        intra = tiled(within, tile, inner[0], "row", inner[1])
        size = _padded(tile, inner)
    else:
        intra, size = _place(within, tile, inner), reduce(mul, tile, 1)
    return number * size + intra


def _padded(tile: Sequence[int], inner) -> int:
    """Positions of one tile, with the padding of the tiles inside it."""
    if not isinstance(inner, tuple):
        return reduce(mul, tile, 1)
    return reduce(mul, (-(-n // t) for n, t in zip(tile, inner[0])), 1) * _padded(inner[0], inner[1])


def _place(idx: Sequence[Column], shape: Sequence[Dim], order) -> Column:
    if order == "row":
        return row_major(idx, shape)
    return col_major(idx, shape) if order == "col" else strided(idx, order)


def row_major_inverse(position: Column, shape: Sequence[Dim]) -> list[Column]:
    return [div(position, s) % _lit(n) for s, n in zip(row_strides(shape), shape)]


def tiled_inverse(position: Column, shape: Sequence[Dim], tile: Sequence[int]) -> list[Column]:
    size = reduce(mul, tile, 1)
    grid = [div(_lit(n) + (t - 1), t) for n, t in zip(shape, tile)]
    at, within = row_major_inverse(div(position, size), grid), row_major_inverse(position % size, tile)
    return [a * t + w for a, t, w in zip(at, tile, within)]


def _bit(x: Column, b: int) -> Column:
    return F.shiftright(x, b).bitwiseAND(F.lit(1).cast("long"))


def _or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def morton(idx: Sequence[Column], bits: Sequence[int]) -> Column:
    """Bit b of dimension d goes to bit b * rank + d; dimensions with fewer bits leave gaps."""
    return _or([F.shiftleft(_bit(x.cast("long"), b), b * len(idx) + d) for d, x in enumerate(idx) for b in range(bits[d])])


def morton_inverse(code: Column, bits: Sequence[int]) -> list[Column]:
    r = len(bits)
    return [_or([F.shiftleft(_bit(code, b * r + d), b) for b in range(n)]) for d, n in enumerate(bits)]


#: Levels of the Hilbert curve that one look into a table takes. Of other ranks, the table would be too large.
STEP = {1: 4, 2: 4, 3: 2}


@cache
def _curve(rank: int) -> tuple[str, str, list[int]]:
    """The curve as an automaton. What the levels above do to a cube is one of few states: a permutation of the dimensions, a reflection of each, and a parity. Entry
    (state, digit) of a table is (next state, digit put out), each as state << width | digit: from STEP bits of each dimension, side by side, to those of the code in the first
    table, and back in the second. Then the states after 0, 1, ... levels of zeros, which lead back to the first one after as many levels as there are dimensions."""
    k, width = STEP[rank], STEP[rank] * rank

    def level(state, bits):
        (perm, flip, parity), gray, digit = state, 0, 0
        perm, flip = list(perm), list(flip)
        now = [bits[perm[d]] ^ flip[d] for d in range(rank)]
        for d in range(rank):
            if now[d]:
                flip[0] ^= 1
            else:
                perm[0], perm[d], flip[0], flip[d] = perm[d], perm[0], flip[d], flip[0]
            gray ^= now[d]
            digit = digit << 1 | (gray ^ parity)
        return (tuple(perm), tuple(flip), parity ^ gray), digit

    first = tuple(range(rank)), (0,) * rank, 0
    zeros = [first]
    for _ in range(rank - 1):
        zeros.append(level(zeros[-1], (0,) * rank)[0])
    found = list(dict.fromkeys(zeros))
    number, to, back = {s: n for n, s in enumerate(found)}, [], []
    for state in found:  # grows
        row, inverse = [0] * (1 << width), [0] * (1 << width)
        for raw in range(1 << width):
            at, code = state, 0
            for b in range(k - 1, -1, -1):
                at, digit = level(at, [raw >> (rank - 1 - d) * k + b & 1 for d in range(rank)])
                code = code << rank | digit
            if at not in number:
                number[at] = len(found)
                found.append(at)
            row[raw], inverse[code] = number[at] << width | code, number[at] << width | raw
        to += row
        back += inverse
    return ",".join(map(str, to)), ",".join(map(str, back)), [number[s] << width for s in zeros]


def _through(df, table: str, digits: list, start: int, width: int):
    """df with columns __h0, __h1, ... of entries of the table, one for each digit; each reads the one before it."""
    at, table = F.lit(start).cast("long"), F.split(F.lit(table), ",").cast("array<bigint>")  # folded while the plan is optimised
    for n, digit in enumerate(digits):
        df = df.withColumn(f"__h{n}", F.get(table, at.bitwiseOR(digit)))
        at = F.col(f"__h{n}").bitwiseAND(F.lit(-1 << width).cast("long"))
    return df


def _bits(x: Column, low: int, n: int) -> Column:
    return F.shiftright(x, low).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def hilbert(df, idx: Sequence[str], order: int, into: str):
    """df with the position on the Hilbert curve, of the lowest bits of each coordinate, as many as the order. Up to rank 3, a few levels at once through a table."""
    r = len(idx)
    if r not in STEP:
        return _hilbert_turns(df, idx, order, into)
    k, (table, _, zeros), x = STEP[r], _curve(r), [F.col(c).cast("long") for c in idx]
    lows = list(range(0, order, k))[::-1]
    digits = [_or([F.shiftleft(_bits(c, low, min(k, order - low)), (r - 1 - d) * k) for d, c in enumerate(x)]) for low in lows]
    df = _through(df, table, digits, zeros[order % -k % r], r * k)  # levels that are missing in the first digit are zeros
    return df.withColumn(into, _or([F.shiftleft(_bits(F.col(f"__h{n}"), 0, r * k), low * r) for n, low in enumerate(lows)])).drop(*(f"__h{n}" for n in range(len(lows))))


def _hilbert_turns(df, idx: Sequence[str], order: int, into: str):
    """Level by level. A step reads columns that the step before it made, so that expressions stay small."""
    r, x = len(idx), [f"__h{d}" for d in range(len(idx))]
    df = df.withColumns({x[d]: F.col(c).cast("long") for d, c in enumerate(idx)})
    for b in range(order - 1, 0, -1):
        df = _turn(df, x, b, range(r))
    for d in range(1, r):
        df = df.withColumn(x[d], F.col(x[d]).bitwiseXOR(F.col(x[d - 1])))
    last = F.col(x[-1])
    t = reduce(lambda a, c: a.bitwiseXOR(c), (_bit(last, b) * ((1 << b) - 1) for b in range(order - 1, 0, -1)), F.lit(0).cast("long"))
    df = df.withColumn("__ht", t)
    value = [F.col(c).bitwiseXOR(F.col("__ht")) for c in x]
    df = df.withColumn(into, _or([F.shiftleft(_bit(value[d], b), b * r + r - 1 - d) for b in range(order) for d in range(r)]))
    return df.drop("__ht", *x)


def _turn(df, x: list[str], b: int, dims) -> object:
    """Reflects or swaps the lower bits by bit b of each dimension in turn."""
    low = (1 << b) - 1
    for d in dims:
        set_, first = _bit(F.col(x[d]), b) == 1, F.col(x[0])
        t = first.bitwiseXOR(F.col(x[d])).bitwiseAND(F.lit(low).cast("long"))
        if d == 0:
            df = df.withColumn(x[0], F.when(set_, first.bitwiseXOR(F.lit(low).cast("long"))).otherwise(first))
        else:
            df = df.withColumns({x[0]: F.when(set_, first.bitwiseXOR(F.lit(low).cast("long"))).otherwise(first.bitwiseXOR(t)), x[d]: F.when(set_, F.col(x[d])).otherwise(F.col(x[d]).bitwiseXOR(t))})
    return df


def hilbert_inverse(df, code: str, rank: int, order: int, into: Sequence[str]):
    if rank not in STEP:
        return _hilbert_inverse_turns(df, code, rank, order, into)
    k, (_, table, zeros) = STEP[rank], _curve(rank)
    lows = list(range(0, order, k))[::-1]
    df = _through(df, table, [_bits(F.col(code), low * rank, rank * min(k, order - low)) for low in lows], zeros[order % -k % rank], rank * k)
    x = [_or([F.shiftleft(_bits(F.col(f"__h{n}"), (rank - 1 - d) * k, k), low) for n, low in enumerate(lows)]) for d in range(rank)]
    return df.withColumns(dict(zip(into, x))).drop(*(f"__h{n}" for n in range(len(lows))))


def _hilbert_inverse_turns(df, code: str, rank: int, order: int, into: Sequence[str]):
    x = [f"__h{d}" for d in range(rank)]
    h = F.col(code)
    df = df.withColumns({x[d]: _or([F.shiftleft(_bit(h, b * rank + rank - 1 - d), b) for b in range(order)]) for d in range(rank)})
    df = df.withColumn("__ht", F.shiftright(F.col(x[-1]), 1))
    for d in range(rank - 1, 0, -1):
        df = df.withColumn(x[d], F.col(x[d]).bitwiseXOR(F.col(x[d - 1])))
    df = df.withColumn(x[0], F.col(x[0]).bitwiseXOR(F.col("__ht")))
    for b in range(1, order):
        df = _turn(df, x, b, range(rank - 1, -1, -1))
    return df.withColumns(dict(zip(into, map(F.col, x)))).drop("__ht", *x)


def element_offset(layout: dict, idx: Sequence[Column], shape: Sequence[Dim]) -> Column:
    """The position of an element in the buffer of a layout, as descriptors give it. Layouts of several buffers, and composites, have lookups of their own."""
    kind = layout["kind"]
    if kind == "row":
        return row_major(idx, shape)
    if kind == "col":
        return col_major(idx, shape)
    if kind == "strided":
        return strided(idx, layout["strides"])
    if kind == "morton":
        return morton(idx, layout["bits"])
    if kind == "tiled":
        inner, outer = layout.get("inner", {"kind": "row"}), layout.get("outer", {"kind": "row"})
        if inner["kind"] in ("row", "col") and outer["kind"] in ("row", "col"):
            return tiled(idx, shape, layout["tile"], outer["kind"], inner["kind"])
    raise ValueError(f"no single position in layout {kind}")


def floor_div(x: Column, n: int) -> Column:
    """In integers, towards minus infinity."""
    return div(x - F.pmod(x, F.lit(n)), n)


def byte_address(offset: Column, bits: int, byte_offset: int = 0, byte_size: int | None = None) -> Column:
    """The byte that holds the element; sub-byte types round towards minus infinity. An address outside a buffer of byte_size is an error."""
    offset = offset.cast("long")
    if bits >= 8:
        at = offset * (bits // 8)
    elif bits == 6:
        at = floor_div(offset, 4) * 3
    else:
        at = floor_div(offset, 8 // bits)
    at = at + byte_offset
    if byte_size is None:
        return at
    size = max(1, bits // 8) if bits != 6 else 3
    return F.when((at < 0) | (at + size > byte_size), F.raise_error(F.concat(F.lit("address outside the buffer: "), at.cast("string"))).cast("long")).otherwise(at)


def checked_index(coords: Sequence[Column], shape: Sequence[int | None]) -> list[Column]:
    """The coordinates; one for each dimension and each within it, or an error. A dimension of None is dynamic and has no upper bound."""
    if len(coords) != len(shape):
        raise ValueError(f"{len(coords)} coordinates for rank {len(shape)}")
    inside = [(c >= 0) & (F.lit(True) if n is None else c < n) for c, n in zip(coords, shape)]
    return [F.when(ok, c).otherwise(F.raise_error(F.concat(F.lit("index out of bounds: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("long")) for c, ok in zip(coords, inside)]


def buffer_size_bytes(n: Column, bits: int) -> Column:
    if bits == 6:
        return div(n + 3, 4) * 3
    return div(n * bits + 7, 8)


def col_major_inverse(position: Column, shape: Sequence[Dim]) -> list[Column]:
    return [div(position, s) % _lit(n) for s, n in zip(col_strides(shape), shape)]


def inverse(layout: dict, position: Column, shape: Sequence[Dim]) -> list[Column]:
    """Coordinates of a position in a layout that gives each position at most one element."""
    kind = layout["kind"]
    if kind == "row":
        return row_major_inverse(position, shape)
    if kind == "col":
        return col_major_inverse(position, shape)
    if kind == "morton":
        return morton_inverse(position, layout["bits"])
    if kind == "tiled" and all(layout.get(side, {"kind": "row"})["kind"] == "row" for side in ("outer", "inner")):
        return tiled_inverse(position, shape, layout["tile"])
    raise ValueError(f"no inverse of layout {kind} here")


def padded_extent(layout: dict, shape: Sequence[int]) -> int:
    """Positions that a layout spans, padding included."""
    kind = layout["kind"]
    if kind == "tiled":
        tiles = reduce(mul, (-(-n // t) for n, t in zip(shape, layout["tile"], strict=True)), 1)
        inner = layout.get("inner", {"kind": "row"})
        return tiles * (padded_extent(inner, layout["tile"]) if inner["kind"] == "tiled" else reduce(mul, layout["tile"], 1))
    if kind == "morton":
        return 1 << sum(layout["bits"])
    if kind == "hilbert":
        return 1 << layout["order"] * len(shape)
    if kind == "strided":
        return strided_extent(shape, layout["strides"])
    return reduce(mul, shape, 1)
