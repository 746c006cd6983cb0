"""Registered queries over the test tables, with their DuckDB equivalents."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridloom.functions import address, elements
from gridloom.operators import buffers, composite, create, layouts, paged, quantize, sparse, statistics
from gridloom.sources import descriptor, tensorfile
from gridloom.streaming import frames

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TILE, WIDTH = [32, 16], 64
CELLS = "WITH cells AS (SELECT vec_id AS i0, unnest(range(0, len(embedding))) AS i1, unnest(embedding) AS v FROM embeddings) "
MATRIX = "WITH cells AS (SELECT l_suppkey AS i0, l_partkey AS i1, CAST(sum(CAST(l_quantity AS DECIMAL(28,4))) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2) "
CUBE = "WITH types AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS t FROM (SELECT DISTINCT event_type FROM events)), cells AS (SELECT user_id AS i0, t AS i1, CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 AS i2, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS v FROM events JOIN types USING (event_type) GROUP BY 1, 2, 3) "


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("p", "v")).select("i0", F.col("p").cast("long").alias("i1"), "v")


def height(spark: SparkSession, sf: str) -> int:
    return read(spark, sf, "embeddings").agg(F.coalesce(F.max("vec_id") + 1, F.lit(0))).first()[0]


#: Rows of a table for each task that sums them to cells.
ROWS = 1 << 19


def tasks(table: DataFrame) -> int:
    return max(-(-table.count() // ROWS), table.sparkSession.sparkContext.defaultParallelism)


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem")
    return sparse.coo(items, ["l_suppkey", "l_partkey"], "l_quantity", tasks(items)).withColumn("v", F.round("v", 4))


def cube(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    types = e.select("event_type").distinct()
    ranked = types.withColumn("t", (F.dense_rank().over(Window.orderBy("event_type")) - 1).cast("long"))  # a few names
    rows = e.join(F.broadcast(ranked), "event_type").withColumn("day", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long"))
    return sparse.coo(rows, ["user_id", "t", "day"], "value", tasks(e))


def idx() -> list:
    return [F.col("i0"), F.col("i1")]


# --- addressing


@query(CELLS + "SELECT i0, i1, i0 * 64 + i1 AS pos FROM cells")
def row_major_offset(spark, sf):
    return cells(spark, sf).select("i0", "i1", address.row_major(idx(), [height(spark, sf), WIDTH]).alias("pos"))


@query(CELLS + "SELECT i0, i1, i0 + i1 * (SELECT max(vec_id) + 1 FROM embeddings) AS pos FROM cells")
def col_major_offset(spark, sf):
    return cells(spark, sf).select("i0", "i1", address.col_major(idx(), [height(spark, sf), WIDTH]).alias("pos"))


@query(CELLS + "SELECT i0, i1, -64 * i0 + i1 AS reversed, 0 * i0 + i1 AS broadcast FROM cells")
def strided_reverse_broadcast(spark, sf):
    return cells(spark, sf).select("i0", "i1", address.strided(idx(), [-WIDTH, 1]).alias("reversed"), address.strided(idx(), [0, 1]).alias("broadcast"))


@query(CELLS + "SELECT i0, i1, ((i0 // 32) * 4 + i1 // 16) * 512 + (i0 % 32) * 16 + i1 % 16 AS pos FROM cells")
def tiled_offset(spark, sf):
    return cells(spark, sf).select("i0", "i1", address.tiled(idx(), [height(spark, sf), WIDTH], TILE).alias("pos"))


@query(CELLS + "SELECT i0, i1, ((i0 // 32) * 4 + i1 // 16) * 512 + (((i0 % 32) // 8) * 4 + (i1 % 16) // 4) * 32 + (i0 % 32 % 8) + (i1 % 16 % 4) * 8 AS pos FROM cells")
def tiled_recursive_offset(spark, sf):
    return cells(spark, sf).select("i0", "i1", address.tiled(idx(), [height(spark, sf), WIDTH], TILE, "row", ([8, 4], "col")).alias("pos"))


@query(CELLS + "SELECT i0, i1, pos, ((pos // 512) // 4) * 32 + (pos % 512) // 16 AS j0, ((pos // 512) % 4) * 16 + pos % 16 AS j1 FROM (SELECT *, ((i0 // 32) * 4 + i1 // 16) * 512 + (i0 % 32) * 16 + i1 % 16 AS pos FROM cells)")
def tiled_inverse(spark, sf):
    shape = [height(spark, sf), WIDTH]
    df = cells(spark, sf).select("i0", "i1", address.tiled(idx(), shape, TILE).alias("pos"))
    j0, j1 = address.tiled_inverse(F.col("pos"), shape, TILE)
    return df.select("*", j0.alias("j0"), j1.alias("j1"))


#: Bits of a key on the curves.
BITS = 20
PAIRS = "WITH s0 AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) "


def _pairs(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()


@query(PAIRS + "SELECT a, b, " + " + ".join(f"(((a >> {k}) & 1) << {2 * k}) + (((b >> {k}) & 1) << {2 * k + 1})" for k in range(BITS)) + " AS code FROM s0")
def morton_code(spark, sf):
    return _pairs(spark, sf).select("a", "b", address.morton([F.col("a"), F.col("b")], [BITS, BITS]).alias("code"))


def _hilbert_sql() -> str:
    """The curve by quadrants from the top: d += s * s * ((3 * rx) ^ ry), then reflect and swap."""
    ctes, k = [PAIRS.rstrip() + ", t0 AS (SELECT a, b, a AS x, b AS y, 0 AS d FROM s0)"], 0
    for s in (1 << b for b in reversed(range(BITS))):
        ctes.append(f"r{k} AS (SELECT *, CASE WHEN x & {s} > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN y & {s} > 0 THEN 1 ELSE 0 END AS ry FROM t{k})")
        ctes.append(f"t{k + 1} AS (SELECT a, b, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {(1 << BITS) - 1} - y ELSE y END ELSE x END AS x, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {(1 << BITS) - 1} - x ELSE x END ELSE y END AS y, d + {s * s} * xor(3 * rx, ry) AS d FROM r{k})")
        k += 1
    return ", ".join(ctes) + f" SELECT a, b, CAST(d AS BIGINT) AS code FROM t{k}"


@query(_hilbert_sql())
def hilbert_code(spark, sf):
    return address.hilbert(_pairs(spark, sf), ["a", "b"], BITS, "code")


@query(PAIRS + "SELECT a, b, a AS x, b AS y FROM s0")
def hilbert_roundtrip(spark, sf):
    keys = [F.col("l_partkey"), F.col("l_suppkey")]
    low, top = read(spark, sf, "lineitem").agg(F.coalesce(F.min(F.least(*keys)), F.lit(0)), F.coalesce(F.max(F.greatest(*keys)), F.lit(0))).first()
    if low < 0 or top >= 1 << 32:
        raise ValueError(f"no code of 64 bits for keys from {low} to {top}")
    order = max(top.bit_length(), 1)
    coded = address.hilbert(_pairs(spark, sf), ["a", "b"], order, "code")
    return address.hilbert_inverse(coded, "code", 2, order, ["x", "y"]).drop("code")


@query("WITH s AS (SELECT DISTINCT l_partkey - 500 AS o FROM lineitem) SELECT o, o * 4 + 128 AS f32, CAST(floor(o / 2.0) AS BIGINT) AS int4, CAST(floor(o / 8.0) AS BIGINT) AS bit, CAST(floor(o / 4.0) AS BIGINT) * 3 AS f6, (abs(o) + 3) // 4 * 3 AS size6, (abs(o) * 4 + 7) // 8 AS size4 FROM s")
def byte_address(spark, sf):
    o = F.col("o")
    df = read(spark, sf, "lineitem").select((F.col("l_partkey") - 500).alias("o")).distinct()
    return df.select("o", address.byte_address(o, 32, 128).alias("f32"), address.byte_address(o, 4).alias("int4"), address.byte_address(o, 1).alias("bit"), address.byte_address(o, 6).alias("f6"), address.buffer_size_bytes(F.abs(o), 6).alias("size6"), address.buffer_size_bytes(F.abs(o), 4).alias("size4"))


# --- elements


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {t}, {tier}, {b}, {b < 8}, {k == 'f'}, {k in 'iu'}, {k in 'fic'})" for n, t, tier, b, k in elements.TYPES) + ") t(name, tag, tier, bits, is_sub_byte, is_float, is_integer, is_signed)")
def element_types(spark, sf):
    return elements.element_types(spark)


def _micro_sql(name: str, col: str) -> str:
    e, m, bias, _, _ = elements.MICRO[name]
    return f"(CASE WHEN ({col} >> {e + m}) & 1 = 1 THEN -1.0 ELSE 1.0 END) * (CASE WHEN ({col} >> {m}) & {(1 << e) - 1} = 0 THEN ({col} & {(1 << m) - 1}) / {1 << m}.0 * pow(2.0, {1 - bias}) ELSE (1 + ({col} & {(1 << m) - 1}) / {1 << m}.0) * pow(2.0, (({col} >> {m}) & {(1 << e) - 1}) - {bias}) END)"


@query("SELECT code, " + ", ".join(f"CAST({_micro_sql(n, f'(code % {1 << sum(elements.MICRO[n][:2], 1)})')} AS FLOAT) AS {n}" for n in ("float4_e2m1", "float6_e2m3", "float6_e3m2")) + " FROM (SELECT range AS code FROM range(256))")
def microfloat_decode(spark, sf):
    names = ("float4_e2m1", "float6_e2m3", "float6_e3m2")
    return spark.range(256).select(F.col("id").alias("code"), *(elements.decode_micro(F.col("id") % (1 << sum(elements.MICRO[n][:2], 1)), n).alias(n) for n in names))


@query("SELECT range AS code, CAST(range & 15 AS INT) AS u0, CAST(range >> 4 AS INT) AS u1, CAST(CASE WHEN range & 15 >= 8 THEN (range & 15) - 16 ELSE range & 15 END AS INT) AS s0, CAST(CASE WHEN range >> 4 >= 8 THEN (range >> 4) - 16 ELSE range >> 4 END AS INT) AS s1, CAST(range & 1 AS INT) AS b0, CAST(range >> 7 AS INT) AS b7 FROM range(256)")
def subbyte_unpack(spark, sf):
    c = F.col("id")
    u, s, b = elements.unpack(c, 4, False), elements.unpack(c, 4, True), elements.unpack(c, 1, False)
    return spark.range(256).select(c.alias("code"), u[0].alias("u0"), u[1].alias("u1"), s[0].alias("s0"), s[1].alias("s1"), b[0].alias("b0"), b[7].alias("b7"))


# --- sparse


@query(MATRIX + "SELECT * FROM cells")
def coo_build(spark, sf):
    return matrix(spark, sf)


@query(MATRIX + "SELECT p.i0, p.i1, coalesce(v, 0.0) AS v, v IS NOT NULL AS stored FROM (SELECT p_partkey % 100 AS i0, p_partkey AS i1 FROM part) p LEFT JOIN cells c ON p.i0 = c.i0 AND p.i1 = c.i1")
def coo_lookup(spark, sf):
    points = read(spark, sf, "part").select((F.col("p_partkey") % 100).alias("i0"), F.col("p_partkey").alias("i1"))
    return sparse.lookup(points, matrix(spark, sf), ["i0", "i1"])


@query(MATRIX + "SELECT i0, i1, CAST(1 AS BIGINT) AS n FROM cells WHERE false")
def coo_invariants(spark, sf):
    m = matrix(spark, sf)
    return sparse.duplicates(m, ["i0", "i1"]).unionByName(sparse.out_of_bounds(m, ["i0", "i1"], [1 << 40, 1 << 40]).select("i0", "i1", F.lit(1).cast("long").alias("n")))


def _ptr_sql(axis: str) -> str:
    return MATRIX + f", n AS (SELECT max({axis}) + 1 AS n FROM cells) SELECT k, CAST((SELECT count(*) FROM cells WHERE {axis} < k) AS BIGINT) AS ptr FROM (SELECT unnest(range(0, (SELECT n FROM n) + 1)) AS k)"


def _size(spark: SparkSession, sf: str, axis: str) -> int:
    """Extent of an axis of the matrix, from its table: the cells need not be made for it."""
    key = F.col({"i0": "l_suppkey", "i1": "l_partkey"}[axis]).cast("long")
    return read(spark, sf, "lineitem").agg(F.coalesce(F.max(key) + 1, F.lit(0))).first()[0]


@query(_ptr_sql("i0"))
def csr_row_ptr(spark, sf):
    m = matrix(spark, sf)
    return sparse.pointers(m, "i0", _size(spark, sf, "i0"))


@query(_ptr_sql("i1"))
def csc_col_ptr(spark, sf):
    m = matrix(spark, sf)
    return sparse.pointers(m, "i1", _size(spark, sf, "i1"))


@query(MATRIX + "SELECT i0, i1, v, row_number() OVER (ORDER BY i0, i1) - 1 AS pos FROM cells")
def csr_positions(spark, sf):
    m = matrix(spark, sf)
    return sparse.positions(m, "i0", "i1", _size(spark, sf, "i0")).select("i0", "i1", "v", F.col("pos").cast("long").alias("pos"))


@query(MATRIX + "SELECT o.o_orderkey AS q, o.i0, o.i1, c.pos FROM (SELECT o_orderkey, o_custkey % 100 AS i0, o_orderkey % 2000 AS i1 FROM orders) o LEFT JOIN (SELECT i0, i1, row_number() OVER (ORDER BY i0, i1) - 1 AS pos FROM cells) c ON o.i0 = c.i0 AND o.i1 = c.i1")
def csr_lookup(spark, sf):
    m = matrix(spark, sf)
    at = sparse.positions(m, "i0", "i1", _size(spark, sf, "i0")).select("i0", "i1", F.col("pos").cast("long").alias("pos"))
    points = read(spark, sf, "orders").select(F.col("o_orderkey").alias("q"), (F.col("o_custkey") % 100).alias("i0"), (F.col("o_orderkey") % 2000).alias("i1"))
    return points.join(at, ["i0", "i1"], "left").select("q", "i0", "i1", "pos")


@query(MATRIX + "SELECT * FROM cells")
def csr_expand(spark, sf):
    m = matrix(spark, sf)
    n = _size(spark, sf, "i0")
    return sparse.expand(sparse.pointers(m, "i0", n), sparse.positions(m, "i0", "i1", n).select("pos", "i1", "v"), "i0", "i1")


@query(MATRIX + "SELECT i1, i0, v, row_number() OVER (ORDER BY i1, i0) - 1 AS pos FROM cells")
def transcode_csr_to_csc(spark, sf):
    m = matrix(spark, sf)
    n = _size(spark, sf, "i0")
    back = sparse.expand(sparse.pointers(m, "i0", n), sparse.positions(m, "i0", "i1", n).select("pos", "i1", "v"), "i0", "i1")
    return sparse.positions(back, "i1", "i0", _size(spark, sf, "i1")).select("i1", "i0", "v", F.col("pos").cast("long").alias("pos"))


ORDER = ["i0", "i1", "i2"]


@query(CUBE + "SELECT 0 AS level, i0 AS coord, row_number() OVER (ORDER BY i0) - 1 AS node FROM (SELECT DISTINCT i0 FROM cells) UNION ALL SELECT 1, i1, row_number() OVER (ORDER BY i0, i1) - 1 FROM (SELECT DISTINCT i0, i1 FROM cells) UNION ALL SELECT 2, i2, row_number() OVER (ORDER BY i0, i1, i2) - 1 FROM cells")
def csf_levels(spark, sf):
    return sparse.csf_levels(cube(spark, sf), ORDER).select("level", "coord", F.col("node").cast("long").alias("node"))


@query(CUBE + ", n1 AS (SELECT i0, i1, row_number() OVER (ORDER BY i0, i1) - 1 AS node FROM (SELECT DISTINCT i0, i1 FROM cells)), n2 AS (SELECT i0, i1, i2, row_number() OVER (ORDER BY i0, i1, i2) - 1 AS leaf FROM cells) SELECT node AS parent, min(leaf) AS first, count(*) AS n FROM n1 JOIN n2 USING (i0, i1) GROUP BY node")
def csf_pos(spark, sf):
    return sparse.csf_pos(sparse.csf_levels(cube(spark, sf), ORDER), ORDER, 2).select(F.col("parent").cast("long").alias("parent"), F.col("first").cast("long").alias("first"), "n")


@query(CUBE + "SELECT p.q, leaf FROM (SELECT c_custkey AS q, c_custkey % 100 AS i0, c_custkey % 4 AS i1, 19723 + c_custkey % 30 AS i2 FROM customer) p LEFT JOIN (SELECT i0, i1, i2, row_number() OVER (ORDER BY i0, i1, i2) - 1 AS leaf FROM cells) USING (i0, i1, i2)")
def csf_lookup(spark, sf):
    leaves = sparse.csf_levels(cube(spark, sf), ORDER).where("level = 2").select(*ORDER, F.col("node").cast("long").alias("leaf"))
    q = F.col("c_custkey")
    points = read(spark, sf, "customer").select(q.alias("q"), (q % 100).alias("i0"), (q % 4).alias("i1"), (q % 30 + 19723).alias("i2"))
    return points.join(leaves, ORDER, "left").select("q", "leaf")


@query(MATRIX + "SELECT a.i0, b.i1, coalesce(c.v, 0.0) AS v FROM (SELECT unnest(range(0, (SELECT max(i0) + 1 FROM cells))) AS i0) a CROSS JOIN (SELECT unnest(range(0, (SELECT max(i1) + 1 FROM cells))) AS i1) b LEFT JOIN cells c ON c.i0 = a.i0 AND c.i1 = b.i1")
def densify(spark, sf):
    m = matrix(spark, sf)
    return sparse.densify(m, [_size(spark, sf, "i0"), _size(spark, sf, "i1")])


@query(CELLS + "SELECT i0, i1, v FROM cells WHERE i1 % 3 <> 0 AND v <> 0")
def sparsify(spark, sf):
    return sparse.sparsify(cells(spark, sf).withColumn("v", F.when(F.col("i1") % 3 == 0, F.lit(0.0).cast("float")).otherwise(F.col("v"))))


# --- statistics


@query(CELLS + "SELECT CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS nnz, CAST(min(v) AS DOUBLE) AS value_min, CAST(max(v) AS DOUBLE) AS value_max, CAST(max(abs(v)) AS DOUBLE) AS value_abs_max, round(avg(CAST(v AS DOUBLE)), 9) AS value_mean, round(stddev_pop(CAST(v AS DOUBLE)), 9) AS value_stddev, false AS has_nan, false AS has_inf, count(*) AS stored, round((count(*) - sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END)) / count(*), 9) AS sparsity_ratio FROM cells")
def tensor_stats(spark, sf):
    out = statistics.summary(cells(spark, sf), F.col("stored"))
    return out.withColumns({c: F.round(c, 9) for c in ("value_mean", "value_stddev", "sparsity_ratio")})


@query(CELLS + "SELECT count(*) AS groups, CAST(sum(CASE WHEN k > 2 THEN 1 ELSE 0 END) AS BIGINT) AS over, max(k) AS most FROM (SELECT i0, i1 // 4 AS g, CAST(sum(CASE WHEN v > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS k FROM cells GROUP BY 1, 2)")
def nm_sparsity(spark, sf):
    return statistics.structured(cells(spark, sf).withColumn("v", F.when(F.col("v") > 0.05, F.col("v")).otherwise(F.lit(0.0).cast("float"))), "i0", "i1", 2, 4)


# --- quantization: codes, and the largest error of each row


def _errors(df: DataFrame) -> DataFrame:
    return df.select("i0", "i1", "q", F.col("x").cast("float").alias("x"))


def _affine_sql(over: str) -> str:
    return CELLS + f"SELECT i0, i1, q, CAST(CAST(s AS FLOAT) * CAST(q AS FLOAT) AS FLOAT) AS x FROM (SELECT *, CAST(CASE WHEN s = 0 THEN 0 ELSE round_even(CAST(v AS DOUBLE) / s, 0) END AS INT) AS q FROM (SELECT *, CAST(max(abs(v)) OVER ({over}) AS DOUBLE) / 127 AS s FROM cells))"


@query(_affine_sql(""))
def quant_per_tensor(spark, sf):
    return _errors(quantize.per_tensor(cells(spark, sf)))


@query(_affine_sql("PARTITION BY i1"))
def quant_per_channel(spark, sf):
    return _errors(quantize.per_channel(cells(spark, sf), "i1"))


@query(_affine_sql("PARTITION BY i0, i1 // 16"))
def quant_per_block(spark, sf):
    return _errors(quantize.per_block(cells(spark, sf), "i1", ["i0"], 16))


def _nearest_sql(value: str, table: list[float]) -> str:
    levels = ", ".join(f"{{'d': abs({value} - CAST({x!r} AS DOUBLE)), 'k': {k}}}" for k, x in enumerate(table))
    return f"list_min([{levels}]).k"


@query(CELLS + f"SELECT i0, i1, q, CAST(CAST(m AS FLOAT) * CAST([{', '.join(f'CAST({x!r} AS DOUBLE)' for x in quantize.NF4)}][q + 1] AS FLOAT) AS FLOAT) AS x FROM (SELECT *, CAST(CASE WHEN m = 0 THEN 7 ELSE {_nearest_sql('CAST(v AS DOUBLE) / m', quantize.NF4)} END AS INT) AS q FROM (SELECT *, CAST(max(abs(v)) OVER (PARTITION BY i0, i1 // 16) AS DOUBLE) AS m FROM cells))")
def quant_nf4(spark, sf):
    return _errors(quantize.nf4(cells(spark, sf), "i1", ["i0"], 16))


@query(CELLS + f"SELECT i0, i1, q, CAST(CAST(s AS FLOAT) * CAST([{', '.join(f'CAST({x!r} AS DOUBLE)' for x in quantize.FP4)}][q + 1] AS FLOAT) AS FLOAT) AS x FROM (SELECT *, CAST({_nearest_sql('CAST(v AS DOUBLE) / s', quantize.FP4)} AS INT) AS q FROM (SELECT *, pow(2.0, CASE WHEN m = 0 THEN -126 ELSE greatest(-126, least(127, floor(log2(m)) - 2)) END) AS s FROM (SELECT *, CAST(max(abs(v)) OVER (PARTITION BY i0, i1 // 32) AS DOUBLE) AS m FROM cells)))")
def quant_mxfp4(spark, sf):
    return _errors(quantize.mxfp4(cells(spark, sf), "i1", ["i0"], 32))


# --- composites


@query(CELLS + "SELECT i0, i1, v, i0 // 100 AS s0, i1 // 48 AS s1 FROM cells")
def shard_split_assemble(spark, sf):
    parts = composite.split(cells(spark, sf), [100, 48])
    whole = composite.assemble(parts.drop("i0", "i1"), [100, 48])
    return whole.withColumns({"s0": F.call_function("div", F.col("i0"), F.lit(100)), "s1": F.call_function("div", F.col("i1"), F.lit(48))})


BOXES = "WITH boxes AS (SELECT p_partkey AS ordinal, p_partkey * 37 % 1000 AS lo0, p_partkey * 37 % 1000 + p_size AS hi0, p_partkey * 91 % 1000 AS lo1, p_partkey * 91 % 1000 + p_size % 20 AS hi1 FROM part) "


def boxes(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(k.alias("ordinal"), (k * 37 % 1000).alias("lo0"), (k * 37 % 1000 + F.col("p_size")).alias("hi0"), (k * 91 % 1000).alias("lo1"), (k * 91 % 1000 + F.col("p_size") % 20).alias("hi1"))


@query(BOXES + "SELECT a.ordinal AS a, b.ordinal AS b FROM boxes a, boxes b WHERE a.ordinal < b.ordinal AND greatest(a.lo0, b.lo0) < least(a.hi0, b.hi0) AND greatest(a.lo1, b.lo1) < least(a.hi1, b.hi1)")
def partition_overlap(spark, sf):
    return composite.overlaps(boxes(spark, sf), 2, 32)


@query(CELLS + "SELECT i0, i1, (i0 // 128) * 2 + i1 // 32 AS ordinal, i0 % 128 AS l0, i1 % 32 AS l1 FROM cells")
def partition_lookup(spark, sf):
    n = -(-height(spark, sf) // 128)
    grid = spark.range(n * 2).select(F.col("id").alias("ordinal"), (F.call_function("div", F.col("id"), F.lit(2)) * 128).alias("lo0"), (F.call_function("div", F.col("id"), F.lit(2)) * 128 + 128).alias("hi0"), (F.col("id") % 2 * 32).alias("lo1"), (F.col("id") % 2 * 32 + 32).alias("hi1"))
    return composite.locate(cells(spark, sf).select("i0", "i1"), grid, 2, 64).select("i0", "i1", "ordinal", "l0", "l1")


@query(BOXES + "SELECT CAST(sum((hi0 - lo0) * (hi1 - lo1)) AS BIGINT) AS volume FROM boxes")
def partition_coverage(spark, sf):
    return composite.coverage(boxes(spark, sf), 2)


def _members(spark, sf):
    base = cells(spark, sf).select("i0", "i1", F.col("v").cast("double").alias("v"), F.lit(0).alias("ordinal"))
    one = base.where((F.col("i0") + F.col("i1")) % 5 == 0).withColumns({"v": F.round(F.col("i0") / 8, 3), "ordinal": F.lit(1)})
    return base.unionByName(one).unionByName(base.where(F.col("i1") < 8).withColumns({"v": F.round(F.col("i1") / 4, 3), "ordinal": F.lit(2)}))


@query(CELLS + "SELECT i0, i1, CASE WHEN i1 < 8 THEN round(i1 / 4, 3) WHEN (i0 + i1) % 5 = 0 THEN round(i0 / 8, 3) ELSE CAST(v AS DOUBLE) END AS v FROM cells")
def overlay_replace(spark, sf):
    return composite.overlay_replace(_members(spark, sf), ["i0", "i1"])


@query(CELLS + "SELECT i0, i1, CAST(CAST(round(CAST(v AS DOUBLE), 3) AS DECIMAL(28,6)) + CASE WHEN (i0 + i1) % 5 = 0 THEN CAST(round(i0 / 8, 3) AS DECIMAL(28,6)) ELSE 0 END + CASE WHEN i1 < 8 THEN CAST(round(i1 / 4, 3) AS DECIMAL(28,6)) ELSE 0 END AS DOUBLE) AS v FROM cells")
def overlay_add(spark, sf):
    return composite.overlay_add(_members(spark, sf).withColumn("v", F.round("v", 3)), ["i0", "i1"]).withColumn("v", F.round("v", 6))


@query("SELECT conv_id, true AS ok FROM conversations GROUP BY conv_id")
def frame_contiguity(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.coalesce(F.length("text"), F.lit(0))
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return composite.contiguous(read(spark, sf, "conversations").select("conv_id", before.alias("offset"), n.alias("length")).where("length > 0"), "conv_id")


# --- paged


def tokens(spark, sf):
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("t"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("x"))


@query("SELECT seq, n_tokens, pages, CAST(coalesce(sum(pages) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seq_ptr FROM (SELECT conv_id AS seq, count(*) AS n_tokens, CAST(ceil(count(*) / 4) AS BIGINT) AS pages FROM conversations GROUP BY 1)")
def paged_seq_ptr(spark, sf):
    return paged.page_table(tokens(spark, sf), 4).select("seq", "n_tokens", "pages", "seq_ptr")


@query("WITH t AS (SELECT seq, n_tokens, pages, CAST(coalesce(sum(pages) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seq_ptr FROM (SELECT conv_id AS seq, count(*) AS n_tokens, CAST(ceil(count(*) / 4) AS BIGINT) AS pages FROM conversations GROUP BY 1)) SELECT conv_id AS seq, turn AS t, (seq_ptr + turn // 4) * 4 + turn % 4 AS slot FROM conversations JOIN t ON conv_id = seq WHERE turn < n_tokens")
def paged_gather(spark, sf):
    rows = tokens(spark, sf)
    table = paged.page_table(rows, 4)
    pages = rows.select("seq", F.call_function("div", F.col("t"), F.lit(4)).alias("p")).distinct()
    return paged.gather(rows.select("seq", "t"), table, paged.numbered(pages, table), 4).select("seq", "t", "slot")


@query("WITH pages AS (SELECT conv_id AS seq, turn // 4 AS p, string_agg(CAST(turn % 4 AS VARCHAR) || ':' || sha256(coalesce(text, '')), '|' ORDER BY turn) AS content FROM conversations GROUP BY 1, 2), f AS (SELECT content, min((seq, p)) AS f FROM pages GROUP BY 1) SELECT seq, p, f[1] AS seq_first, f[2] AS p_first FROM pages JOIN f USING (content)")
def paged_prefix_sharing(spark, sf):
    return paged.shared(paged.pages_of(tokens(spark, sf), 4))


# --- transcoding, selection, slices


@query(CELLS + "SELECT (i0 // 32) * 4 + i1 // 16 AS tile, ((i0 // 32) * 4 + i1 // 16) * 512 + (i0 % 32) * 16 + i1 % 16 AS pos, v FROM cells")
def transcode_row_to_tiled(spark, sf):
    shape = [height(spark, sf), WIDTH]
    stored = cells(spark, sf).select(address.row_major(idx(), shape).alias("at"), "v")
    rows = layouts.transcode(stored, shape, {"kind": "row"}, {"kind": "tiled", "tile": TILE})
    return rows.select(F.call_function("div", F.col("pos"), F.lit(512)).alias("tile"), "pos", "v")


@query("SELECT * FROM (VALUES ('a', 'tiled'), ('b', 'row'), ('c', 'coo')) t(tensor, chosen)")
def layout_negotiation(spark, sf):
    return layouts.negotiate(spark.sql("SELECT * FROM VALUES ('a', 'row', array('tiled', 'row'), true), ('b', 'row', array('morton', 'row'), false), ('c', 'coo', array('csr'), false) AS t(tensor, native, preferred, may_transcode)"))


@query(CELLS + "SELECT i0, i1, v FROM cells WHERE i0 >= 40 AND i0 < 300 AND i1 >= 10 AND i1 < 30")
def subarray_slice(spark, sf):
    return cells(spark, sf).where("i0 >= 40 AND i0 < 300 AND i1 >= 10 AND i1 < 30")


# --- generators


@query("SELECT a.range AS i0, b.range AS i1, CASE WHEN b.range = a.range + 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(50) a, range(60) b")
def eye(spark, sf):
    return create.eye(spark, 50, 60, 2)


@query("SELECT range AS i0, 7 + range * 3 AS v FROM range(1000) WHERE 7 + range * 3 < 2000")
def arange(spark, sf):
    return create.arange(spark, 7, 2000, 3).select("i0", F.col("v").cast("long").alias("v"))


@query("SELECT range AS i0, CASE WHEN range = 100 THEN 1.0::DOUBLE ELSE round(range * 0.01::DOUBLE, 9) END AS v FROM range(101)")
def linspace(spark, sf):
    return create.linspace(spark, 0.0, 1.0, 101).select("i0", F.round("v", 9).alias("v"))


@query("SELECT a.range AS i0, b.range AS i1, c.range AS i2, 2.5::DOUBLE AS v FROM range(10) a, range(20) b, range(3) c")
def full(spark, sf):
    return create.full(spark, [10, 20, 3], 2.5)


@query("SELECT range // 4 AS i0, range % 4 AS i1, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one FROM range(12)")
def zeros_ones(spark, sf):
    return create.zeros(spark, [3, 4]).withColumnRenamed("v", "zero").join(create.ones(spark, [3, 4]).withColumnRenamed("v", "one"), ["i0", "i1"])


# --- invariants and classes


@query(MATRIX + ", n AS (SELECT max(i0) + 1 AS n FROM cells), p AS (SELECT k, (SELECT count(*) FROM cells WHERE i0 < k) AS ptr FROM (SELECT unnest(range(0, (SELECT n FROM n) + 1)) AS k)) SELECT CAST((SELECT ptr FROM p WHERE k = 0) AS BIGINT) AS first, CAST(max(ptr) AS BIGINT) AS last, CAST(0 AS BIGINT) AS falling, CAST(0 AS BIGINT) AS unsorted FROM p")
def csr_invariants(spark, sf):
    m = matrix(spark, sf)
    n = _size(spark, sf, "i0")
    p = sparse.pointers(m, "i0", n)
    steps = p.alias("a").join(p.alias("b"), F.col("b.k") == F.col("a.k") + 1).agg(F.coalesce(F.sum((F.col("b.ptr") < F.col("a.ptr")).cast("long")), F.lit(0)).alias("falling"))
    rows = sparse.positions(m, "i0", "i1", n).withColumn("before", F.lag("i1").over(Window.partitionBy("i0").orderBy("pos")))
    order = rows.agg(F.coalesce(F.sum((F.col("before") >= F.col("i1")).cast("long")), F.lit(0)).alias("unsorted"))
    return p.agg(F.min("ptr").alias("first"), F.max("ptr").alias("last")).crossJoin(steps).crossJoin(order)  # one row each


@query("SELECT tag, CASE WHEN tag IN (0, 255) THEN 'invalid' WHEN tag BETWEEN 240 AND 254 THEN 'private' WHEN tag BETWEEN 1 AND 11 OR tag = 64 THEN 'named' ELSE 'reserved' END AS class FROM (SELECT range AS tag FROM range(256))")
def layout_tag_classes(spark, sf):
    return spark.range(256).select(F.col("id").alias("tag"), layouts.tag_class(F.col("id")).alias("class"))


@query("SELECT code, CASE WHEN code IN (0, 255) THEN NULL ELSE pow(2.0, code - 127) END AS scale FROM (SELECT range AS code FROM range(256))")
def e8m0_decode(spark, sf):
    return spark.range(256).select(F.col("id").alias("code"), F.nanvl(elements.decode_e8m0(F.col("id")), F.lit(None).cast("double")).alias("scale"))


# --- files and streams: every vector is a shard of one tensor; partitions write files of their own, and the sources read them back


def _shards(height: int):
    def run(batch):
        for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = buffers.encode_values(np.array(values, np.float32), "float32")
            d = {"type": "float32", "shape": [1, len(values)], "byte_offset": 0, "layout": {"kind": "row"}, "shard": {"parent_shape": [height, len(values)], "offset": [vec_id, 0]}}
            yield f"v{vec_id}", d | {"buffers": [{"byte_size": len(data), "alignment": 64, "device": 0, "sync": 0, "memory": 0}]}, [data]

    return run


def _place(spark) -> str:
    """A new folder that all executors share; only a session of one machine may use a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/gridloom-files"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _decoded(rows: DataFrame) -> DataFrame:
    """(descriptor, bytes) of shards to cells of their parent."""

    def run(batches):
        for batch in batches:
            for code, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                d, _ = descriptor.decode(code)
                v = buffers.decode_bytes(data, d["type"])
                (a, b), n = d["shard"]["offset"], d["shape"][1]
                at = np.arange(len(v))
                yield pa.RecordBatch.from_arrays([pa.array(a + at // n), pa.array(b + at % n), pa.array(v)], ["i0", "i1", "v"])

    return rows.mapInArrow(run, "i0 long, i1 long, v float")


def _write_file(path, tensors):
    tensorfile.write_tensorfile(path, tensors, {"tensors": ("int64", len(tensors))})


def _write_frames(path, tensors):
    frames.write_stream(path, [(d, b) for _, d, b in tensors])


@query(CELLS + "SELECT i0, i1, v FROM cells")
def file_roundtrip(spark, sf):
    folder = _place(spark)
    tensorfile.write_parts(read(spark, sf, "embeddings").select("vec_id", "embedding"), folder, _shards(height(spark, sf)), _write_file)
    tensorfile.register(spark)
    read_back = lambda c: spark.read.format("tensorfile").option("content", c).load(folder)
    return _decoded(read_back("payload").join(read_back("catalog").select("name", "descriptor"), "name").select("descriptor", "bytes"))


@query(CELLS + "SELECT i0, i1, v FROM cells")
def stream_roundtrip(spark, sf):
    folder = _place(spark)
    tensorfile.write_parts(read(spark, sf, "embeddings").select("vec_id", "embedding"), folder, _shards(height(spark, sf)), _write_frames)
    frames.register(spark)
    return _decoded(spark.read.format("tensorstream").load(folder).select("descriptor", F.col("buffers")[0].alias("bytes")))


# --- values from stored codes and parameters


def _zero_sql(over: str) -> str:
    """Affine codes with zero points, and their values in 32-bit floats."""
    ends = f"least(min(CAST(v AS DOUBLE)) OVER ({over}), 0.0::DOUBLE) AS lo, greatest(max(CAST(v AS DOUBLE)) OVER ({over}), 0.0::DOUBLE) AS hi"
    scaled = f"SELECT *, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (hi - lo) / 255 END AS s FROM (SELECT *, {ends} FROM cells)"
    coded = f"SELECT *, CAST(round_even(-lo / s, 0) AS INT) AS z FROM ({scaled})"
    codes = f"SELECT *, CAST(greatest(0, least(255, CAST(round_even(CAST(v AS DOUBLE) / s, 0) AS INT) + z)) AS INT) AS q FROM ({coded})"
    return CELLS + f"SELECT i0, i1, q, CAST(CAST(s AS FLOAT) * CAST(q - z AS FLOAT) AS FLOAT) AS x FROM ({codes})"


def _stored_affine(coded: DataFrame, scheme: str, keys: list[str]) -> DataFrame:
    """The codes alone, valued by a table of parameters."""
    params = coded.select(*keys, "scale", "zero").distinct()
    return _errors(quantize.dequantize(coded.select("i0", "i1", "q", *(k for k in keys if k not in ("i0", "i1"))), params, scheme, keys))


@query(_zero_sql("PARTITION BY i1"))
def dequant_per_channel(spark, sf):
    return _stored_affine(quantize.with_zero(cells(spark, sf), ["i1"]), "per_channel", ["i1"])


@query(_zero_sql("PARTITION BY i0, i1 // 16"))
def dequant_per_block(spark, sf):
    rows = cells(spark, sf).withColumn("b", quantize.block_of("i1", 16))
    return _stored_affine(quantize.with_zero(rows, ["i0", "b"]), "per_block", ["i0", "b"])


@query(_zero_sql(""))
def dequant_per_tensor(spark, sf):
    coded = quantize.with_zero(cells(spark, sf).withColumn("__all", F.lit(0)), ["__all"])
    return _stored_affine(coded, "per_tensor", [])


@query(ORACLE_SQL["quant_nf4"])
def dequant_nf4(spark, sf):
    coded = quantize.nf4(cells(spark, sf), "i1", ["i0"], 16).withColumn("b", quantize.block_of("i1", 16))
    return _errors(quantize.dequantize(coded.select("i0", "b", "i1", "q"), coded.select("i0", "b", "absmax").distinct(), "nf4", ["i0", "b"]))


@query(ORACLE_SQL["quant_mxfp4"])
def dequant_mxfp4(spark, sf):
    coded = quantize.mxfp4(cells(spark, sf), "i1", ["i0"], 32).withColumn("b", quantize.block_of("i1", 32))
    return _errors(quantize.dequantize(coded.select("i0", "b", "i1", "q"), coded.select("i0", "b", "e").distinct(), "mxfp", ["i0", "b"], "float4_e2m1"))


MXFP_KINDS = ["float8_e4m3", "float8_e5m2", "float6_e2m3", "float6_e3m2", "int8", "int4"]


def _mxfp_sql(kind: str) -> str:
    """Code i1 + 2 * (i0 % 8) of the type, scaled by 2 ** (i0 % 40 - 20)."""
    table = [float(c) for c in range(128)] if kind.startswith("int") else [elements.micro_value(c, kind) for c in range(1 << elements.BITS[kind])]
    code = f"((i1 + 2 * (i0 % 8)) % {8 if kind == 'int4' else min(len(table), 128)})"
    listed = ", ".join(f"CAST('{x!r}' AS DOUBLE)" for x in table)
    value = f"[{listed}][{code} + 1]"
    return f"SELECT '{kind}' AS kind, i0, i1, CAST(CASE WHEN isnan({value}) THEN NULL ELSE pow(2.0, i0 % 40 - 20) * {value} END AS FLOAT) AS x FROM cells"


@query(CELLS + " UNION ALL ".join(map(_mxfp_sql, MXFP_KINDS)))
def dequant_mxfp_kinds(spark, sf):
    codes, out = cells(spark, sf).select("i0", "i1"), None
    params = codes.select("i0").distinct().withColumn("e", (F.col("i0") % 40 + 107).cast("int"))
    for kind in MXFP_KINDS:
        top = 8 if kind == "int4" else min(128, 1 << elements.BITS[kind])
        rows = codes.withColumn("q", ((F.col("i1") + 2 * (F.col("i0") % 8)) % top).cast("int"))
        x = F.nanvl("x", F.lit(None).cast("float"))
        row = quantize.dequantize(rows, params, "mxfp", ["i0"], kind).select(F.lit(kind).alias("kind"), "i0", "i1", x.alias("x"))
        out = row if out is None else out.unionByName(row)
    return out


# --- components alone


@query(MATRIX + "SELECT o.o_orderkey AS q, o.i0, o.i1, c.pos, c.v FROM (SELECT o_orderkey, o_custkey % 100 AS i0, o_orderkey % 2000 AS i1 FROM orders) o LEFT JOIN (SELECT i0, i1, v, row_number() OVER (ORDER BY i1, i0) - 1 AS pos FROM cells) c ON o.i0 = c.i0 AND o.i1 = c.i1")
def csc_lookup(spark, sf):
    m = matrix(spark, sf)
    n = _size(spark, sf, "i1")
    stored = sparse.positions(m, "i1", "i0", n).select(F.col("pos").cast("long").alias("pos"), "i0", "v")
    points = read(spark, sf, "orders").select(F.col("o_orderkey").alias("q"), (F.col("o_custkey") % 100).alias("i0"), (F.col("o_orderkey") % 2000).alias("i1"))
    return sparse.compressed_lookup(points, sparse.pointers(m, "i1", n), stored, "i1", "i0").select("q", "i0", "i1", "pos", "v")


BROKEN = "p AS (SELECT i0, i1, row_number() OVER (ORDER BY i0, i1) - 1 AS pos FROM cells), s AS (SELECT i0, pos, CASE WHEN pos % 97 = 5 THEN -1 ELSE i1 END AS i1 FROM p), l AS (SELECT *, lag(i1) OVER (PARTITION BY i0 ORDER BY pos) AS before FROM s) "


@query(MATRIX + ", " + BROKEN + "SELECT 'start' AS fault, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'falling', 0 UNION ALL SELECT 'end', 0 UNION ALL SELECT 'order', CAST(count(*) FILTER (before >= i1) AS BIGINT) FROM l UNION ALL SELECT 'bounds', CAST(count(*) FILTER (i1 < 0) AS BIGINT) FROM l")
def csr_faults(spark, sf):
    """Indices of every 97th value are broken first."""
    m = matrix(spark, sf)
    n = _size(spark, sf, "i0")
    stored = sparse.positions(m, "i0", "i1", n).select("pos", F.when(F.col("pos") % 97 == 5, -1).otherwise(F.col("i1")).alias("i1"), "v")
    return sparse.compressed_faults(sparse.pointers(m, "i0", n), stored, "i1", _size(spark, sf, "i1"))


MODES = ["i2", "i0", "i1"]


def _tree(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The components of the cube, days first, and its values by leaf."""
    c = cube(spark, sf)
    levels = sparse.csf_levels(c, MODES)
    values = levels.where("level = 2").select(F.col("node").cast("long").alias("pos"), *MODES).join(c, MODES).select("pos", "v")
    return sparse.csf_components(levels, MODES), values


@query(CUBE + "SELECT i0, i1, i2, row_number() OVER (ORDER BY i2, i0, i1) - 1 AS pos, round(v, 4) AS v FROM cells")
def csf_expand(spark, sf):
    tree, values = _tree(spark, sf)
    return sparse.csf_expand(tree, values, MODES).withColumn("v", F.round("v", 4))


@query(CUBE + "SELECT p.q, pos FROM (SELECT c_custkey AS q, c_custkey % 100 AS i0, c_custkey % 4 AS i1, 19723 + c_custkey % 30 AS i2 FROM customer) p LEFT JOIN (SELECT i0, i1, i2, row_number() OVER (ORDER BY i2, i0, i1) - 1 AS pos FROM cells) USING (i0, i1, i2)")
def csf_find(spark, sf):
    q = F.col("c_custkey")
    points = read(spark, sf, "customer").select(q.alias("q"), (q % 100).alias("i0"), (q % 4).alias("i1"), (q % 30 + 19723).alias("i2"))
    return sparse.csf_find(points, _tree(spark, sf)[0], MODES).select("q", "pos")


# --- paged elements


HEADS, DIM = 2, 3
SLOTS = "WITH t AS (SELECT seq, n_tokens, CAST(coalesce(sum(pages) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seq_ptr FROM (SELECT conv_id AS seq, count(*) AS n_tokens, CAST(ceil(count(*) / 4) AS BIGINT) AS pages FROM conversations GROUP BY 1)), g AS (SELECT conv_id AS seq, turn AS t, (seq_ptr + turn // 4) * 4 + turn % 4 AS slot FROM conversations JOIN t ON conv_id = seq WHERE turn < n_tokens) "


def _slots(spark, sf) -> DataFrame:
    rows = tokens(spark, sf)
    table = paged.page_table(rows, 4)
    pages = rows.select("seq", F.call_function("div", F.col("t"), F.lit(4)).alias("p")).distinct()
    return paged.gather(rows.select("seq", "t"), table, paged.numbered(pages, table), 4)


@query(SLOTS + "SELECT seq, t, h, d, (slot * 2 + h) * 3 + d AS flat FROM g CROSS JOIN (SELECT range AS h FROM range(2)) CROSS JOIN (SELECT range AS d FROM range(3))")
def paged_element_offset(spark, sf):
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = _slots(spark, sf).withColumn("h", each(HEADS)).withColumn("d", each(DIM))
    return paged.element_offset(rows, HEADS, DIM).select("seq", "t", "h", "d", "flat")


@query(SLOTS + "SELECT seq, t, CAST(CAST((slot % 7 + 1) / 8.0::DOUBLE AS FLOAT) * CAST(t - slot % 3 AS FLOAT) AS FLOAT) AS x FROM g")
def paged_slot_dequant(spark, sf):
    rows = _slots(spark, sf).select("seq", "t", "slot", F.col("t").cast("int").alias("q"))
    scales = rows.select("slot").distinct().select("slot", ((F.col("slot") % 7 + 1) / 8).cast("float").alias("scale"), (F.col("slot") % 3).cast("int").alias("zero"))
    return paged.dequantize(rows, scales).select("seq", "t", "x")


# --- like another tensor


@query(CELLS + "SELECT i0, i1, CAST(2.5 AS FLOAT) AS filled, CAST(0 AS INTEGER) AS zero, CAST(1 AS FLOAT) AS one FROM cells")
def full_like(spark, sf):
    c = cells(spark, sf)
    rows = create.full_like(c, 2.5).withColumnRenamed("v", "filled").withColumn("v", F.lit(0.0))
    rows = create.zeros_like(rows, "int32").withColumnRenamed("v", "zero").withColumn("v", F.lit(0.0).cast("float"))
    return create.ones_like(rows).withColumnRenamed("v", "one")


@query(CELLS + "SELECT i0 + i1 * (SELECT max(vec_id) + 1 FROM embeddings) AS pos, v FROM cells")
def transcode_tiled_to_col(spark, sf):
    shape = [height(spark, sf), WIDTH]
    stored = cells(spark, sf).select(address.tiled(idx(), shape, TILE).alias("at"), "v")
    return layouts.transcode(stored, shape, {"kind": "tiled", "tile": TILE}, {"kind": "col"})
