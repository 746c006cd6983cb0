import numpy as np
import pytest

from gridloom.functions import address
from gridloom.operators import buffers, composite, create, layouts, paged, quantize, sparse
from pyspark.sql import functions as F

ORDER, SHAPE = ["i2", "i0", "i1"], [2, 3, 4]
CELLS = [(0, 0, 1, 1.0), (0, 2, 1, 2.0), (1, 1, 1, 3.0), (1, 1, 3, 4.0)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def tree(spark):
    cells = spark.createDataFrame(CELLS, "i0 long, i1 long, i2 long, v double")
    levels = sparse.csf_levels(cells, ORDER)
    values = levels.where("level = 2").select(F.col("node").cast("long").alias("pos"), *ORDER).join(cells, ORDER).select("pos", "v")
    return sparse.csf_components(levels, ORDER), values


def test_csf_expands_and_finds(spark, tree):
    got = sparse.csf_expand(*tree, ORDER).select("i0", "i1", "i2", "v")
    assert rows(got) == sorted(CELLS, key=str)
    points = spark.createDataFrame([(0, 2, 1), (1, 1, 3), (1, 1, 2), (9, 9, 9), (None, 1, 1)], "i0 long, i1 long, i2 long")
    found = {tuple(r)[:3]: r["pos"] for r in sparse.csf_find(points, tree[0], ORDER).select("i0", "i1", "i2", "pos").collect()}
    assert found == {(0, 2, 1): 1, (1, 1, 3): 3, (1, 1, 2): None, (9, 9, 9): None, (None, 1, 1): None}


@pytest.mark.parametrize(
    "change, fault",
    [
        (lambda t: t, set()),
        (lambda t: t.withColumn("coord", F.when(F.col("level") == 0, 1 - F.col("node")).otherwise(F.col("coord"))), {(0, "order")}),
        (lambda t: t.withColumn("coord", F.when((F.col("level") == 2) & (F.col("node") == 3), 7).otherwise(F.col("coord"))), {(2, "bounds")}),
        (lambda t: t.where("level < 2 or node < 3"), {(2, "childless")}),
        (lambda t: t.where("level < 2 or node <> 1"), {(2, "numbers")}),
        (lambda t: t.withColumn("parent", F.when((F.col("level") == 2) & (F.col("node") == 1), 8).otherwise(F.col("parent"))), {(2, "orphans")}),
    ],
)
def test_csf_faults(tree, change, fault):
    assert {(r["level"], r["fault"]) for r in sparse.csf_faults(change(tree[0]), ORDER, SHAPE).collect()} == fault


@pytest.mark.parametrize(
    "ptr, minor, fault",
    [
        ([0, 2, 2, 3], [0, 4, 1], set()),
        ([1, 2, 2, 3], [0, 4, 1], {"start"}),
        ([0, 2, 1, 3], [0, 1, 4], {"falling"}),
        ([0, 2, 2, 4], [0, 4, 1], {"end"}),
        ([0, 2, 2, 3], [4, 4, 1], {"order"}),
        ([0, 2, 2, 3], [0, 5, 1], {"bounds"}),
    ],
)
def test_compressed_faults(spark, ptr, minor, fault):
    p = spark.createDataFrame(list(enumerate(ptr)), "k long, ptr long")
    stored = spark.createDataFrame(list(enumerate(minor)), "pos long, i1 long").withColumn("v", F.lit(1.0))
    assert {r["fault"] for r in sparse.compressed_faults(p, stored, "i1", 5).where("n > 0").collect()} == fault


def test_compressed_lookup_of_columns(spark):
    """The matrix [[1, 0], [0, 2], [3, 0]] by columns."""
    ptr = spark.createDataFrame([(0, 0), (1, 2), (2, 3)], "k long, ptr long")
    stored = spark.createDataFrame([(0, 0, 1.0), (1, 2, 3.0), (2, 1, 2.0)], "pos long, i0 long, v double")
    points = spark.createDataFrame([(0, 0), (2, 0), (1, 1), (0, 1), (7, 7)], "i0 long, i1 long")
    got = sparse.compressed_lookup(points, ptr, stored, "i1", "i0").select("i0", "i1", "pos", "v")
    assert rows(got) == sorted([(0, 0, 0, 1.0), (2, 0, 1, 3.0), (1, 1, 2, 2.0), (0, 1, None, None), (7, 7, None, None)], key=str)


@pytest.mark.parametrize(
    "ptr, table, fault",
    [
        ([0, 2, 3], [0, 1, 0], set()),
        ([1, 2, 3], [0, 1, 0], {"start"}),
        ([0, 4, 3], [0, 1, 0], {"falling"}),
        ([0, 2, 2], [0, 1, 0], {"end"}),
        ([0, 2, 3], [0, 1, 2], {"pages"}),
    ],
)
def test_paged_faults(spark, ptr, table, fault):
    p = spark.createDataFrame(list(enumerate(ptr)), "k long, ptr long")
    blocks = spark.createDataFrame(list(enumerate(table)), "logical long, physical long")
    assert {r["fault"] for r in paged.faults(p, blocks, 2).where("n > 0").collect()} == fault


def test_paged_gap(spark):
    p = spark.createDataFrame([(0, 0), (1, 2)], "k long, ptr long")
    blocks = spark.createDataFrame([(0, 0), (2, 1)], "logical long, physical long")
    assert {r["fault"] for r in paged.faults(p, blocks, 2).where("n > 0").collect()} == {"gaps"}


def test_paged_elements(spark):
    at = spark.createDataFrame([(5, 1, 2)], "slot long, h long, d long")
    assert paged.element_offset(at, 2, 3).first()["flat"] == (5 * 2 + 1) * 3 + 2
    with pytest.raises(Exception, match="out of bounds"):
        paged.element_offset(at, 1, 3).collect()


@pytest.mark.parametrize(
    "scheme, kind, params, schema, want",
    [
        ("per_channel", "int8", [(0, 0.5, 3), (1, 2.0, None)], "c int, scale float, zero int", [(0, 0.5 * (7 - 3)), (1, 14.0), (2, None)]),
        ("nf4", "uint4", [(0, 2.0), (1, 0.0)], "c int, absmax float", [(0, 0.0), (1, 0.0), (2, None)]),
        ("mxfp", "float4_e2m1", [(0, 128), (1, 126)], "c int, e int", [(0, 12.0), (1, 3.0), (2, None)]),
        ("mxfp", "int8", [(0, 128), (1, 126)], "c int, e int", [(0, 14.0), (1, 3.5), (2, None)]),
    ],
)
def test_stored_parameters(spark, scheme, kind, params, schema, want):
    codes = spark.createDataFrame([(0, 7), (1, 7), (2, 7)], "c int, q int")
    got = quantize.dequantize(codes, spark.createDataFrame(params, schema), scheme, ["c"], kind).orderBy("c").collect()
    assert [(r["c"], r["x"]) for r in got] == want


def test_reserved_scales(spark):
    assert rows(quantize.reserved_scales(spark.createDataFrame([(0,), (1,), (254,), (255,)], "e int"))) == [(0,), (255,)]


@pytest.mark.parametrize("source", [{"kind": "row"}, {"kind": "col"}, {"kind": "tiled", "tile": [2, 4]}, {"kind": "morton", "bits": [2, 3]}])
@pytest.mark.parametrize("target", [{"kind": "row"}, {"kind": "col"}, {"kind": "tiled", "tile": [2, 4]}, {"kind": "strided", "strides": [-5, 1]}])
def test_transcode(spark, source, target):
    shape = [3, 5]
    cells = create.full(spark, shape, 0.0).withColumn("v", F.col("i0") * 10.0 + F.col("i1"))
    at = lambda layout: address.element_offset(layout, [F.col("i0"), F.col("i1")], shape)
    got = layouts.transcode(cells.select(at(source).alias("at"), "v"), shape, source, target)
    assert rows(got) == rows(cells.select(at(target).alias("pos"), "v"))


def test_padded_extents():
    assert address.padded_extent({"kind": "tiled", "tile": [2, 4]}, [3, 5]) == 2 * 2 * 8
    assert address.padded_extent({"kind": "tiled", "tile": [3, 4], "inner": {"kind": "tiled", "tile": [2, 2]}}, [3, 4]) == 2 * 2 * 4
    assert address.padded_extent({"kind": "morton", "bits": [2, 3]}, [3, 5]) == 32
    assert address.padded_extent({"kind": "hilbert", "order": 2}, [4, 4]) == 16
    assert address.padded_extent({"kind": "strided", "strides": [0, 1]}, [3, 5]) == 5
    assert address.padded_extent({"kind": "row"}, [3, 0]) == 0


def test_tag_of_null(spark):
    df = spark.createDataFrame([(1,), (255,), (0xF1,), (0x55,), (None,)], "t int").select(layouts.tag_class(F.col("t")))
    assert [r[0] for r in df.collect()] == ["named", "invalid", "private", "reserved", None]


def test_like(spark):
    a = create.asarray(spark, [[1, 2], [3, 4]], "int32")
    assert a.schema["v"].dataType.simpleString() == "int"
    assert create.ones_like(a).schema["v"].dataType == a.schema["v"].dataType
    assert create.zeros_like(a, "float32").schema["v"].dataType.simpleString() == "float"
    assert np.array_equal(buffers.to_numpy(create.full_like(a, 7), [2, 2]), np.full((2, 2), 7))
    assert create.empty(spark, [2, 0]).count() == 0 and create.empty_like(a).count() == 4


@pytest.mark.parametrize(
    "change, fault",
    [
        ({}, set()),
        ({1: ("float16", "row", [4, 4], 2, 4, 0, 4)}, {"mixed"}),
        ({1: ("float32", "row", [4, 4], 2, 5, 0, 4)}, {"outside", "volume"}),
        ({1: ("float32", "row", [4, 4], 3, 4, 0, 4)}, {"volume"}),
        ({1: ("float32", "row", [4, 4], 1, 3, 0, 4)}, {"overlap"}),
    ],
)
def test_parallel_shards(spark, change, fault):
    parts = {0: ("float32", "row", [4, 4], 0, 2, 0, 4), 1: ("float32", "row", [4, 4], 2, 4, 0, 4), 2: ("float32", "row", [4, 4], 4, 4, 0, 4)} | change
    schema = "ordinal long, element_type string, layout string, parent array<long>, lo0 long, hi0 long, lo1 long, hi1 long"
    df = spark.createDataFrame([(k, *p) for k, p in parts.items()], schema)
    assert {r["fault"] for r in composite.shard_faults(df, 2, 2).where("n > 0").collect()} == fault
    assert composite.shard_faults(df.limit(0), 2, 2).where("n > 0").count() == 0


def test_late_dimensions(spark, tmp_path):
    schema = "tensor string, shape array<long>"
    spark.createDataFrame([("a", [None, 4]), ("b", [None, None]), ("c", [2]), (None, [None])], schema).write.parquet(f"{tmp_path}/t")
    dims = spark.createDataFrame([("a", 0, 9), ("b", 1, 3)], "tensor string, axis int, n long")
    q = composite.resolve_dimensions(spark.readStream.schema(schema).parquet(f"{tmp_path}/t"), dims).writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {r["tensor"]: r["shape"] for r in spark.table("late").collect()} == {"a": [9, 4], "b": [None, 3], "c": [2], None: [None]}
