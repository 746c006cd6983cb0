import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import address
from gridloom.operators import buffers, composite, create, paged, prefix, quantize, sparse, statistics
from gridloom.plans import catalog_queries


def cells(spark, rows, rank=2):
    return spark.createDataFrame(rows, ", ".join(f"i{k} long" for k in range(rank)) + ", v double")


def test_prefix_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix, "CHUNK", 7)
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 4).alias("n"))
    got = {r["k"]: r["s"] for r in prefix.exclusive_sum(df, "k", "n", "s").collect()}
    assert got == {k: sum(j % 4 for j in range(k)) for k in range(50)}


def test_csr_example(spark):
    m = cells(spark, [(0, 0, 1.0), (0, 3, 2.0), (1, 2, 3.0), (2, 1, 4.0), (2, 4, 5.0)])
    assert [r[1] for r in sorted(sparse.pointers(m, "i0", 4).collect())] == [0, 2, 3, 5, 5]
    assert [r[1] for r in sorted(sparse.pointers(m, "i1", 5).collect())] == [0, 1, 2, 3, 4, 5]
    back = sparse.expand(sparse.pointers(m, "i0", 4), sparse.positions(m, "i0", "i1", 4).select("pos", "i1", "v"), "i0", "i1")
    assert sorted(back.collect()) == sorted(m.collect())


def test_csr_empty(spark):
    m = cells(spark, [])
    assert [r[1] for r in sorted(sparse.pointers(m, "i0", 4).collect())] == [0] * 5


def test_csf_example(spark):
    m = cells(spark, [(0, 0, 1, 1.0), (0, 2, 3, 2.0), (1, 1, 0, 3.0), (1, 1, 2, 4.0)], 3)
    order = ["i0", "i1", "i2"]
    levels = sparse.csf_levels(m, order)
    coords = lambda k: [r["coord"] for r in sorted(levels.where(F.col("level") == k).collect(), key=lambda r: r["node"])]
    assert (coords(0), coords(1), coords(2)) == ([0, 1], [0, 2, 1], [1, 3, 0, 2])
    pos = {r["parent"]: (r["first"], r["n"]) for r in sparse.csf_pos(levels, order, 2).collect()}
    assert pos == {0: (0, 1), 1: (1, 1), 2: (2, 2)}


def test_lookup_miss_is_zero(spark):
    got = sparse.lookup(spark.createDataFrame([(0, 0), (5, 5)], "i0 long, i1 long"), cells(spark, [(0, 0, 2.0)]), ["i0", "i1"])
    assert sorted((r["v"], r["stored"]) for r in got.collect()) == [(0.0, False), (2.0, True)]


@pytest.mark.parametrize("scheme", ["block", "nf4", "mxfp4", "tensor", "channel"])
def test_quantization_error_is_bounded_and_zero_stays(spark, scheme):
    m = create.full(spark, [4, 32], 0.0).withColumn("v", F.when(F.col("i0") > 0, F.sin(F.col("i0") * 7 + F.col("i1"))).otherwise(0.0).cast("float"))
    f = {"block": lambda: quantize.per_block(m, "i1", ["i0"], 16), "nf4": lambda: quantize.nf4(m, "i1", ["i0"], 16), "mxfp4": lambda: quantize.mxfp4(m, "i1", ["i0"]), "tensor": lambda: quantize.per_tensor(m), "channel": lambda: quantize.per_channel(m, "i1")}[scheme]()
    rows = f.collect()
    assert len(rows) == 128
    assert max(abs(r["x"] - r["v"]) for r in rows) <= {"nf4": 0.2, "mxfp4": 0.26}.get(scheme, 0.004)
    assert all(r["x"] == 0 for r in rows if r["i0"] == 0)


def test_pages(spark):
    t = spark.createDataFrame([(0, k, f"a{k}") for k in range(6)] + [(1, k, f"a{k}") for k in range(3)], "seq long, t long, x string")
    table = {r["seq"]: (r["pages"], r["seq_ptr"]) for r in paged.page_table(t, 4).collect()}
    assert table == {0: (2, 0), 1: (1, 2)}
    same = spark.createDataFrame([(0, k, f"a{k}") for k in range(6)] + [(1, k, f"a{k}") for k in range(4)], "seq long, t long, x string")
    shared = {(r["seq"], r["p"]): (r["seq_first"], r["p_first"]) for r in paged.shared(paged.pages_of(same, 4)).collect()}
    assert shared == {(0, 0): (0, 0), (0, 1): (0, 1), (1, 0): (0, 0)}


def test_generators(spark):
    assert [r["v"] for r in create.arange(spark, 5).collect()] == [0, 1, 2, 3, 4]
    assert [r["v"] for r in create.arange(spark, 3, 0, -1).collect()] == [3, 2, 1]
    assert [r["v"] for r in create.arange(spark, 0.0, 1.0, 0.25).collect()] == [0.0, 0.25, 0.5, 0.75]
    assert [r["v"] for r in create.linspace(spark, 0.0, 1.0, 1).collect()] == [0.0]
    with pytest.raises(ValueError):
        create.arange(spark, 0, 5, 0)


def test_values_are_kept(spark):
    rows = spark.createDataFrame([(0, 0, 1e-5), (0, 1, 0.123456789), (1, 0, 3.4e30)], "a long, b long, x double")
    assert {(r["i0"], r["i1"]): r["v"] for r in sparse.coo(rows, ["a", "b"], "x").collect()} == {(0, 0): 1e-5, (0, 1): 0.123456789, (1, 0): 3.4e30}
    members = spark.createDataFrame([(0, 1e-7, 0), (0, 2e-7, 1)], "i0 long, v double, ordinal int")
    assert abs(composite.overlay_add(members, ["i0"]).first()["v"] - 3e-7) < 1e-18


def test_statistics_count_what_is_not_stored(spark):
    one = statistics.summary(spark.createDataFrame([(0, 4.0)], "i0 long, v double"), F.lit(4)).first()
    assert (one["nnz"], one["value_min"], one["value_max"], one["value_mean"], one["sparsity_ratio"]) == (1, 0.0, 4.0, 1.0, 0.75)
    assert abs(one["value_stddev"] - 3**0.5) < 1e-12
    none = statistics.summary(spark.createDataFrame([], "i0 long, v double"), F.lit(3)).first()
    assert (none["nnz"], none["value_min"], none["value_mean"], none["sparsity_ratio"], none["has_nan"]) == (0, 0.0, 0.0, 1.0, False)
    assert statistics.summary(spark.createDataFrame([], "i0 long, v double"), F.lit(0)).first()["sparsity_ratio"] is None


def test_addresses_of_large_and_negative_offsets(spark):
    df = spark.createDataFrame([((1 << 60) + 7,), (-1,), (5,)], "o long")
    got = [r[0] for r in df.select(address.byte_address(F.col("o"), 4)).collect()]
    assert got == [((1 << 60) + 7) // 2, -1, 2]
    assert df.where("o = 5").select(address.byte_address(F.col("o"), 32, 0, 24)).first()[0] == 20
    for bad in (address.byte_address(F.col("o"), 32, 0, 23), address.checked_index([F.col("o")], [5])[0]):
        with pytest.raises(Exception, match="outside the buffer|out of bounds"):
            df.where("o = 5").select(bad).collect()
    assert df.where("o = 5").select(*address.checked_index([F.col("o")], [None])).first()[0] == 5


def test_complex_values(spark):
    assert buffers.decode_bytes(np.array([1 + 2j], "<c8").tobytes(), "complex64").tolist() == [1 + 2j]
    with pytest.raises(ValueError):
        buffers.decode_bytes(bytes(16), "float128")


def test_running_sums_keep_rows_without_index(spark):
    rows = spark.createDataFrame([(0, 5), (1, 7), (None, 100), (70_000, 1)], "k long, n long")
    assert {r["k"]: r["before"] for r in prefix.exclusive_sum(rows, "k", "n", "before").collect()} == {0: 0, 1: 5, None: None, 70_000: 12}


def test_offsets_by_layout(spark):
    idx = [F.lit(2).cast("long"), F.lit(3).cast("long")]
    at = lambda layout, shape: spark.range(1).select(address.element_offset(layout, idx, shape)).first()[0]
    assert (at({"kind": "row"}, [3, 4]), at({"kind": "col"}, [3, 4]), at({"kind": "strided", "strides": [-4, 1]}, [3, 4]), at({"kind": "morton", "bits": [2, 2]}, [4, 4])) == (11, 11, -5, 14)
    assert at({"kind": "tiled", "tile": [2, 4]}, [6, 8]) == address_of_tile(2, 3)
    for kind in ("csr", "composite", "private"):
        with pytest.raises(ValueError):
            address.element_offset({"kind": kind}, idx, [3, 4])


def address_of_tile(i, j):
    return ((i // 2) * 2 + j // 4) * 8 + i % 2 * 4 + j % 4


@pytest.mark.parametrize("shape", [[3, 7], [7, 3], [1, 20], [20, 1], [0, 4], [4, 0], [5, 5]])
@pytest.mark.parametrize("run", [1, 4, 5, 1 << 16])
def test_densify_makes_the_box_from_the_cells(spark, monkeypatch, shape, run):
    monkeypatch.setattr(sparse, "RUN", run)
    cells = [(0, 0, 1.0), (0, 1, None), (2, 2, 2.0), (4, 4, 3.0), (2, 6, 4.0), (19, 0, 5.0), (0, 19, 6.0), (0, 3, 7.0), (-1, 0, 8.0), (1, -1, 9.0), (None, 1, 9.0), (2, 2, 2.5)]
    got = sparse.densify(spark.createDataFrame(cells, "i0 int, i1 long, v float"), shape)
    stored = {}
    for a, b, v in cells:
        stored.setdefault((a, b), []).append(v or 0.0)
    want = [(a, b, v) for a in range(shape[0]) for b in range(shape[1]) for v in stored.get((a, b), [0.0])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.dtypes == [("i0", "bigint"), ("i1", "bigint"), ("v", "double")]


def test_densify_shuffles_cells_and_not_the_box(spark):
    box = sparse.densify(spark.createDataFrame([(3, 5, 1.0), (3999, 9999, 2.0)], "i0 long, i1 long, v double"), [4000, 10000])
    assert "Join" not in box._jdf.queryExecution().executedPlan().toString()
    assert box.agg({"v": "sum", "*": "count"}).first()[:] == (3.0, 40_000_000)


@pytest.mark.parametrize("block, share", [(1 << 10, 1 << 10), (3, 2), (1, 1)])
def test_overlaps_of_equal_boxes(spark, monkeypatch, block, share):
    monkeypatch.setattr(composite, "BLOCK", block)
    monkeypatch.setattr(composite, "SHARE", share)
    rng = np.random.default_rng(3)
    boxes = [(int(k), *map(int, (lo0, lo0 + n0, lo1, lo1 + n1))) for k, (lo0, n0, lo1, n1) in enumerate(zip(rng.integers(0, 6, 150) * 9, rng.integers(0, 3, 150) * 8, rng.integers(0, 4, 150) * 7, rng.integers(0, 3, 150) * 9))]
    boxes += [boxes[0], boxes[7], (boxes[9][0], 0, 40, 0, 40)]  # ordinals that recur, with the same box or another
    df = spark.createDataFrame([*boxes, (None, 0, 9, 0, 9), (500, None, 9, 0, 9)], "ordinal long, lo0 long, hi0 long, lo1 long, hi1 long")
    want = [(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and all(max(a[i], b[i]) < min(a[i + 1], b[i + 1]) for i in (1, 3))]
    assert sorted(map(tuple, composite.overlaps(df, 2, 16).collect())) == sorted(want)


def test_overlaps_are_dealt_to_tasks(spark):
    k = F.col("id")
    boxes = spark.range(0, 6000, 1, 1).select(k.alias("ordinal"), (k % 100 * 10).alias("lo0"), (k % 100 * 10 + 5).alias("hi0"), (k % 7).alias("lo1"), (k % 7 + 1).alias("hi1"))
    parts = composite.overlaps(boxes, 2, 32).groupBy(F.spark_partition_id()).count().collect()
    assert sum(p["count"] for p in parts) == sum(n * (n - 1) // 2 for n in np.bincount([i % 700 for i in range(6000)]).tolist())
    assert len(parts) > 4 and max(p["count"] for p in parts) < 0.5 * sum(p["count"] for p in parts)


def test_cells_are_summed_in_tasks_in_proportion_to_rows(spark, monkeypatch, tmp_path):
    k = F.col("id")
    items = spark.range(6000).select((k % 40).alias("l_suppkey"), F.when(k % 100 != 0, k % 700).alias("l_partkey"), F.when(k % 50 != 0, k / 4).alias("l_quantity"))
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(catalog_queries, "ROWS", 100)
    cells = catalog_queries.matrix(spark, str(tmp_path))
    sizes = cells.groupBy(F.spark_partition_id()).count().collect()
    assert cells.rdd.getNumPartitions() == 60 and max(r["count"] for r in sizes) < 200
    assert sorted(cells.collect(), key=str) == sorted(sparse.coo(items, ["l_suppkey", "l_partkey"], "l_quantity").collect(), key=str)
