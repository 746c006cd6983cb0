import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import address, elements
from gridloom.plans import catalog_queries


def one(spark, values, expr):
    df = spark.range(1).select(*(F.lit(v).cast("long").alias(f"i{k}") for k, v in enumerate(values)))
    return df.select(expr([F.col(f"i{k}") for k in range(len(values))])).first()[0]


def test_examples(spark):
    assert one(spark, [3, 5], lambda i: address.tiled(i, [6, 8], [2, 4])) == 29
    assert one(spark, [2, 3], lambda i: address.morton(i, [2, 2])) == 14
    assert one(spark, [2, 3], lambda i: address.strided(i, [-4, 1])) == -5
    assert address.strided_extent([3, 4], [-4, 1]) == 12


def test_hilbert_is_a_path_of_unit_steps(spark):
    for rank, order in ((2, 3), (3, 2)):
        n = 1 << order
        box = spark.createDataFrame(list(itertools.product(range(n), repeat=rank)), ", ".join(f"i{k} long" for k in range(rank)))
        names = [f"i{k}" for k in range(rank)]
        coded = address.hilbert(box, names, order, "h")
        assert coded.select("h").distinct().count() == n**rank
        back = address.hilbert_inverse(coded, "h", rank, order, [f"j{k}" for k in range(rank)])
        rows = sorted(back.collect(), key=lambda r: r["h"])
        for r in rows:
            assert [r[f"i{k}"] for k in range(rank)] == [r[f"j{k}"] for k in range(rank)]
        for a, b in itertools.pairwise(rows):
            assert sum(abs(a[c] - b[c]) for c in names) == 1


@pytest.mark.parametrize("shape,tile", [([6, 8], [2, 4]), ([7, 9], [3, 4]), ([5, 3, 4], [2, 2, 3])])
def test_tiled_positions_are_distinct_and_invert(spark, shape, tile):
    cells = spark.createDataFrame(list(itertools.product(*map(range, shape))), ", ".join(f"i{k} long" for k in range(len(shape))))
    idx = [F.col(f"i{k}") for k in range(len(shape))]
    rows = cells.select("*", address.tiled(idx, shape, tile).alias("p"))
    rows = rows.select("*", *(c.alias(f"j{k}") for k, c in enumerate(address.tiled_inverse(F.col("p"), shape, tile)))).collect()
    assert len({r["p"] for r in rows}) == len(rows)
    assert all(r[f"i{k}"] == r[f"j{k}"] for r in rows for k in range(len(shape)))


def test_micro_floats():
    assert elements.micro_value(0x7E, "float8_e4m3") == 448.0
    assert elements.micro_value(0x7C, "float8_e5m2") == float("inf")
    assert elements.micro_value(0b011111, "float6_e2m3") == 7.5
    assert [elements.micro_value(c, "float4_e2m1") for c in range(8)] == [0, 0.5, 1, 1.5, 2, 3, 4, 6]


def test_half_decode(spark):
    row = spark.range(1).select(elements.decode_half(F.lit(0x3C00), "float16").alias("a"), elements.decode_half(F.lit(0x3F80), "bfloat16").alias("b"), elements.decode_half(F.lit(0xFC00), "float16").alias("c")).first()
    assert tuple(row) == (1.0, 1.0, float("-inf"))


@pytest.mark.parametrize("rank, order", [(1, 7), (2, 1), (2, 4), (2, 5), (2, 20), (2, 31), (2, 32), (3, 2), (3, 5), (3, 21)])
def test_hilbert_by_table_equals_the_turns(spark, rank, order):
    rng = random.Random(order)
    rows = [[rng.getrandbits(40) for _ in range(rank)] for _ in range(200)] + [[0] * rank, [(1 << order) - 1] * rank, [-1] * rank, [None] * rank]
    names = [f"i{k}" for k in range(rank)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    df = address._hilbert_turns(address.hilbert(df, names, order, "h"), names, order, "g")
    for inverse, into in ((address.hilbert_inverse, "j"), (address._hilbert_inverse_turns, "k")):
        df = inverse(df, "h", rank, order, [f"{into}{k}" for k in range(rank)])
    for r in df.collect():
        assert r["h"] == r["g"]
        for k in range(rank):
            assert r[f"j{k}"] == r[f"k{k}"] == (None if r[f"i{k}"] is None else r[f"i{k}"] & (1 << order) - 1)


def test_hilbert_round_trip_keeps_large_keys(spark, tmp_path):
    keys = [(0, 0), (1 << 20, 5), ((1 << 20) - 1, 1 << 21), ((1 << 32) - 1, (1 << 32) - 1), (1 << 31, 3)]
    spark.createDataFrame(keys, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, catalog_queries.hilbert_roundtrip(spark, str(tmp_path)).select("a", "b", "x", "y").collect())) == sorted(k + k for k in keys)
    spark.createDataFrame([(1 << 32, 0)], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/more/lineitem.parquet")
    with pytest.raises(ValueError, match="no code"):
        catalog_queries.hilbert_roundtrip(spark, f"{tmp_path}/more").collect()
