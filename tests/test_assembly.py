from gridloom.sources.descriptor import encode
from gridloom.streaming import assembly

from test_files import dense


def test_members_come_late_and_out_of_order(spark, tmp_path):
    head = encode(dense([4, 4], 0, layout={"kind": "composite", "rule": "partition", "combine": None, "members": 2}, buffers=[]))
    part = lambda a, n: encode(dense([n, 4], 16 * n, shard={"parent_shape": [4, 4], "offset": [a, 0]}))
    batches = [[("a", 2, part(1, 3)), ("b", 0, head), ("b", 1, part(0, 1))], [("a", 0, head), ("b", 2, part(0, 3)), ("c", 0, head)], [("a", 1, part(0, 1)), ("a", 1, part(0, 1))]]
    folder = f"{tmp_path}/in"
    spark.createDataFrame([], assembly.INPUT).write.parquet(folder)
    stream = spark.readStream.schema(assembly.INPUT).parquet(folder)
    q = assembly.assemble_stream(stream).writeStream.format("memory").queryName("composites").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, assembly.INPUT).coalesce(1).write.mode("append").parquet(folder)
            q.processAllAvailable()
    finally:
        q.stop()
    got = {r["head_id"]: r for r in spark.table("composites").collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["error"] is None and got["a"]["members"] == 2
    assert "overlap" in got["b"]["error"]
