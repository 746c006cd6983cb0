import numpy as np
import pytest

from gridloom.sources import composites, tensorfile
from gridloom.sources.descriptor import FormatError, buffer_count, check_parts, decode, encode, is_virtual, minimum_sizes
from gridloom.streaming import frames


def buffer(n):
    return {"byte_size": n, "alignment": 64, "device": 0, "sync": 0, "memory": 0}


def dense(shape, n, **more):
    return {"type": "float32", "shape": shape, "byte_offset": 0, "layout": {"kind": "row"}, "buffers": [buffer(n)]} | more


def test_worked_example():
    code = encode(dense([3, 4], 192))
    assert len(code) == 61 and code[:4] == b"HRRY" and code[6:10] == (61).to_bytes(4, "little")
    assert decode(code) == (dense([3, 4], 192), 61)


@pytest.mark.parametrize(
    "d",
    [
        dense([], 4),
        dense([0, 4], 0),
        dense([None, 4], 64),
        dense([3, 4], 48, layout={"kind": "strided", "strides": [-4, 1]}),
        dense([4, 4], 64, layout={"kind": "morton", "bits": [2, 2]}),
        dense([4, 4], 64, layout={"kind": "hilbert", "order": 2}),
        dense([8, 8], 256, layout={"kind": "tiled", "tile": [4, 4], "outer": {"kind": "strided", "strides": [2, 1]}, "inner": {"kind": "tiled", "tile": [2, 2], "outer": {"kind": "row"}, "inner": {"kind": "col"}}}),
        dense([8, 4], 128, shard={"parent_shape": [8, 8], "offset": [0, 4]}),
        dense([3, 3], 8, layout={"kind": "csr", "nnz": 2}, buffers=[buffer(8), buffer(16), buffer(32)], statistics={"nnz": 2, "sparsity_ratio": 7 / 9}),
        dense([2, 3, 4], 16, layout={"kind": "csf", "nnz": 4, "order": [0, 2, 1]}, buffers=[buffer(16)] * 7),
        dense([2, 2], 16, layout={"kind": "coo", "nnz": 1, "sorted": True}, buffers=[buffer(4), buffer(16)], quantization=bytes(16), member=1),
        dense([2, 2], 16, layout={"kind": "private", "tag": 0xF3, "id": 9, "data": b"abc"}),
        dense([20, 2, 8], 16, layout={"kind": "paged", "page_size": 4, "pages": 5, "axis": 0, "sequences": 2, "role": 1, "layer": None, "index": 0}, buffers=[buffer(16)] * 3),
        dense([8, 8], 0, layout={"kind": "composite", "rule": "overlay", "combine": "add", "members": 2}, buffers=[]),
    ],
)
def test_round_trip(d):
    code = encode(d)
    assert decode(code) == (d, len(code))
    with pytest.raises(FormatError):
        decode(code[:-1])


def broken(at, value):
    code = bytearray(encode(dense([3, 4], 192)))
    code[at] = value
    return bytes(code)


@pytest.mark.parametrize("at,value", [(0, 0), (4, 2), (10, 32), (14, 0), (15, 0x0C), (16, 65), (60, 1), (53, 65)])
def test_rejects(at, value):
    with pytest.raises(FormatError):
        decode(broken(at, value))


@pytest.mark.parametrize("d", [dense([3], 4, shard={"parent_shape": [3], "offset": [1]}), dense([3, 3], 4, layout={"kind": "morton", "bits": [1, 2]}), dense([3], 4, layout={"kind": "csr", "nnz": 0}), dense([3], 4, statistics={"value_min": 1.0})])
def test_rejects_descriptors(d):
    with pytest.raises(FormatError):
        encode(d)


def test_crc32c():
    assert tensorfile.crc32c(b"123456789") == 0xE3069283


@pytest.fixture
def tensors():
    a = np.arange(12, dtype="<f4").tobytes()
    return [("weights", dense([3, 4], 48), [a]), ("empty", dense([0], 0), [b""]), ("two", dense([2], 8, buffers=[buffer(8), buffer(3)]), [a[:8], b"xyz"])]


def test_file(spark, tmp_path, tensors):
    path = f"{tmp_path}/t.file"
    kv = {"producer": ("string", "é"), "count": ("int64", -2), "list": ("array", [("bool", True), ("bool", False)]), "raw": ("bytes", b"\x00\xff")}
    tensorfile.write_tensorfile(path, tensors, kv, sorted_index=True)
    tensorfile.register(spark)
    read = lambda **o: spark.read.format("tensorfile").options(**o).load(path)
    got = {r["name"]: r for r in read().collect()}
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1]["ordinal"])] == ["weights", "empty", "two"]
    assert got["weights"]["shape"] == [3, 4] and got["two"]["buffer_bytes"] == [8, 3]
    some = read(content="payload").where("name = 'two'").orderBy("buffer").collect()
    assert [bytes(r["bytes"]) for r in some] == tensors[2][2]
    assert {r["key"]: r["kind"] for r in read(content="kv").collect()} == {k: v[0] for k, v in kv.items()}
    assert tensorfile.read_index(path)[1] == kv
    data = bytearray(open(path, "rb").read())
    data[-60] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(FormatError):
        tensorfile.read_index(path)


def test_file_refuses_before_writing(tmp_path, tensors):
    with pytest.raises(FormatError):
        tensorfile.write_tensorfile(f"{tmp_path}/x", tensors + tensors[:1])
    assert not list(tmp_path.iterdir())


def test_stream(spark, tmp_path, tensors):
    path = f"{tmp_path}/s"
    items = [(d, b) for _, d, b in tensors]
    frames.write_stream(path, items)
    frames.register(spark)
    assert spark.read.format("tensorstream").load(path).count() == 3
    q = spark.readStream.format("tensorstream").load(path).writeStream.format("memory").queryName("frames").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    whole = open(path, "rb").read()
    extra = frames.frame(*items[0])
    open(path, "wb").write(whole + extra[:-5])  # a frame that isn't whole yet
    q.processAllAvailable()
    assert spark.table("frames").count() == 3
    open(path, "wb").write(whole + extra)
    q.processAllAvailable()
    q.stop()
    assert spark.table("frames").count() == 4
    with pytest.raises(FormatError):
        list(frames.read_frames(whole[:-1]))


def test_composites():
    head = lambda rule, n, **o: (dense([4, 4], 0, layout={"kind": "composite", "rule": rule, "combine": None, "members": n} | o, buffers=[]), None)
    part = lambda a, n: (dense([n, 4], 16 * n, shard={"parent_shape": [4, 4], "offset": [a, 0]}), a)
    whole = list(frames.assemble(iter([head("partition", 2), part(0, 1), part(1, 3)])))
    assert [m["data"] for m in whole[0]["members"]] == [0, 1]
    for bad in ([head("partition", 2), part(0, 1)], [head("partition", 2), part(0, 1), part(1, 2)], [head("partition", 2), part(0, 2), part(1, 3)], [head("overlay", 1, combine="add"), part(0, 1)]):
        with pytest.raises(FormatError):
            list(frames.assemble(iter(bad)))


@pytest.mark.parametrize(
    "d",
    [
        dense([3, 3], 8, layout={"kind": "csr", "nnz": 2}, buffers=[buffer(8)]),
        dense([20, 2, 8], 16, layout={"kind": "paged", "page_size": 0, "pages": 5, "axis": 0, "sequences": 2, "role": 1, "layer": None, "index": 0}, buffers=[buffer(16)] * 3),
        dense([20, 2, 8], 16, layout={"kind": "paged", "page_size": 4, "pages": 5, "axis": 9, "sequences": 2, "role": 1, "layer": None, "index": 0}, buffers=[buffer(16)] * 3),
        dense([2, 2], 16, layout={"kind": "private", "tag": 0x03, "id": 9, "data": b"abc"}),
        dense([2, 2], 16, layout={"kind": "coo", "nnz": 1, "sorted": True}),
        dense([20, 2, 8], 16, layout={"kind": "paged", "page_size": 4, "pages": 5, "axis": 0, "sequences": 2, "role": 77, "layer": None, "index": 0}, buffers=[buffer(16)] * 3),
        dense([20, 2, 8], 16, layout={"kind": "paged", "page_size": 4, "pages": 5, "axis": 0, "sequences": 2, "role": 1, "layer": None, "index": 2}, buffers=[buffer(16)] * 3),
        dense([4], 16, buffers=[buffer(16) | {"device": 0x55}]),
        dense([4], 16, buffers=[buffer(16) | {"device": 255}]),
        dense([4], 16, buffers=[buffer(16) | {"device": 1, "sync": 9}]),
        dense([4], 16, buffers=[buffer(16) | {"memory": 99}]),
        dense([4], 16, buffers=[buffer(16) | {"memory": 3}]),
        dense([4], 16, buffers=[buffer(16) | {"device": 1, "memory": 0xF1}]),
        dense([2, 2], 16, statistics={"nm_n": 4, "nm_m": 2}),
        dense([2, 2], 16, statistics={"value_mean": 1.0, "value_stddev": -1.0}),
    ],
)
def test_descriptors_that_break_a_rule(d):
    with pytest.raises(FormatError):
        encode(d)


def test_devices_with_their_memory():
    for device, memory in ((0, 2), (1, 3), (5, 0), (0xF0, 0xF1), (0xF0, 0)):
        encode(dense([4], 16, buffers=[buffer(16) | {"device": device, "memory": memory}]))


@pytest.mark.parametrize(
    "d, sizes",
    [
        (dense([3, 4], 48), [48]),
        (dense([5], 4, type="float6_e2m3"), [6]),
        (dense([9], 2, type="bool"), [2]),
        (dense([None, 4], 48), [None]),
        (dense([3, 3], 12, layout={"kind": "coo", "nnz": 3, "sorted": True}), [12, 48]),
        (dense([3, 5], 8, layout={"kind": "csr", "nnz": 2}), [8, 16, 32]),
        (dense([3, 5], 8, layout={"kind": "csc", "nnz": 2}), [8, 16, 48]),
        (dense([2, 3, 4], 16, layout={"kind": "csf", "nnz": 4, "order": [0, 2, 1]}), [16, 16, None, None, None, None, 32]),
        (dense([20, 2, 8], 16, layout={"kind": "paged", "page_size": 4, "pages": 5, "axis": 0, "sequences": 2, "role": 1, "layer": None, "index": 1}), [4 * 5 * 16 * 4, None, 24]),
        (dense([8, 8], 0, layout={"kind": "composite", "rule": "group", "combine": None, "members": 2}, buffers=[]), []),
    ],
)
def test_least_sizes(d, sizes):
    assert minimum_sizes(d) == sizes and buffer_count(d["layout"]) == len(sizes)
    assert is_virtual(d["layout"]) == (not sizes)
    assert check_parts(d | {"buffers": [buffer(n or 0) for n in sizes]})
    for k, n in enumerate(sizes):
        if n:
            with pytest.raises(FormatError):
                check_parts(d | {"buffers": [buffer((m or 0) - (j == k)) for j, m in enumerate(sizes)]})


def test_named_tensors_and_catalog(spark, tmp_path, tensors):
    path = f"{tmp_path}/t.file"
    a = np.zeros(12, "<f4").tobytes()
    more = [("part", dense([3, 4], 48, shard={"parent_shape": [6, 4], "offset": [3, 0]}, statistics={"nnz": 5, "has_nan": False, "has_inf": True}, quantization=b"12345678"), [a])]
    tensorfile.write_tensorfile(path, tensors + more)
    got = {r["name"]: r for r in tensorfile.load(spark, path, ["part", "two", "absent"]).collect()}
    assert sorted(got) == ["part", "two"]
    r = got["part"]
    assert (r["shard"]["parent_shape"], r["shard"]["offset"], bytes(r["quantization"])) == ([6, 4], [3, 0], b"12345678")
    assert r["statistics"] == {"nnz": 5.0, "has_nan": 0.0, "has_inf": 1.0}
    assert got["two"]["shard"] is None and got["two"]["statistics"] is None and got["two"]["quantization"] is None
    assert {r["name"] for r in tensorfile.load(spark, path, ["two"], "payload").collect()} == {"two"}
    assert tensorfile.load(spark, path, []).count() == 0 and tensorfile.load(spark, path).count() == 4


def _tree(nested=True):
    head = lambda rule, n, shape: dense(shape, 0, layout={"kind": "composite", "rule": rule, "combine": None, "members": n}, buffers=[])
    part = lambda name, a, n: {"name": name, "tensor": dense([n, 4], 16 * n, shard={"parent_shape": [4, 4], "offset": [a, 0]}), "buffers": [bytes([a]) * 16 * n]}
    whole = {"name": "z-whole", "head": head("partition", 2, [4, 4]), "members": [part("b", 0, 1), part("a", 1, 3)]}
    if not nested:
        return whole
    return {"name": "all", "head": head("group", 2, [1]), "members": [whole, {"name": "other", "tensor": dense([2], 8), "buffers": [bytes(8)]}]}


@pytest.mark.parametrize("sorted_index", [False, True])
def test_composites_in_files(spark, tmp_path, sorted_index):
    path = f"{tmp_path}/c.file"
    composites.write_composites(path, [_tree(), {"name": "after", "tensor": dense([1], 4), "buffers": [bytes(4)]}], sorted_index=sorted_index)
    tree = composites.read_composite(path, "all")
    assert composites.tensors_of(tree) == ["b", "a", "other"] and tree["members"][0]["head"]["layout"]["rule"] == "partition"
    assert composites.tensors_of(composites.read_composite(path, "z-whole")) == ["b", "a"]
    rows = tensorfile.load(spark, path, composites.tensors_of(tree), "payload").collect()
    assert {r["name"]: bytes(r["bytes"]) for r in rows} == {"b": bytes(16), "a": b"\x01" * 48, "other": bytes(8)}
    for name, depth in (("after", 64), ("absent", 64), ("all", 1)):
        with pytest.raises(FormatError):
            composites.read_composite(path, name, depth)


def test_composites_in_streams(spark, tmp_path):
    path = f"{tmp_path}/c.stream"
    composites.write_composite_stream(path, [_tree()])
    items = [(d, b) for _, _, d, _, b in frames.read_frames(open(path, "rb").read())]
    (tree,) = frames.assemble(iter(items))
    assert [m.get("data") for m in tree["members"][0]["members"]] == [[bytes(16)], [b"\x01" * 48]]


def test_broken_composites_are_not_written(tmp_path):
    gap, short = _tree(False), _tree(False)
    gap["members"][1]["tensor"] = dense([2, 4], 32, shard={"parent_shape": [4, 4], "offset": [1, 0]})
    gap["members"][1]["buffers"] = [bytes(32)]
    short["members"].pop()
    for tree in (gap, short):
        with pytest.raises(FormatError):
            composites.write_composites(f"{tmp_path}/x", [tree])
    assert not list(tmp_path.iterdir())


def test_torn_composite_in_a_file(tmp_path):
    path = f"{tmp_path}/torn.file"
    tensorfile.write_tensorfile(path, list(composites.flatten(_tree(False)))[:-1])
    with pytest.raises(FormatError):
        composites.read_composite(path, "z-whole")


def test_stream_in_ranges(spark, tmp_path, tensors, monkeypatch):
    path = f"{tmp_path}/s"
    items = [(d, b) for _, d, b in tensors] * 3
    frames.write_stream(path, items)
    monkeypatch.setattr(frames, "SPLIT", 150)
    size = (tmp_path / "s").stat().st_size
    ranges = [r.value for r in frames._ranges(path, 0, size, frames.Limits())]
    assert len(ranges) > 2 and [a for _, a, _ in ranges[1:]] == [b for _, _, b in ranges[:-1]] and ranges[-1][2] == size
    frames.register(spark)
    assert spark.read.format("tensorstream").load(path).count() == 9


def test_stream_options(spark, tmp_path):
    path = f"{tmp_path}/s"
    late = dense([2], 8, buffers=[buffer(8) | {"device": 1, "sync": 1}])
    with pytest.raises(FormatError):
        frames.write_stream(path, [(late, [bytes(8)])], cross_machine=True)
    frames.write_stream(path, [(late, [bytes(8)])])
    frames.register(spark)
    assert spark.read.format("tensorstream").load(path).count() == 1
    for option, value in (("max_buffer", 7), ("max_descriptor", 40), ("cross_machine", "true")):
        with pytest.raises(Exception, match="FormatError"):
            spark.read.format("tensorstream").option(option, value).load(path).count()


def test_sink(spark, tmp_path, tensors):
    source, out, live = f"{tmp_path}/s", f"{tmp_path}/out", f"{tmp_path}/live"
    frames.write_stream(source, [(d, b) for _, d, b in tensors])
    frames.register(spark)
    df = spark.read.format("tensorstream").load(source)
    read = lambda p: sorted((bytes(r["descriptor"]), [bytes(b) for b in r["buffers"]]) for r in spark.read.format("tensorstream").load(p).collect())
    df.write.format("tensorstream").mode("append").save(out)
    assert read(out) == read(source)
    df.repartition(3).write.format("tensorstream").mode("append").save(out)
    assert read(out) == sorted(read(source) * 2)
    df.write.format("tensorstream").mode("overwrite").save(out)
    assert read(out) == read(source)
    stream = spark.readStream.format("tensorstream").load(source)
    for _ in range(2):  # the second start finds nothing new
        q = stream.writeStream.format("tensorstream").option("path", live).option("checkpointLocation", f"{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()
    assert read(live) == read(source)
    with pytest.raises(Exception, match="sizes of buffers"):
        df.selectExpr("descriptor", "slice(buffers, 1, 0) buffers").limit(1).write.format("tensorstream").mode("append").save(out)
    assert read(out) == read(source)
