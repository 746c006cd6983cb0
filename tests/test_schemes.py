import numpy as np
import pytest

from gridloom.operators import buffers
from gridloom.sources import inspect, schemes
from gridloom.sources.descriptor import FormatError, encode

from test_files import buffer, dense

ALL = [
    {"scheme": "per_tensor", "scale": 0.5, "zero_point": -3},
    {"scheme": "per_channel", "axis": 1, "scale_buffer": 1, "zero_buffer": None, "scale_type": "float32"},
    {"scheme": "per_channel", "axis": 0, "scale_buffer": 1, "zero_buffer": 2, "scale_type": "float32"},
    {"scheme": "per_block", "axis": 1, "block_size": 64, "scale_buffer": 1, "zero_buffer": None, "scale_type": "float16"},
    {"scheme": "nf4", "axis": 0, "block_size": 64, "scale_buffer": 1},
    {"scheme": "mxfp", "axis": 0, "block_size": 32, "scale_buffer": 1},
]


@pytest.mark.parametrize("q,size", list(zip(ALL, (16, 20, 20, 24, 16, 16))))
def test_round_trip(q, size):
    code = schemes.encode(q)
    assert len(code) == size and schemes.decode(code) == q
    for bad in (code[:-1], code + b"\0", bytes([9]) + code[1:], code[:1] + b"\2" + code[2:], code[:2] + b"\2" + code[3:]):
        with pytest.raises(FormatError):
            schemes.decode(bad)


@pytest.mark.parametrize("q", [{"scheme": "per_tensor", "scale": 0.0}, {"scheme": "per_tensor", "scale": float("inf")}, ALL[3] | {"block_size": 3}, ALL[4] | {"block_size": 4}, ALL[5] | {"block_size": 8}, ALL[5] | {"block_size": 4096}])
def test_rejects(q):
    with pytest.raises(FormatError):
        schemes.encode(q)


def test_against_tensors():
    d = dense([128, 64], 4096, type="uint4", buffers=[buffer(4096), buffer(512), buffer(64)])
    schemes.check_against(ALL[4], d)
    assert schemes.blocks_per_axis(ALL[4] | {"axis": 1}, [128, 100]) == 2
    for q, t in ((ALL[4], d | {"type": "int4"}), (ALL[4] | {"axis": 2}, d), (ALL[4] | {"scale_buffer": 0}, d), (ALL[4] | {"scale_buffer": 3}, d), (ALL[0] | {"zero_point": 16}, d), (ALL[5], d | {"type": "int8", "shape": [100, 64]})):
        with pytest.raises(FormatError):
            schemes.check_against(q, t)
    assert schemes.colocated([buffer(1), buffer(2)]) and not schemes.colocated([buffer(1), buffer(1) | {"device": 1}])


def test_sub_byte_packing():
    assert buffers.encode_values(np.array([1, 0, 1, 1, 0]), "bool") == b"\x0d"
    assert buffers.encode_values(np.array([5, 12, 3]), "uint4") == b"\xc5\x03"
    assert buffers.encode_values(np.array([3, 1, 2]), "uint2") == b"\x27"
    assert buffers.decode_bytes(b"\x81\x40\x20", "float6_e2m3").tolist() == [0.125, 0.25, 0.5, 1.0]
    assert buffers.decode_bytes(b"\xc5\x03", "int4").tolist() == [5, -4, 3, 0]
    assert buffers.encode_values(np.array([300.0, -300.0, 2.5, 3.5]), "int8") == bytes([127, 128, 2, 4])


@pytest.mark.parametrize("kind", sorted(set(buffers.WIDE) - {"uint64"}))
def test_wide_types(kind):
    v = np.array([0, 1, 100, 7])
    assert buffers.decode_bytes(buffers.encode_values(v, kind), kind).tolist() == v.tolist()


def test_cells(spark):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    payload = spark.createDataFrame([(0, a.tobytes()[:16]), (16, a.tobytes()[16:])], "chunk_offset long, bytes binary")
    assert (buffers.to_numpy(buffers.payload_cells(payload, "float32", [3, 4]), [3, 4]) == a).all()
    assert (buffers.to_numpy(buffers.from_numpy(spark, a), [3, 4]) == a).all()
    csr = buffers.from_compressed(spark, np.array([0, 2, 2, 3]), np.array([0, 3, 1]), np.array([1.0, 2.0, 3.0]))
    assert buffers.to_numpy(csr, [3, 4]).tolist() == [[1, 0, 0, 2], [0, 0, 0, 0], [0, 3, 0, 0]]
    assert buffers.preview(buffers.from_numpy(spark, np.arange(2000.0)), [2000]) == "[0.0 1.0 2.0 ... 1997.0 1998.0 1999.0]"


def test_inspect(spark):
    code = encode(dense([3, 4], 192))
    rows = inspect.inspect(spark, code).orderBy("offset").collect()
    assert bytes.fromhex("".join(r["bytes_hex"] for r in rows)) == code
    assert rows[8]["field"] == "shape[0] = 3"
