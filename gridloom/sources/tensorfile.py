"""The random-access container of named tensors: ``format("tensorfile")``.

``write_tensorfile`` writes one file; ``spark.read.format("tensorfile").load(path)`` reads its
catalog (the default), payload (buffers in chunks) or kv, by option "content". The driver reads only
header, trailer and index; each partition then reads a run of tensors. A filter on name reaches the reader.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from gridloom.sources.descriptor import MAGIC, Cursor, decode, encode, need

# Fixed values of the format.
FILE_MAGIC = b"HRRYFILE"
HAS_KV, SORTED_INDEX, HAS_CRC = 1, 2, 4
KV_TAGS = {"string": 1, "int64": 2, "uint64": 3, "float64": 4, "bool": 5, "bytes": 6, "array": 7}
HEADER, TRAILER, ALIGNMENT, CHUNK = 64, 40, 4096, 4 << 20
#: Bytes of tensors that one partition reads.
SPLIT = 64 << 20
CASTAGNOLI = 0x82F63B78


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (CASTAGNOLI if x & 1 else 0)
        out.append(x)
    return out


_TABLE = _crc_table()


def crc32c(data: bytes) -> int:
    x = 0xFFFFFFFF
    for b in data:
        x = x >> 8 ^ _TABLE[(x ^ b) & 255]
    return x ^ 0xFFFFFFFF


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def _kv_value(kind: str, value) -> bytes:
    if kind in ("string", "bytes"):
        data = value.encode() if kind == "string" else value
        return struct.pack("<I", len(data)) + data
    if kind == "array":
        need(value and len({k for k, _ in value}) == 1 and value[0][0] != "array", "arrays hold one kind, aren't empty and don't nest")
        return struct.pack("<BI", KV_TAGS[value[0][0]], len(value)) + b"".join(_kv_value(k, v) for k, v in value)
    return struct.pack({"int64": "<q", "uint64": "<Q", "float64": "<d", "bool": "<?"}[kind], value)


def _read_kv_value(c: Cursor, tag: int):
    kinds = {v: k for k, v in KV_TAGS.items()}
    need(tag in kinds, f"value tag {tag:#04x} is reserved")
    kind = kinds[tag]
    if kind in ("string", "bytes"):
        data = c.bytes(c.one("I"))
        return kind, data.decode() if kind == "string" else data
    if kind == "array":
        of, n = c.take("BI")
        need(of != KV_TAGS["array"] and n, "arrays aren't empty and don't nest")
        return kind, [_read_kv_value(c, of) for _ in range(n)]
    if kind == "bool":
        b = c.one("B")
        need(b < 2, "a bool is 0 or 1")
        return kind, bool(b)
    return kind, c.one({"int64": "q", "uint64": "Q", "float64": "d"}[kind])


def write_tensorfile(path: str, tensors: list[tuple[str, dict, list[bytes]]], kv: dict[str, tuple] | None = None, alignment: int = ALIGNMENT, sorted_index: bool = False) -> None:
    """One pass over tensors (name, descriptor, buffers); all is checked before the first byte. kv: name to (kind, value)."""
    need(alignment & (alignment - 1) == 0 and ALIGNMENT <= alignment <= 2 << 20, "alignment")
    names = [n.encode() for n, _, _ in tensors]
    need(len(set(names)) == len(names) and all(0 < len(n) < 65536 for n in names), "names are unique, of 1 to 65535 bytes")
    coded = [encode(d) for _, d, _ in tensors]
    for _, d, buffers in tensors:
        need([len(b) for b in buffers] == [b["byte_size"] for b in d["buffers"]], "sizes of buffers")
    fs, root = file_system(path)
    with fs.open_output_stream(root) as out:
        at = 0

        def put(data: bytes) -> None:
            nonlocal at
            out.write(data)
            at += len(data)

        def pad(n: int) -> None:
            put(bytes(-at % n))

        flags = HAS_CRC | (HAS_KV if kv else 0) | (SORTED_INDEX if sorted_index else 0)
        put(FILE_MAGIC + struct.pack("<BB2xIIQQ28x", 1, 0, flags, alignment, HEADER, len(tensors)))
        entries = []
        for name, code, (_, _, buffers) in zip(names, coded, tensors):
            pad(8)
            start = at
            put(code)
            first = at
            for k, data in enumerate(buffers):
                pad(alignment)
                first = first if k else at
                put(data)
            entries.append((name, struct.pack("<QIQQI", start, len(code), first, at - first, 0)))
        kv_at = kv_size = 0
        if kv:
            pad(8)
            kv_at = at
            put(struct.pack("<I", len(kv)) + b"".join(struct.pack("<H", len(k.encode())) + k.encode() + bytes([KV_TAGS[kind]]) + _kv_value(kind, v) for k, (kind, v) in kv.items()))
            kv_size = at - kv_at
        pad(8)
        index = struct.pack("<Q", len(entries)) + b"".join(struct.pack("<H", len(n)) + n + e for n, e in (sorted(entries) if sorted_index else entries))
        index_at = at
        put(index)
        put(struct.pack("<QQQIIxxxx", index_at, len(index), kv_at, kv_size, crc32c(index)) + MAGIC)


def read_index(path: str) -> tuple[list[dict], dict[str, tuple]]:
    fs, root = file_system(path)
    with fs.open_input_file(root) as f:
        size = f.size()
        need(size >= HEADER + TRAILER, "truncated")
        head, tail = f.read_at(HEADER, 0), f.read_at(TRAILER, size - TRAILER)
        need(head[:8] == FILE_MAGIC and head[8] == 1 and tail[36:] == MAGIC and not any(tail[32:36]), "magic or version")
        flags = struct.unpack_from("<I", head, 12)[0]
        need(not flags >> 3, "reserved flags")
        index_at, index_size, kv_at, kv_size, crc = struct.unpack_from("<QQQII", tail)
        need(index_at + index_size <= size - TRAILER and kv_at + kv_size <= size - TRAILER, "sections beyond the trailer")
        index = f.read_at(index_size, index_at)
        need(crc == (crc32c(index) if flags & HAS_CRC else 0), "checksum of the index")
        c, entries = Cursor(index), []
        for _ in range(c.one("Q")):
            name = c.bytes(c.one("H")).decode()
            offset, length, data, data_length, zero = c.take("QIQQI")
            need(name and not zero, "index entry")
            entries.append({"name": name, "offset": offset, "length": length, "data": data, "data_length": data_length})
        need(len({e["name"] for e in entries}) == len(entries), "names are unique")
        kv: dict[str, tuple] = {}
        if flags & HAS_KV:
            c = Cursor(f.read_at(kv_size, kv_at))
            for _ in range(c.one("I")):
                key = c.bytes(c.one("H")).decode()
                need(key and key not in kv, "keys are unique")
                kv[key] = _read_kv_value(c, c.one("B"))
        order = sorted(entries, key=lambda e: e["offset"])
        for k, e in enumerate(order):
            e["ordinal"] = k
        return entries, kv


def read_entry(f, e: dict) -> tuple[dict, list[int]]:
    """Descriptor of an index entry, and where its buffers begin."""
    need(struct.unpack("<I", f.read_at(4, e["offset"] + 6))[0] == e["length"], "length of the descriptor")
    d, _ = decode(f.read_at(e["length"], e["offset"]))
    at, starts = e["data"], []
    alignment = struct.unpack("<I", f.read_at(4, 16))[0]
    for b in d["buffers"]:
        at += -at % alignment if starts else 0
        starts.append(at)
        at += b["byte_size"]
    need(at - e["data"] == e["data_length"], "length of the data")
    return d, starts


def files_of(path: str) -> list[str]:
    """The file itself, or the files of a folder."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = file_system(path)
    if fs.get_file_info(root).type != FileType.Directory:
        return [path]
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(fs.get_file_info(FileSelector(root)), key=lambda f: f.base_name) if f.type == FileType.File and f.base_name[:1] not in "._"]


def write_parts(df, folder: str, tensors_of, put) -> list[str]:
    """Each partition of df writes one file of its own on an executor: put(path, tensors) with the tensors that tensors_of(record batch) gives. Gives the files of the tasks that finished; a part of another attempt stays unlisted under a hidden name."""
    import pyarrow as pa

    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)

    def run(batches):
        import uuid

        found = [t for batch in batches for t in tensors_of(batch)]
        if found:
            name = f"_{uuid.uuid4().hex}"
            put(f"{folder.rstrip('/')}/{name}", found)
            yield pa.RecordBatch.from_pydict({"name": [name]})

    done = [r["name"] for r in df.mapInArrow(run, "name string").collect()]  # a name for each partition
    for k, name in enumerate(done):
        fs.move(f"{root}/{name}", f"{root}/part-{k:06d}")
    return [f"{folder.rstrip('/')}/part-{k:06d}" for k in range(len(done))]


SCHEMAS = {
    "catalog": "name string, ordinal long, element_type string, shape array<long>, byte_offset long, layout string, buffer_bytes array<long>, descriptor binary, shard struct<parent_shape:array<long>,`offset`:array<long>>, statistics map<string,double>, quantization binary",
    "payload": "name string, buffer int, chunk int, chunk_offset long, bytes binary",
    "kv": "key string, kind string, value string",
}


class _One(InputPartition):
    def __init__(self, entry):
        self.value = entry


class _Reader(DataSourceReader):
    def __init__(self, path: str, content: str, only: set[str] | None = None):
        self.path, self.content, self.only = path, content, only

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("name",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            yield f  # Spark tests it again

    def partitions(self):
        files = files_of(self.path)
        if self.content == "kv":
            return [_One((f, None)) for f in files] or [_One(("", []))]
        return [_One((f, run)) for f in files for run in _runs([e for e in read_index(f)[0] if self.only is None or e["name"] in self.only])] or [_One(("", []))]

    def read(self, partition) -> Iterator[tuple]:
        path, entries = partition.value
        if not path:
            return
        if self.content == "kv":
            for k, (kind, v) in read_index(path)[1].items():
                yield k, kind, json.dumps(v.hex() if kind == "bytes" else v, default=str)
            return
        fs, root = file_system(path)
        with fs.open_input_file(root) as f:
            for e in entries:
                d, starts = read_entry(f, e)
                if self.content == "catalog":
                    yield e["name"], e["ordinal"], str(d["type"]), d["shape"], d["byte_offset"], d["layout"]["kind"], [b["byte_size"] for b in d["buffers"]], f.read_at(e["length"], e["offset"]), _shard(d), _statistics(d), d.get("quantization")
                    continue
                for k, (b, start) in enumerate(zip(d["buffers"], starts)):
                    for n, at in enumerate(range(0, b["byte_size"], CHUNK)):
                        yield e["name"], k, n, at, f.read_at(min(CHUNK, b["byte_size"] - at), start + at)


def _shard(d: dict) -> tuple | None:
    return (d["shard"]["parent_shape"], d["shard"]["offset"]) if "shard" in d else None


def _statistics(d: dict) -> dict | None:
    """Those that are known, as doubles; flags are 0 or 1."""
    return {k: float(v) for k, v in d["statistics"].items()} if "statistics" in d else None


def load(spark, path: str, names: list[str] | None = None, content: str = "catalog"):
    """The tensors of a file or folder, or those named; a name that isn't there gives no row."""
    register(spark)
    df = spark.read.format("tensorfile").option("content", content).load(path)
    return df if names is None else df.where(df["name"].isin(names))


def _runs(entries: list[dict]) -> list[list[dict]]:
    """Entries in runs of about SPLIT bytes, a partition each."""
    out, held = [], SPLIT
    for e in sorted(entries, key=lambda e: e["offset"]):
        if held >= SPLIT:
            out.append([])
            held = 0
        out[-1].append(e)
        held += e["length"] + e["data_length"]
    return out


class TensorFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensorfile"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("content", "catalog")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("content", "catalog"))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorFileSource)
