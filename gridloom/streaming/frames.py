"""The stream of frames, a descriptor and its buffers each: ``format("tensorstream")``, batch and streaming.

A stream ends at the end of a frame; an end within a frame is an error. A streaming query reads from the
byte after the last whole frame; the offset is a position in bytes. The driver reads descriptors alone, to find
where frames end; executors read ranges of whole frames, one frame at a time. Options: max_descriptor and
max_buffer in bytes, cross_machine (true: buffers must be synced by their producer).

As a sink, in batch and streaming, rows (descriptor, buffers) become a file for each task, hidden until its batch is
committed; a batch that is written again replaces its own files.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from gridloom.sources.descriptor import DYNAMIC, FormatError, decode, encode, need
from gridloom.sources.tensorfile import SPLIT, file_system, files_of

MAX_DESCRIPTOR, MAX_BUFFER = 16 << 20, 1 << 30
SCHEMA = "frame_offset long, element_type string, shape array<long>, layout string, descriptor binary, buffers array<binary>"


@dataclass(frozen=True)
class Limits:
    max_descriptor: int = MAX_DESCRIPTOR
    max_buffer: int = MAX_BUFFER
    cross_machine: bool = False

    @classmethod
    def of(cls, options) -> Limits:
        return cls(int(options.get("max_descriptor", MAX_DESCRIPTOR)), int(options.get("max_buffer", MAX_BUFFER)), str(options.get("cross_machine", "false")).lower() == "true")

    def check(self, d: dict) -> None:
        need(all(b["byte_size"] <= self.max_buffer for b in d["buffers"]), "a buffer is over the limit")
        need(not self.cross_machine or all(b.get("sync", 0) == 0 for b in d["buffers"]), "between machines, buffers are synced by their producer")


def frame(d: dict, buffers: list[bytes], cross_machine: bool = False) -> bytes:
    need([len(b) for b in buffers] == [b["byte_size"] for b in d["buffers"]], "sizes of buffers")
    Limits(max_buffer=DYNAMIC, cross_machine=cross_machine).check(d)
    return encode(d) + b"".join(buffers)


def write_stream(path: str, tensors: list[tuple[dict, list[bytes]]], append: bool = False, cross_machine: bool = False) -> None:
    frames = [frame(d, b, cross_machine) for d, b in tensors]  # all checked first
    fs, root = file_system(path)
    with (fs.open_append_stream if append else fs.open_output_stream)(root) as out:
        for f in frames:
            out.write(f)


def scan(read: Callable[[int, int], bytes], at: int, end: int, partial: bool = False, limits: Limits = Limits(), payload: bool = True) -> Iterator[tuple[int, int, dict, bytes, list[bytes]]]:
    """(start, end, descriptor, its bytes, buffers) of each frame from at, by read(position, length); partial: a frame that isn't whole yet ends the reading instead of raising. Without payload, only descriptors are read."""
    while at < end:
        size = struct.unpack("<I", read(at + 6, 4))[0] if end - at >= 10 else None
        need(size is None or 20 <= size <= limits.max_descriptor, "length of the descriptor")
        whole = size is not None and end - at >= size
        if whole:
            code = read(at, size)
            d, _ = decode(code)
            limits.check(d)
            p = at + size
            after = p + sum(b["byte_size"] for b in d["buffers"])
            whole = after <= end
        if not whole:
            if partial:
                return
            raise FormatError("the stream ends within a frame")
        buffers = []
        for b in d["buffers"] if payload else []:
            buffers.append(read(p, b["byte_size"]))
            p += b["byte_size"]
        yield at, after, d, code, buffers
        at = after


def read_frames(data: bytes, at: int = 0, partial: bool = False, max_descriptor: int = MAX_DESCRIPTOR, max_buffer: int = MAX_BUFFER, cross_machine: bool = False) -> Iterator[tuple[int, int, dict, bytes, list[bytes]]]:
    """Frames of bytes in memory."""
    return scan(lambda p, n: data[p : p + n], at, len(data), partial, Limits(max_descriptor, max_buffer, cross_machine))


def assemble(items: Iterator[tuple[dict, object]], depth: int = 8) -> Iterator[dict]:
    """Tensors and whole composites of a sequence of (descriptor, data): {"head" or "tensor", "members"}; a torn composite is an error."""

    def one(d, data, level: int) -> dict:
        if d["layout"]["kind"] != "composite":
            return {"tensor": d, "data": data}
        need(level < depth, "composites are nested too deeply")
        members = []
        for _ in range(d["layout"]["members"]):
            nxt = next(items, None)
            need(nxt is not None, "a composite is torn")
            members.append(one(*nxt, level + 1))
        out = {"head": d, "members": members}
        check_members(out)
        return out

    for d, data in items:
        yield one(d, data, 0)


def check_members(c: dict) -> None:
    """Partition members tile the head without gap or overlap; overlays have one shape and begin with a base of the whole."""
    head = c["head"]
    inner = [m.get("tensor") or m["head"] for m in c["members"]]
    rule = head["layout"]["rule"]
    if rule == "group":
        return
    need(all(m["type"] == head["type"] for m in inner), "element types of members")
    boxes = [(m.get("shard") or {"offset": [0] * len(m["shape"])})["offset"] for m in inner]
    ends = [[o + n for o, n in zip(b, m["shape"])] for b, m in zip(boxes, inner)]
    need(all(e <= n for end in ends for e, n in zip(end, head["shape"])), "a member lies beyond the head")
    if rule == "overlay":
        need(bool(inner) and inner[0]["shape"] == head["shape"], "an overlay begins with its base")
        return
    live = [(b, e) for b, e in zip(boxes, ends) if all(x < y for x, y in zip(b, e))]
    # sweep over the first axis: only boxes open at the same place are compared
    live.sort()
    open_: list = []
    for b, e in live:
        open_ = [o for o in open_ if o[1][0] > b[0]] if b else open_
        need(not any(all(max(x, y) < min(u, v) for x, y, u, v in zip(b, o[0], e, o[1])) for o in open_), "members overlap")
        open_.append((b, e))
    need(sum(math.prod(y - x for x, y in zip(b, e)) for b, e in live) == math.prod(head["shape"]), "members leave a gap")


def _row(item) -> tuple:
    at, _, d, code, buffers = item
    return at, str(d["type"]), d["shape"], d["layout"]["kind"], code, buffers


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.value = path, start, end


def _read_at(f) -> Callable[[int, int], bytes]:
    return lambda p, n: f.read_at(n, p)


def _ranges(path: str, start: int, end: int, limits: Limits) -> list[_Range]:
    """Runs of whole frames of about SPLIT bytes."""
    if end - start <= SPLIT:
        return [_Range(path, start, end)] if end > start else []
    fs, root = file_system(path)
    out, begin = [], start
    with fs.open_input_file(root) as f:
        for _, after, *_ in scan(_read_at(f), start, end, False, limits, payload=False):
            if after - begin >= SPLIT or after == end:
                out.append(_Range(path, begin, after))
                begin = after
    return out


class _Frames:
    """Reading of a range of whole frames, on an executor."""

    def read(self, partition) -> Iterator[tuple]:
        path, start, end = partition.value
        if end == start:
            return
        fs, root = file_system(path)
        with fs.open_input_file(root) as f:
            yield from map(_row, scan(_read_at(f), start, end, False, self.limits))


class _Batch(_Frames, DataSourceReader):
    def __init__(self, path: str, limits: Limits):
        self.path, self.limits = path, limits

    def partitions(self):
        sizes = [(f, file_system(f)) for f in files_of(self.path)]
        found = [r for f, (fs, root) in sizes for r in _ranges(f, 0, fs.get_file_info(root).size, self.limits)]
        return found or [_Range("", 0, 0)]


class _Live(_Frames, DataSourceStreamReader):
    def __init__(self, path: str, limits: Limits):
        self.path, self.limits, self.at = path, limits, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, root = file_system(self.path)
        with fs.open_input_file(root) as f:
            for _, self.at, *_ in scan(_read_at(f), self.at, f.size(), True, self.limits, payload=False):
                pass
        return {"at": self.at}

    def partitions(self, start: dict, end: dict):
        self.at = max(self.at, end["at"])
        return _ranges(self.path, start["at"], end["at"], self.limits)


@dataclass
class _Part(WriterCommitMessage):
    name: str | None


class _Writing:
    def __init__(self, folder: str, limits: Limits):
        self.folder, self.limits = folder.rstrip("/"), limits

    def write(self, rows) -> _Part:
        """One hidden file of a task's frames, each checked before it is written."""
        fs, root = file_system(self.folder)
        name, out = f"_{uuid.uuid4().hex}", None
        try:
            for r in rows:
                d, _ = decode(bytes(r["descriptor"]))
                data = frame(d, [bytes(b) for b in r["buffers"]], self.limits.cross_machine)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                out.write(data)
        finally:
            if out is not None:
                out.close()
        return _Part(name if out is not None else None)

    def show(self, messages, prefix: str) -> None:
        fs, root = file_system(self.folder)
        fs.create_dir(root, recursive=True)
        for f in files_of(self.folder):
            if f.rsplit("/", 1)[1].startswith(prefix):
                fs.delete_file(f"{root}/{f.rsplit('/', 1)[1]}")
        for k, name in enumerate(m.name for m in messages if m is not None and m.name):
            fs.move(f"{root}/{name}", f"{root}/{prefix}{k:06d}")

    def hide(self, messages) -> None:
        fs, root = file_system(self.folder)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{root}/{m.name}")


class _BatchWriter(_Writing, DataSourceWriter):
    def __init__(self, folder: str, limits: Limits, overwrite: bool):
        super().__init__(folder, limits)
        self.overwrite = overwrite

    def commit(self, messages) -> None:
        fs, root = file_system(self.folder)
        if self.overwrite:
            fs.create_dir(root, recursive=True)
            for f in files_of(self.folder):
                fs.delete_file(f"{root}/{f.rsplit('/', 1)[1]}")
        self.show(messages, f"part-{uuid.uuid4().hex}-")

    def abort(self, messages) -> None:
        self.hide(messages)


class _StreamWriter(_Writing, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        self.show(messages, f"batch-{batchId:012d}-")

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self.hide(messages)


class TensorStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensorstream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"], Limits.of(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Live(self.options["path"], Limits.of(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(self.options["path"], Limits.of(self.options), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(self.options["path"], Limits.of(self.options))


def register(spark) -> None:
    spark.dataSource.register(TensorStreamSource)
