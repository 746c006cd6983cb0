"""Composites in files and streams: a head, and after it its members in order, which may be composites themselves.

A tree is {"name", "head", "members"} or {"name", "tensor", "buffers"}; names matter in files alone. The
whole tree is checked before the first byte is written, and again when it is read. A composite that ends
too early, or is nested deeper than allowed, is an error; a head of no members is whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from gridloom.sources.descriptor import need
from gridloom.sources.tensorfile import file_system, read_entry, read_index, write_tensorfile
from gridloom.streaming.frames import assemble, check_members, write_stream

MAX_DEPTH = 64


def flatten(tree: dict, depth: int = MAX_DEPTH) -> Iterator[tuple[str, dict, list[bytes]]]:
    """(name, descriptor, buffers) of a head and all its members, in writing order."""
    if "tensor" in tree:
        yield tree.get("name", ""), tree["tensor"], tree["buffers"]
        return
    need(depth > 0, "composites are nested too deeply")
    need(tree["head"]["layout"]["kind"] == "composite" and tree["head"]["layout"]["members"] == len(tree["members"]), "members of the head")
    check_members(tree)
    yield tree.get("name", ""), tree["head"], []
    for m in tree["members"]:
        yield from flatten(m, depth - 1)


def write_composites(path: str, trees: list[dict], **options) -> None:
    """One file of composites and tensors."""
    write_tensorfile(path, [item for tree in trees for item in flatten(tree)], **options)


def write_composite_stream(path: str, trees: list[dict], append: bool = False) -> None:
    write_stream(path, [(d, buffers) for tree in trees for _, d, buffers in flatten(tree)], append)


def read_composite(path: str, head: str, depth: int = MAX_DEPTH) -> dict:
    """The tree of a head of one file, by names: members follow their head by place in the file, however the index is sorted. data of each tensor is its name, by which the payload is read."""
    fs, root = file_system(path)
    entries = sorted(read_index(path)[0], key=lambda e: e["offset"])
    at = next((k for k, e in enumerate(entries) if e["name"] == head), None)
    need(at is not None, f"no tensor {head}")
    with fs.open_input_file(root) as f:
        items = ((read_entry(f, e)[0], e["name"]) for e in entries[at:])
        tree = next(assemble(items, depth))
    need("head" in tree, f"{head} is not a composite")
    return tree


def tensors_of(tree: dict) -> list[str]:
    """Names of all tensors below a head, in order."""
    return [tree["data"]] if "tensor" in tree else [n for m in tree["members"] for n in tensors_of(m)]
