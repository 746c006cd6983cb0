"""Exact, cached use of tokenizer files: every distinct piece is encoded once by the library.

Both vocabularies split a text before merging, and never merge across the
boundaries used here (before white space and around newlines, in "byte" files where
they are single; between a letter and a mark), so the ids of a text are those of its
pieces in order. Texts with unusual white space or special strings are encoded whole.
A batch is cut into pieces, and their ids are laid out, in columns; Python sees each distinct piece of a batch once.
"""

from __future__ import annotations

import gc
import os
import string
import struct
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Pieces kept by a Python worker. Half of them are new or were met again since the other half was full; that one then goes.
CACHE_PIECES = 900_000
#: Strings joined for one call of the library.
JOINED = 256
#: White space before which, and marks after a letter before which, a text is cut: of class 1 and 2.
KINDS = np.zeros(256, np.uint8)
KINDS[list(b" \n\t\r\x0b\x0c")], KINDS[list(b".,!?:;&%$#*")] = 1, 2
#: Whether two bytes end with a letter of ASCII, or are a letter of two bytes.
LETTERS = np.zeros((256, 256), bool)
LETTERS[:, list(string.ascii_letters.encode())] = True
LETTERS[0xC2:0xE0, 0x80:0xC0] = [[bytes((a, b)).decode().isalpha() for b in range(0x80, 0xC0)] for a in range(0xC2, 0xE0)]
#: Characters on which Python and the tokenizers' patterns may disagree about white space, and special strings.
ODD = ["<|", *map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF])]
#: White space other than single spaces and newlines between visible characters.
LOOSE = ["  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c"]
#: Texts that are encoded whole, as a pattern of Arrow's.
WHOLE = {kind: "|".join("".join(rf"\x{{{ord(c):x}}}" for c in s) for s in found) + edges for kind, found, edges in (("word", ODD, ""), ("byte", ODD + LOOSE, r"|\A[ \n]|[ \n]\z"))}


#: Byte-level vocabularies write bytes as visible characters: those that aren't printable, in order, from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
VISIBLE = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
#: Single ids, packed.
PACKED = [struct.pack("<I", i) for i in range(1 << 16)]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.cache, self.older = Tokenizer.from_file(path), kind, {}, {}
        # between the strings of one call; texts that hold such strings are never cut into pieces
        self.end = "<|endoftext|>"
        self.end_id = self.tokenizer.token_to_id(self.end)

    def _pack(self, encoding) -> bytes:
        ids = encoding.ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, one after another, and the number of pieces before each text and in all."""
        _, starts, flat = texts.buffers()
        starts = np.frombuffer(starts, np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(flat or b"", np.uint8)[: starts[-1]]
        kinds, edge = KINDS[data], np.zeros(len(data) + 1, bool)
        marks = np.flatnonzero(kinds == 2)
        edge[marks] = LETTERS[data[np.maximum(marks, 2) - 2], data[marks - 1]]  # a text's first byte is an edge anyway, whatever stands before
        edge[:-1] |= kinds == 1
        edge[1:] |= data == 10
        edge[starts] = True
        edge[: starts[0]] = False
        edges = np.flatnonzero(edge)
        return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), flat or pa.py_buffer(b"")), np.searchsorted(edges, starts)

    def _unknown(self, pieces: Iterable[str]) -> list[str]:
        """Those in neither half of the cache; those of the older half are taken over."""
        words, older, out = self.cache, self.older, []
        for p in pieces:
            if p not in words:
                if (ids := older.get(p)) is None:
                    out.append(p)
                else:
                    words[p] = ids
        return out

    def _learn(self, pieces: list[str]) -> None:
        words, tokenize, byte, new = self.cache, self.tokenizer.model.tokenize, self.kind == "byte", []
        for x in pieces:  # a run of letters goes straight to the merges
            letters = x.lstrip()
            if not letters.isalpha():
                new.append(x)
            elif letters.isascii():
                words[x] = b"".join([PACKED[t.id] for t in tokenize(x.replace(" ", VISIBLE[32]) if byte else letters.lower())])
            elif byte or is_normalized("NFC", letters) and "\u03a3" not in letters and "\u0130" not in letters:
                found = tokenize((x if byte else letters.lower()).encode().decode("latin-1").translate(VISIBLE))
                words[x] = b"".join([PACKED[t.id] for t in found])
            else:
                new.append(x)
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            rows = [part[i : i + JOINED] for i in range(0, len(part), JOINED)]
            found = self.tokenizer.encode_batch_fast([self.end.join(row) for row in rows], add_special_tokens=False)
            for row, e in zip(rows, found):
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(ids == self.end_id).tolist()
                flat, start = ids.tobytes(), 0
                for x, cut in zip(row, [*cuts, len(ids)], strict=True):
                    words[x] = flat[4 * start : 4 * cut]
                    start = cut + 1

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of these distinct pieces."""
        if len(self.cache) > CACHE_PIECES // 2:
            self.cache, self.older = {}, self.cache
        new = self._unknown(pieces)
        if new:
            gc.disable()  # hundreds of thousands of small objects, none in a cycle
            self._learn(new)
            gc.enable()
        return list(map(self.cache.__getitem__, pieces))

    def _joined(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of texts that can be cut into pieces."""
        pieces, before = self._pieces(texts)
        coded = pieces.dictionary_encode()
        laid = pa.array(self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        _, starts, ids = laid.buffers()
        at = np.frombuffer(starts, np.int64, len(laid) + 1, 8 * laid.offset)[before].tolist()
        ids = memoryview(ids or b"")
        return (bytes(ids[a:b]) for a, b in zip(at, at[1:]))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """texts: strings without nulls."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, WHOLE[self.kind])
        joined = self._joined(column.filter(pc.invert(whole)))
        rest = iter(self.tokenizer.encode_batch_fast(column.filter(whole).to_pylist(), add_special_tokens=False))
        return [self._pack(next(rest)) if w else next(joined) for w in whole.to_pylist()]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per Python worker, so that later tasks start with a warm cache."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
