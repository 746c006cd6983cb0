"""Composites of a stream, put together as their members come: state of one composite at a time, by head."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from gridloom.sources.descriptor import decode
from gridloom.streaming.frames import check_members

#: head_id, ordinal (0: the head, then its members in order) and the descriptor's bytes.
INPUT = "head_id string, ordinal long, descriptor binary"
OUTPUT = "head_id string, rule string, members long, error string"
STATE = "ordinals array<long>, descriptors array<binary>"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = dict(zip(*state.get)) if state.exists else {}
    for part in frames:
        held |= {int(o): bytes(d) for o, d in zip(part["ordinal"], part["descriptor"])}
    head = decode(held[0])[0] if 0 in held else None
    if head is None or len(held) <= head["layout"]["members"]:
        state.update((list(held), list(held.values())))
        return
    state.remove()
    error = None
    try:
        check_members({"head": head, "members": [{"tensor": decode(held[k])[0]} for k in sorted(held) if k]})
    except ValueError as e:
        error = str(e)
    yield pd.DataFrame({"head_id": [key[0]], "rule": [head["layout"]["rule"]], "members": [len(held) - 1], "error": [error]})


def assemble_stream(rows: DataFrame) -> DataFrame:
    """A row for each composite whose last member has come, with what is wrong with it, if anything. A frame that comes twice counts once; torn composites stay in the state, where ``statestore`` shows them."""
    return rows.groupBy("head_id").applyInPandasWithState(_advance, OUTPUT, STATE, "append", "NoTimeout")
