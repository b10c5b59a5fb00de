"""Bounded line reader with byte places, and the health of a line file."""

from __future__ import annotations

import json
from collections.abc import Iterator

RECORD_CAP = 8 << 20
JSON_CAP = 32 << 20
SQLITE_CAP = 128 << 20


def lines(data: bytes, cap: int = RECORD_CAP) -> Iterator[tuple[int, int, int, bytes | None]]:
    """(start, end, number, bytes) of each line, numbers from 1, without byte-order mark and line ends; a line beyond
    the cap comes with None."""
    at, number = 0, 0
    while at < len(data):
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        number += 1
        begin = at + 3 if number == 1 and data[:3] == b"\xef\xbb\xbf" else at
        end = stop - 1 if stop > begin and data[stop - 1 : stop] == b"\r" else stop
        yield begin, end, number, data[begin:end] if end - begin <= cap else None
        at = stop + 1


def health(data: bytes) -> str:
    """'empty'; 'clean': all lines are JSON; 'partial': only the last is not; 'invalid': an earlier one is not."""
    state = []
    for _, _, _, raw in lines(data):
        if raw is None:
            state.append(False)
        elif raw.strip():
            try:
                json.loads(raw)
                state.append(True)
            except ValueError:
                state.append(False)
    if not state:
        return "empty"
    if all(state):
        return "clean"
    return "partial" if all(state[:-1]) and len(state) > 1 else "invalid"


def valid_prefix(data: bytes) -> bytes:
    """The bytes before the first line that isn't JSON."""
    for start, _, _, raw in lines(data):
        if raw is None:
            return data[:start]
        if raw.strip():
            try:
                json.loads(raw)
            except ValueError:
                return data[:start]
    return data
