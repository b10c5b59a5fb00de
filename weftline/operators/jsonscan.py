"""Columnar JSON structure scan over Arrow string buffers.

A whole batch of JSON texts is tokenised at once from the bytes of its Arrow buffer: quotes, escapes, brackets
and scalars become numpy token arrays, every token gets the index of its enclosing container, and a grammar
check on neighbouring tokens decides which rows are whole JSON texts. Nothing is parsed row by row, so the
cost is a fixed number of passes over the bytes, whatever the shape of the records.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STRUCT = np.zeros(256, bool)
_STRUCT[[ord(c) for c in "{}[],:"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in " \t\r\n"]] = True
_ESC = np.zeros(256, bool)
_ESC[[ord(c) for c in '"\\/bfnrtu']] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_SCALAR = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"

OBJECT, ARRAY, STRING, NUMBER, BOOLEAN, NULL = range(6)
KIND_NAMES = np.array(["object", "array", "string", "number", "boolean", "null"], dtype=object)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, nulls as empty rows, without copying the text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return raw, (offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64))


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges [start, end) as an Arrow string array, gathered in one pass."""
    size = np.maximum(end - start, 0)
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    flat = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(data[flat]).tobytes())])
    return out.cast(pa.large_string(), safe=False)


@dataclass
class Tape:
    """Tokens of a batch in text order. ``parent`` is the token index of the enclosing container or -1."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    char: np.ndarray
    parent: np.ndarray
    key: np.ndarray  # token is a member name
    value: np.ndarray  # token starts a value
    kind: np.ndarray  # of values, else -1
    valid: np.ndarray  # per row: one whole JSON text
    rank: np.ndarray  # of a value among the values of its container

    def roots(self, rows: int) -> np.ndarray:
        """Token of the outermost value of each row, -1 where the row isn't a whole JSON object."""
        out = np.full(rows, -1, np.int64)
        top = np.flatnonzero(self.value & (self.parent < 0) & (self.kind == OBJECT))
        out[self.row[top]] = top
        out[~self.valid] = -1
        return out

    def names(self, keys: np.ndarray) -> pa.Array:
        """Decoded member names of the given key tokens."""
        return self.text(keys)

    def text(self, tokens: np.ndarray) -> pa.Array:
        """Decoded contents of string tokens (raw text of others); only those with escapes are decoded one by one."""
        inner = (self.char[tokens] == 34).astype(np.int64)
        raw = slices(self.data, self.start[tokens] + inner, self.end[tokens] - inner)
        mask = pc.match_substring(raw, "\\").to_numpy(zero_copy_only=False) & (inner == 1)
        if mask.any():
            some = raw.filter(pa.array(mask)).to_pylist()
            fixed = []
            for s in some:
                try:
                    fixed.append(json.loads(f'"{s}"').encode("utf-8", "replace").decode())
                except ValueError:
                    fixed.append(s)
            raw = pc.replace_with_mask(raw, pa.array(mask), pa.array(fixed, pa.large_string()))
        return raw

    def member(self, name: str) -> np.ndarray:
        """For each token: value token of its member ``name``, -1 if none; of repeated names the last holds."""
        out = np.full(len(self.row) + 1, -1, np.int64)
        want = np.frombuffer(name.encode(), np.uint8)
        keys = np.flatnonzero(self.key)
        size = self.end[keys] - self.start[keys] - 2
        plain = keys[size == len(want)]
        if len(plain):
            at = self.start[plain][:, None] + 1 + np.arange(len(want))
            plain = plain[(self.data[at] == want).all(axis=1)]
        odd = keys[size > len(want)]
        if len(odd):  # a name written with escapes
            raw = slices(self.data, self.start[odd] + 1, self.end[odd] - 1)
            odd = odd[pc.match_substring(raw, "\\").to_numpy(zero_copy_only=False)]
            if len(odd):
                odd = odd[np.array([x == name for x in self.text(odd).to_pylist()], bool)]
        hit = np.sort(np.concatenate([plain, odd])) if len(odd) else plain
        hit = hit[hit + 2 < len(self.row)]
        out[self.parent[hit]] = hit + 2
        return out

    def lists(self, tokens: np.ndarray) -> pa.ListArray:
        """Arrow list array with the element tokens of each array token in ``tokens`` (others get an empty list)."""
        kids = np.flatnonzero(self.value & (self.parent >= 0) & (self.char[self.parent] == 91))
        kids = kids[np.argsort(self.parent[kids], kind="stable")]
        first = np.searchsorted(self.parent[kids], tokens)
        last = np.searchsorted(self.parent[kids], tokens, "right")
        size = np.where(tokens >= 0, last - first, 0)
        off = np.zeros(len(tokens) + 1, np.int32)
        np.cumsum(size, out=off[1:])
        flat = np.repeat(first - off[:-1], size) + np.arange(off[-1])
        return pa.ListArray.from_arrays(pa.array(off), pa.array(kids[flat] if len(kids) else np.zeros(0, np.int64)))

    def children(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Value tokens inside the containers of valid rows, sorted by container, with container and name.

        The name is the decoded member name in an object (of repeated names only the last stays), the position in an array.
        """
        kids = np.flatnonzero(self.value & (self.parent >= 0) & self.valid[self.row])
        held = self.char[self.parent[kids]] == 123
        members = kids[held]
        names = self.text(members - 2)  # name, colon, value
        code = names.dictionary_encode().indices.to_numpy().astype(np.int64)
        order = np.lexsort((members, code, self.parent[members]))
        last = np.ones(len(order), bool)
        if len(order):
            a, b = order[:-1], order[1:]
            last[:-1] = (self.parent[members[a]] != self.parent[members[b]]) | (code[a] != code[b])
        stay = np.sort(order[last])
        items = kids[~held]
        toks = np.concatenate([members[stay], items])
        label = pa.concat_arrays([names.take(pa.array(stay)), pc.cast(pa.array(self.rank[items]), pa.large_string())])
        by = np.lexsort((toks, self.parent[toks]))
        return toks[by], self.parent[toks[by]], label.take(pa.array(by))


def scan(col: pa.Array) -> Tape:
    """Tokenise, nest and validate every text of the column."""
    data, off = buffers(col)
    n, rows = len(data), len(off) - 1
    begins = np.zeros(n + 1, bool)
    begins[off[:-1]] = True
    begins = begins[:n]
    bad = np.zeros(rows, bool)

    def row_of(pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(off, pos, "right") - 1

    # escapes: every second backslash of a run takes away the meaning of the byte after it
    bs = np.flatnonzero(data == 92)
    escaped = np.zeros(n + 1, bool)
    if len(bs):
        new = np.ones(len(bs), bool)
        new[1:] = (np.diff(bs) != 1) | begins[bs[1:]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(bs)), 0))
        lead = bs[(np.arange(len(bs)) - at) % 2 == 0]
        escaped[lead + 1] = True
        escaped[:n][begins] = False
    quotes = np.flatnonzero((data == 34) & ~escaped[:n])
    qrow = row_of(quotes)
    per_row = np.bincount(qrow, minlength=rows)
    bad |= per_row % 2 == 1
    rank = np.arange(len(quotes)) - (np.cumsum(per_row) - per_row)[qrow]
    opener = rank % 2 == 0
    o = quotes[opener]
    orow = qrow[opener]
    nxt = np.append(quotes, n)[np.flatnonzero(opener) + 1]
    c = np.minimum(nxt, off[orow + 1] - 1)  # an unclosed string ends with its row
    step = np.zeros(n + 1, np.int8)
    step[o] += 1
    np.add.at(step, c + 1, -1)
    inside = np.cumsum(step[:n], dtype=np.int8) > 0  # strings with both quotes

    if len(bs):
        tail = lead[inside[lead]]
        follow = np.minimum(tail + 1, n - 1)
        wrong = ~_ESC[data[follow]]
        uni = tail[data[follow] == 117]
        if len(uni):
            quad = np.minimum(uni[:, None] + np.arange(2, 6), n - 1)
            bad[row_of(uni[~_HEX[data[quad]].all(axis=1)])] = True
        bad[row_of(tail[wrong])] = True
        bad[row_of(lead[~inside[lead]])] = True
    bad[row_of(np.flatnonzero(inside & (data < 32)))] = True

    free = ~inside
    struct = np.flatnonzero(_STRUCT[data] & free)
    loose = free & ~_BLANK[data] & ~_STRUCT[data]
    head = loose.copy()
    head[1:] &= ~loose[:-1] | begins[1:]
    stop = loose.copy()
    stop[:-1] &= ~loose[1:] | begins[1:]
    s0, s1 = np.flatnonzero(head), np.flatnonzero(stop) + 1

    start = np.concatenate([struct, o, s0])
    end = np.concatenate([struct + 1, c + 1, s1])
    char = np.concatenate([data[struct], np.full(len(o), 34, np.uint8), np.full(len(s0), 118, np.uint8)])
    order = np.argsort(start, kind="stable")
    start, end, char = start[order], end[order], char[order]
    t = len(start)
    row = row_of(start)
    opens, closes = (char == 123) | (char == 91), (char == 125) | (char == 93)
    run = np.cumsum(opens.astype(np.int64) - closes)
    cnt = np.bincount(row, minlength=rows)
    first = np.cumsum(cnt) - cnt
    base = np.where(first > 0, np.append(run, 0)[np.maximum(first - 1, 0)], 0)
    depth = run - base[row]
    bad[row[depth < 0]] = True
    has = cnt > 0
    bad |= ~has
    last = np.minimum(first + cnt - 1, max(t - 1, 0))
    if t:
        bad[has & (depth[last] != 0)] = True

    # enclosing container: in the order of (row, depth, position) it is the last opening of that depth
    own = np.where(opens, depth - 1, np.where(closes, depth + 1, depth))
    top = int(max(depth.max(initial=0), own.max(initial=0))) + 3
    marks = np.flatnonzero(opens)
    key_all = np.concatenate([row[marks] * top + depth[marks], row * top + own]) + 1
    tok_all = np.concatenate([marks, np.arange(t)])
    is_mark = np.concatenate([np.ones(len(marks), bool), np.zeros(t, bool)])
    place = np.argsort(key_all * (t + 1) + tok_all if top * rows < 2**62 // (t + 2) else key_all, kind="stable")
    k, tk, mk = key_all[place], tok_all[place], is_mark[place]
    seen = np.maximum.accumulate(np.where(mk, np.arange(len(k)), -1)) if len(k) else np.zeros(0, np.int64)
    ok = (seen >= 0) & (k[np.maximum(seen, 0)] == k)
    holder = np.where(ok, tk[np.maximum(seen, 0)], -1)
    parent = np.full(t, -1, np.int64)
    parent[tk[~mk]] = holder[~mk]

    prev = np.full(t, 0, np.uint8)
    if t > 1:
        prev[1:] = np.where(row[1:] == row[:-1], char[:-1], 0)
    box = np.where(parent >= 0, char[np.maximum(parent, 0)], 0)
    value = opens | (char == 34) | (char == 118)
    key = (char == 34) & (box == 123) & ((prev == 123) | (prev == 44))
    value &= ~key
    prev_key = np.zeros(t, bool)
    prev_key[1:] = key[:-1] & (row[1:] == row[:-1])
    done = ((prev == 34) | (prev == 118) | (prev == 125) | (prev == 93)) & ~prev_key
    legal = np.where(
        value,
        np.where(box == 123, prev == 58, np.where(box == 91, (prev == 91) | (prev == 44), prev == 0)),
        np.where(key, True, np.where(char == 58, (box == 123) & prev_key, np.where(char == 44, (box != 0) & done, False))),
    )
    near = np.zeros(t, bool)
    near[1:] = parent[1:] == np.arange(t - 1)
    match = ((char == 125) & (box == 123)) | ((char == 93) & (box == 91))
    legal = np.where(closes, match & (near | done), legal)
    bad[row[~legal]] = True
    scal = np.flatnonzero(char == 118)
    if len(scal):
        good = pc.match_substring_regex(slices(data, start[scal], end[scal]), _SCALAR).to_numpy(zero_copy_only=False)
        bad[row[scal[~good]]] = True

    kind = np.full(t, -1, np.int8)
    lead_byte = data[start] if t else np.zeros(0, np.uint8)
    kind[value & (char == 123)] = OBJECT
    kind[value & (char == 91)] = ARRAY
    kind[value & (char == 34)] = STRING
    sv = value & (char == 118)
    kind[sv] = np.where(lead_byte[sv] == 110, NULL, np.where((lead_byte[sv] == 116) | (lead_byte[sv] == 102), BOOLEAN, NUMBER))

    rank = np.zeros(t, np.int64)
    v = np.flatnonzero(value)
    if len(v):
        vs = v[np.argsort(parent[v], kind="stable")]
        grp = np.ones(len(vs), bool)
        grp[1:] = parent[vs[1:]] != parent[vs[:-1]]
        rank[vs] = np.arange(len(vs)) - np.maximum.accumulate(np.where(grp, np.arange(len(vs)), 0))
    return Tape(data, row, start, end, char, parent, key, value, kind, ~bad, rank)
