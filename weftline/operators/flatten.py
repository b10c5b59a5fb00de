"""Problem 1: deeply nested records to related flat tables.

``blocks``, ``records`` and ``members`` walk the token tape of :mod:`jsonscan` level by level. At each level the
contents of all records of the batch are one Arrow list array: ``list_flatten`` gives the child array,
``list_parent_indices`` the row of the level above it came from, and every key is carried down by ``take``. No shuffle
is needed; the work is linear in the bytes and a hot source spreads over as many tasks as it has file splits.

``records`` and ``blocks`` have a column for each usual scalar member. ``members`` leaves nothing out: every member of
any name, kind and depth is a row there, so the three tables together hold all of a record.

Defined results: a null, blank, cut-off or otherwise damaged text gives no rows; byte-order marks and blanks
around a text do not count; repeated lines give their rows each; a null element keeps its position but is no
block; of repeated member names the last holds; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import jsonscan as js
from weftline.session import spread

#: Characters around a record that are not part of it.
MARGIN = " \t\r\n\f\v\x00\x1e\u00a0\u200b\u2060\ufeff"
BLOCK_FIELDS = ("type", "text", "thinking", "id", "name", "tool_use_id", "signature", "title", "is_error")
RECORD_FIELDS = ("type", "uuid", "parentUuid", "sessionId", "timestamp", "cwd", "isSidechain", "isMeta", "summary", "leafUuid")
MEMBER_COLUMNS = ("line_id", "block_path", "member_path", "parent_path", "name", "kind", "value")


def _input(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    return spread(df.select(F.col(id_col).cast("bigint").alias("line_id"), F.btrim(F.col(json_col), F.lit(MARGIN)).alias("raw")))


def _content(tape: js.Tape, member: np.ndarray, holders: np.ndarray) -> pa.ListArray:
    """Content tokens of each holder as one list array: the elements of an array, else the single string or object."""
    tok = np.where(holders >= 0, member[holders], -1)
    kind = np.where(tok >= 0, tape.kind[np.maximum(tok, 0)], js.NULL)
    single = (kind == js.STRING) | (kind == js.OBJECT)
    inner = tape.lists(np.where(kind == js.ARRAY, tok, -1))
    size = np.diff(inner.offsets.to_numpy()) + single
    off = np.zeros(len(tok) + 1, np.int32)
    np.cumsum(size, out=off[1:])
    values = np.zeros(off[-1], np.int64)
    fill = np.ones(off[-1], bool)
    fill[off[:-1][single]] = False
    values[off[:-1][single]] = tok[single]
    values[fill] = inner.values.to_numpy()
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))


def _pick(tape: js.Tape, member: np.ndarray, tokens: np.ndarray) -> pa.Array:
    """Text of a scalar member of each object token, null where absent, null or a container."""
    tok = np.where(tape.kind[tokens] == js.OBJECT, member[tokens], -1)
    has = (tok >= 0) & np.isin(tape.kind[np.maximum(tok, 0)], (js.STRING, js.NUMBER, js.BOOLEAN))
    out = np.full(len(tokens), None, dtype=object)
    if has.any():
        out[has] = tape.text(tok[has]).to_numpy(zero_copy_only=False)
    return pa.array(out, pa.string())


def _levels(batch: pa.RecordBatch, fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    ids, raw = batch.column(0), batch.column(1)
    tape = js.scan(raw)
    if not len(tape.row):
        return
    content = tape.member("content")
    picked = {f: tape.member(f) for f in fields}
    root = tape.roots(len(raw))
    msg = np.where(root >= 0, tape.member("message")[root], -1)
    holders = np.where((msg >= 0) & (tape.kind[np.maximum(msg, 0)] == js.OBJECT), msg, -1)
    keys, paths, depth = ids, None, 0
    while (holders >= 0).any():
        nested = _content(tape, content, holders)
        tokens = pc.list_flatten(nested).to_numpy()
        above = pc.list_parent_indices(nested)
        place = np.arange(len(tokens)) - nested.offsets.to_numpy()[above.to_numpy()]
        real = tape.kind[tokens] != js.NULL
        tokens, above, place = tokens[real], above.filter(pa.array(real)), place[real]
        if not len(tokens):
            return
        keys = keys.take(above)
        step = pc.cast(pa.array(place), pa.string())
        before = paths.take(above) if paths is not None else pa.nulls(len(tokens), pa.string())
        paths = step if depth == 0 else pc.binary_join_element_wise(before, step, ".")
        kind = tape.kind[tokens]
        cols = [keys, paths, before, pa.array(np.full(len(tokens), depth, np.int32)), pa.array(place.astype(np.int32)), pa.array(js.KIND_NAMES[kind], pa.string())]
        for f in fields:
            got = _pick(tape, picked[f], tokens)
            if f == "text":
                alone = kind == js.STRING
                if alone.any():
                    got = pc.replace_with_mask(got, pa.array(alone), tape.text(tokens[alone]).cast(pa.string()))
            cols.append(got)
        yield pa.RecordBatch.from_arrays(cols, names=["line_id", "block_path", "parent_path", "depth", "position", "kind", *[f"block_{f}" for f in fields]])
        holders = np.where(kind == js.OBJECT, tokens, -1)
        depth += 1


def blocks(df: DataFrame, id_col: str = "line_id", json_col: str = "raw_json", fields: tuple[str, ...] = BLOCK_FIELDS) -> DataFrame:
    """Child table: one row for each content block at any depth, keyed by record and parent block.

    Columns: line_id, block_path, parent_path (null at the top), depth, position, kind, and block_<field> for
    each scalar member asked for; a block that is a bare string has it as block_text.
    """
    schema = "line_id bigint, block_path string, parent_path string, depth int, position int, kind string" + "".join(f", block_{f} string" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _levels(batch, fields)

    return _input(df, id_col, json_col).mapInArrow(run, schema)


def records(df: DataFrame, id_col: str = "line_id", json_col: str = "raw_json", fields: tuple[str, ...] = RECORD_FIELDS) -> DataFrame:
    """Parent table: one row for each text that is a whole JSON object, with its scalar members and message role."""
    schema = "line_id bigint" + "".join(f", {f} string" for f in fields) + ", role string, n_top_blocks int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tape = js.scan(batch.column(1))
            root = tape.roots(batch.num_rows) if len(tape.row) else np.full(batch.num_rows, -1)
            keep = np.flatnonzero(root >= 0)
            if not len(keep):
                continue
            root = root[keep]
            msg = tape.member("message")[root]
            holder = np.where((msg >= 0) & (tape.kind[np.maximum(msg, 0)] == js.OBJECT), msg, -1)
            role = np.full(len(keep), None, dtype=object)
            if (holder >= 0).any():
                role[holder >= 0] = _pick(tape, tape.member("role"), holder[holder >= 0]).to_numpy(zero_copy_only=False)
            nested = _content(tape, tape.member("content"), holder)
            solid = tape.kind[nested.values.to_numpy()] != js.NULL
            n = np.bincount(pc.list_parent_indices(nested).to_numpy()[solid], minlength=len(keep)).astype(np.int32)
            cols = [batch.column(0).take(pa.array(keep))] + [_pick(tape, tape.member(f), root) for f in fields] + [pa.array(role, pa.string()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(cols, names=["line_id", *fields, "role", "n_top_blocks"])

    return _input(df, id_col, json_col).mapInArrow(run, schema)


def _members(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    tape = js.scan(batch.column(1))
    if not len(tape.row):
        return
    root = tape.roots(batch.num_rows)
    rows = np.flatnonzero(root >= 0)
    toks, holder, label = tape.children()
    step = pc.cast(pc.replace_substring(pc.replace_substring(label, "~", "~0"), "/", "~1"), pa.string())
    name = pc.cast(label, pa.string())
    content = tape.member("content")
    msg = tape.member("message")[root[rows]]
    # tokens whose content holds blocks, and arrays whose elements are blocks
    holds, listed = np.zeros(len(tape.row), bool), np.zeros(len(tape.row), bool)
    msg = msg[msg >= 0]
    holds[msg[tape.kind[msg] == js.OBJECT]] = True

    keys, tokens = batch.column(0).take(pa.array(rows)), root[rows]
    block = pa.nulls(len(rows), pa.string())
    path = pa.array([""] * len(rows), pa.string())
    while len(tokens):
        first, last = np.searchsorted(holder, tokens), np.searchsorted(holder, tokens, "right")
        off = np.zeros(len(tokens) + 1, np.int32)
        np.cumsum(last - first, out=off[1:])
        nested = pa.ListArray.from_arrays(pa.array(off), pa.array(np.repeat(first - off[:-1], last - first) + np.arange(off[-1])))
        at, above = pc.list_flatten(nested), pc.list_parent_indices(nested)
        if not len(at):
            return
        here = at.to_numpy()
        up, tokens = tokens[above.to_numpy()], toks[here]
        kind = tape.kind[tokens]
        keys, block, before = keys.take(above), block.take(above), path.take(above)
        steps = step.take(at)
        path = pc.binary_join_element_wise(before, steps, "/")
        inner = holds[up] & (content[up] == tokens)
        listed[tokens[inner & (kind == js.ARRAY)]] = True
        alone = inner & ((kind == js.STRING) | (kind == js.OBJECT))
        is_block = alone | (listed[up] & (kind != js.NULL))
        holds[tokens[is_block & (kind == js.OBJECT)]] = True
        if is_block.any():
            place = pc.if_else(pa.array(alone), pa.scalar("0"), steps)
            below = pc.if_else(pc.is_null(block), place, pc.binary_join_element_wise(block, place, "."))
            block = pc.if_else(pa.array(is_block), below, block)
            before = pc.if_else(pa.array(is_block), pa.scalar(None, pa.string()), before)
            path = pc.if_else(pa.array(is_block), pa.scalar(""), path)
        value = np.full(len(tokens), None, dtype=object)
        plain = np.isin(kind, (js.STRING, js.NUMBER, js.BOOLEAN))
        if plain.any():
            value[plain] = tape.text(tokens[plain]).to_numpy(zero_copy_only=False)
        names = pc.if_else(pa.array(is_block), pa.scalar(None, pa.string()), name.take(at))
        out = pa.RecordBatch.from_arrays([keys, block, path, before, names, pa.array(js.KIND_NAMES[kind], pa.string()), pa.array(value, pa.string())], names=list(MEMBER_COLUMNS))
        shown = pa.array(~(is_block & (kind == js.OBJECT)))
        yield out.filter(shown)


def members(df: DataFrame, id_col: str = "line_id", json_col: str = "raw_json") -> DataFrame:
    """Child table: one row for every JSON value below a record or block, whatever its name, kind and depth.

    ``block_path`` is the block that holds the value, null for the record itself; ``member_path`` is the JSON pointer
    from there (RFC 6901), ``parent_path`` that of the enclosing value ('' is the record or block), ``name`` the member
    name or array position. ``value`` is the text of a scalar; objects, arrays and nulls have none. A block that is an
    object is a row of ``blocks`` only; any other block has itself at pointer '' (without parent or name).
    """
    schema = ", ".join(f"{c} {'bigint' if c == 'line_id' else 'string'}" for c in MEMBER_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _members(batch)

    return _input(df, id_col, json_col).mapInArrow(run, schema)
