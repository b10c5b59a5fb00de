"""Problem 6: schemas that drift between the files of a stream.

A file's footer (which fields it holds, with which JSON types) is gathered from the token tape of
:mod:`jsonscan`, reduced inside each batch and again map-side, so the shuffle carries a few hundred bytes per file
however many records it has. The column lifespan catalogue then works on footers alone: a field-type of a
producer is present in an island of consecutive files (found with ``lag`` and ``lead``); where an island starts
or ends, a change is logged. A start and an end of the same information at the same file are one rename: which
names carry the same information comes from an alias table, by default :data:`ALIASES`, and beyond it from the
name itself. The alias table also generates the casts that read all files into one table.

Defined results: null, blank and damaged lines hold no fields; a file without any whole record is still a file
of its stream; repeated lines change nothing; lines with a null stream_id or file_no are left out; the time of
export has no say in the order of files; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.operators import jsonscan as js
from weftline.operators.flatten import MARGIN
from weftline.session import spread

#: Canonical field -> the paths under which exports are known to carry the same information.
ALIASES: dict[str, tuple[str, ...]] = {
    "type": ("record_type", "recordType", "kind", "header.type"),
    "timestamp": ("created_at", "createdAt", "ts", "header.time"),
    "uuid": ("id", "message_uuid", "messageId", "message.id"),
    "parentUuid": ("parent_id", "parentId", "replyTo"),
    "sessionId": ("session_id", "conversationId", "sid", "session.id"),
    "isSidechain": ("is_sidechain", "sidechain", "flags.sidechain"),
    "message.role": ("role", "message.author", "message.speaker.role"),
    "message.content": ("content", "message.body", "message.parts", "message.content.text"),
    "message.model": ("model", "message.engine"),
    "message.stop_reason": ("stopReason", "message.finish"),
    "message.usage.input_tokens": ("usage.input_tokens", "message.usage.prompt_tokens"),
    "costUsd": ("cost_usd", "message.usage.cost"),
    "requestId": ("request_id", "message.requestId"),
    "gitBranch": ("git_branch", "env.branch"),
    "cwd": ("workdir", "working_directory", "env.cwd"),
    "version": ("client_version", "cliVersion"),
    "slug": ("title_slug", "sessionSlug"),
    "tags": ("labels", "message.tags"),
}
#: Canonical field -> type of its column in the unified table.
CASTS = {"timestamp": "timestamp", "isSidechain": "boolean", "message.usage.input_tokens": "bigint", "costUsd": "double"}


def _fields(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Distinct (stream, file, path, type) of a batch; a row with a null path says that the file exists."""
    stream, file_no, raw = batch.column(0), batch.column(1), batch.column(2)
    tape = js.scan(raw)
    root = tape.roots(batch.num_rows) if len(tape.row) else np.full(batch.num_rows, -1, np.int64)
    rows, paths, types = [np.arange(batch.num_rows)], [np.full(batch.num_rows, None, dtype=object)], [np.full(batch.num_rows, None, dtype=object)]
    keys = np.flatnonzero(tape.key)
    keys = keys[tape.valid[tape.row[keys]]]
    if len(keys):
        name = tape.names(keys).dictionary_encode()
        words, code = np.array(name.dictionary.to_pylist(), dtype=object), name.indices.to_numpy()
        holder = tape.parent[keys]
        prefix = np.full(len(tape.row), -1, np.int64)  # of objects reached through objects: index of their path
        seen: list[str] = [""]
        index = {"": 0}
        prefix[root[root >= 0]] = 0
        while True:
            now = prefix[holder]
            at = np.flatnonzero(now >= 0)
            if not len(at):
                break
            pair, inv = np.unique(now[at] * len(words) + code[at], return_inverse=True)
            full = []
            for p, w in zip(pair // len(words), pair % len(words)):
                path = f"{seen[p]}.{words[w]}" if seen[p] else words[w]
                if path not in index:
                    index[path] = len(seen)
                    seen.append(path)
                full.append(index[path])
            full = np.array(full)[inv]
            value = keys[at] + 2
            kind = tape.kind[value]
            leaf = (kind != js.OBJECT) & (kind != js.NULL)
            rows.append(tape.row[keys[at][leaf]])
            paths.append(np.array(seen, dtype=object)[full[leaf]])
            types.append(js.KIND_NAMES[kind[leaf]])
            keep = np.ones(len(keys), bool)
            keep[at] = False
            prefix[:] = -1
            nested = kind == js.OBJECT
            prefix[value[nested]] = full[nested]
            keys, code, holder = keys[keep], code[keep], holder[keep]
    row = pa.array(np.concatenate(rows))
    t = pa.table({"stream_id": stream.take(row), "file_no": file_no.take(row), "path": pa.array(np.concatenate(paths), pa.string()), "type": pa.array(np.concatenate(types), pa.string())})
    return t.group_by(["stream_id", "file_no", "path", "type"]).aggregate([])


def footers(df: DataFrame, json_col: str = "raw_json") -> DataFrame:
    """(stream_id, file_no, file_idx, last_idx, fields) with fields an array of struct(path, types), types a sorted list."""
    src = df.where(F.col("stream_id").isNotNull() & F.col("file_no").isNotNull()).select("stream_id", F.col("file_no").cast("int").alias("file_no"), F.btrim(F.col(json_col), F.lit(MARGIN)).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from _fields(b).to_batches()

    found = spread(src).mapInArrow(run, "stream_id string, file_no int, path string, type string")
    per_path = found.groupBy("stream_id", "file_no", "path").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    files = per_path.groupBy("stream_id", "file_no").agg(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "types"))).alias("fields"))
    w = Window.partitionBy("stream_id").orderBy("file_no")
    return files.select("*", F.row_number().over(w).alias("file_idx"), F.lag("file_no").over(w).alias("before"), F.lead("file_no").over(w).alias("after"))


def lifespans(foot: DataFrame) -> DataFrame:
    """Islands of consecutive files in which a producer writes a field with one set of types:
    (stream_id, path, types, first_file, last_file, n_files, opens, closes); opens/closes: not at an end of the stream."""
    f = foot.select("stream_id", "file_no", "file_idx", "before", "after", F.explode("fields").alias("f")).select("stream_id", "file_no", "file_idx", "before", "after", "f.path", "f.types")
    w = Window.partitionBy("stream_id", "path", "types").orderBy("file_idx")
    start = F.coalesce(F.col("file_idx") - F.lag("file_idx").over(w), F.lit(0)) != 1
    f = f.withColumn("island", F.sum(start.cast("int")).over(w))
    return f.groupBy("stream_id", "path", "types", "island").agg(
        F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"), F.count(F.lit(1)).alias("n_files"), F.min_by("before", "file_idx").isNotNull().alias("opens"), F.max_by("after", "file_idx").alias("ends_before")
    ).withColumn("closes", F.col("ends_before").isNotNull())


def concept(path: Column, aliases: Mapping[str, tuple[str, ...]] = ALIASES) -> Column:
    """The information a path carries: its canonical field, or for unknown names the last step without case,
    separators and the words that only say where a field belongs."""
    known = F.create_map(*[F.lit(x) for c, names in aliases.items() for n in (c, *names) for x in (n, c)])
    bare = F.regexp_replace(F.lower(F.regexp_replace(F.element_at(F.split(path, r"\."), -1), r"([a-z0-9])([A-Z])", "$1_$2")), r"^(?:is|has|client|cli|message|msg|session|record|header|title)_|[^\p{L}\p{N}]", "")
    return F.coalesce(F.try_element_at(known, path), F.concat(F.lit("~"), bare))


def changes(df: DataFrame, json_col: str = "raw_json", aliases: Mapping[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """(stream_id, file_no, old_path, new_path) of every change between neighbouring files of a stream."""
    spans = lifespans(footers(df, json_col))
    starts = spans.where("opens").select("stream_id", F.col("first_file").alias("file_no"), "path", F.lit(1).alias("starts"))
    ends = spans.where("closes").select("stream_id", F.col("ends_before").alias("file_no"), "path", F.lit(0).alias("starts"))
    log = starts.unionByName(ends).groupBy("stream_id", "file_no", "path").agg(F.max("starts").alias("new"), F.min("starts").alias("old"))
    retyped = log.where((F.col("new") == 1) & (F.col("old") == 0)).select("stream_id", "file_no", F.col("path").alias("old_path"), F.col("path").alias("new_path"))
    once = log.where(F.col("new") == F.col("old")).withColumn("concept", concept(F.col("path"), aliases))
    sides = once.groupBy("stream_id", "file_no", "concept").agg(F.array_sort(F.collect_list(F.when(F.col("new") == 0, F.col("path")))).alias("gone"), F.array_sort(F.collect_list(F.when(F.col("new") == 1, F.col("path")))).alias("come"))
    pairs = sides.select("stream_id", "file_no", F.explode(F.arrays_zip("gone", "come")).alias("p")).select("stream_id", "file_no", F.coalesce("p.gone", F.lit("")).alias("old_path"), F.coalesce("p.come", F.lit("")).alias("new_path"))
    return pairs.unionByName(retyped)


class _Raw(str):
    """A number as it is written."""


def _dump(v) -> str:
    if isinstance(v, list):
        return "[" + ",".join(map(_dump, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(x)}" for k, x in v.items()) + "}"
    return v if isinstance(v, _Raw) else json.dumps(v, ensure_ascii=False)


def _read(text: str, known: list[list[tuple[str, ...]]]) -> tuple[list[str | None], list[str | None], list[dict[str, str]]]:
    """One parse of a record: the text of each column, the path it was found under, and the fields that give no column
    its value (unknown ones, and names of a column that another name goes before)."""
    fix = lambda x: x.encode("utf-8", "replace").decode()
    leaves: dict[tuple[str, ...], object] = {}
    record = json.loads(text, strict=False, parse_int=_Raw, parse_float=_Raw)
    stack: list[tuple[tuple[str, ...], dict]] = [((), record)]
    while stack:
        steps, held = stack.pop()
        for k, v in held.items():
            if isinstance(v, dict):
                stack.append(((*steps, k), v))
            elif v is not None:
                leaves[*steps, k] = v

    def at(steps: tuple[str, ...]):
        x = record
        for k in steps:
            x = x.get(k) if isinstance(x, dict) else None
        return x

    values, paths = [], []
    for names in known:
        name = next((n for n in names if at(n) is not None), None)
        x = at(name) if name else None
        values.append(None if x is None else fix(x if isinstance(x, str) else _dump(x)))
        paths.append(".".join(name) if name else None)
        leaves.pop(name or (), None)
    return values, paths, [{"path": fix(".".join(k.replace("\\", "\\\\").replace(".", "\\.") for k in steps)), "value": fix(v if isinstance(v, str) else _dump(v))} for steps, v in sorted(leaves.items())]


def unified(df: DataFrame, json_col: str = "raw_json", aliases: Mapping[str, tuple[str, ...]] = ALIASES, casts: Mapping[str, str] = CASTS) -> DataFrame:
    """Every whole record read into one table: a column per canonical field (dots written as underscores), found under
    any of its names and cast to one type; values that do not fit give null. ``rest`` is a JSON object, from path to
    text, of all that the columns don't hold: unknown fields, second values of a column, values that do not fit; dots
    inside a name are written ``\\.``. It is null where nothing is left."""
    whole = df.withColumn("_r", F.btrim(F.col(json_col), F.lit(MARGIN)))
    whole = whole.where(F.try_parse_json("_r").isNotNull() & F.col("_r").startswith("{")).select("line_id", "stream_id", "file_no", "line_no", "_r")
    known = [[tuple(p.split(".")) for p in (*names[::-1], field)] for field, names in aliases.items()]
    entry = T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))
        for b in batches:
            read = [_read(t, known) for t in b.column("_r").to_pylist()]
            cols = [pa.array([r[0] for r in read], pa.list_(pa.string())), pa.array([r[1] for r in read], pa.list_(pa.string())), pa.array([r[2] for r in read], kind)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], "_values", "_paths", "_left"])

    text_list = T.ArrayType(T.StringType())
    fields = [T.StructField("_values", text_list), T.StructField("_paths", text_list), T.StructField("_left", T.ArrayType(entry))]
    whole = spread(whole).mapInArrow(run, T.StructType([*whole.schema.fields[:-1], *fields]))
    out, unfit = [], []
    for i, field in enumerate(aliases):
        text = F.get("_values", F.lit(i))
        kind = casts.get(field, "string")
        if kind == "timestamp":
            num = text.try_cast("double")
            value = F.coalesce(F.when(num.isNotNull(), F.timestamp_micros(F.when(F.abs(num) < 1e11, num * 1e6).when(F.abs(num) < 1e14, num * 1e3).otherwise(num).cast("bigint"))), text.try_cast("timestamp"))
        elif kind == "boolean":
            value = F.when(F.lower(text).isin("true", "1", "1.0", "yes"), True).when(F.lower(text).isin("false", "0", "0.0", "no"), False)
        else:
            value = text.try_cast(T._parse_datatype_string(kind)) if kind != "string" else text
        if kind != "string":
            unfit.append(F.when(text.isNotNull() & value.isNull(), F.struct(F.get("_paths", F.lit(i)).alias("path"), text.alias("value"))))
        out.append(value.alias(field.replace(".", "_")))
    left = F.concat("_left", F.filter(F.array(*unfit), lambda x: x.isNotNull())) if unfit else F.col("_left")
    rest = F.when(F.size(left) > 0, F.to_json(F.map_from_entries(left))).alias("rest")
    return whole.select("line_id", "stream_id", "file_no", "line_no", *out, rest)
