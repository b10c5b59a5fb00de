"""Sources to event tables: discovery, snapshots, parallel parsing."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import adapters as ad
from weftline.sources.lines import JSON_CAP, SQLITE_CAP, health, valid_prefix
from weftline.sources.wal import merged

#: Home-relative folders in which providers keep transcripts, with the suffix of their files.
ROOTS = {
    "claude-code": (".claude/projects", ".jsonl"), "codex": (".codex/sessions", ".jsonl"), "openclaw": (".openclaw/agents", ".jsonl"), "tencent-codebuddy": (".codebuddy/projects", ".jsonl"),
    "antigravity": (".gemini/antigravity", ".jsonl"), "opencode": (".local/share/opencode", ".db"), "pi": (".pi/agent/sessions", ".jsonl"), "hermes": (".hermes/sessions", ".json"),
    "grok-build": (".grok/sessions", ".jsonl"), "kimi-code": (".kimi/sessions", ".jsonl"), "qoder": (".qoder/projects", ".jsonl"), "cline": (".cline/data", ".json"),
}
PROBE = 64 << 10
#: Endings of sources that are SQLite files.
SQLITE_ENDS = (".db", ".vscdb")

EVENTS = (
    "path string, fingerprint string, len bigint, provider_id string, variant_id string, health string, event string, seq int, native_id string, parent_native_id string, role string, text string, timestamp string, is_sidechain boolean, "
    "session string, cwd string, span_start bigint, span_end bigint, kind string, name string, target string, status string, actor string, anchor string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, "
    "cache_write_tokens bigint, reasoning_tokens bigint, token_source string, committed int, skipped int, error string"
)
_COLS = [c.strip().split(" ")[0] for c in EVENTS.split(",")]
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.strip().split(" ")[0], _TYPES[c.strip().split(" ")[1]]) for c in EVENTS.split(",")])


def discover(root: str, suffix: str) -> tuple[list[str], bool]:
    """Files under a folder with the suffix, sorted, links not followed; and whether every folder could be read."""
    found, whole = [], True

    def failed(_: OSError) -> None:
        nonlocal whole
        whole = False

    for base, dirs, files in os.walk(root, onerror=failed, followlinks=False):
        dirs.sort()
        found += [os.path.join(base, f) for f in files if f.endswith(suffix) and not os.path.islink(os.path.join(base, f))]
    return sorted(found), whole


def distinct_paths(paths: list[str]) -> list[str]:
    """Paths in their order without repeats; folders are refused."""
    out = list(dict.fromkeys(os.path.abspath(p) for p in paths))
    if bad := [p for p in out if os.path.isdir(p)]:
        raise ValueError(f"folders are no sources: {bad}")
    return out


def snapshots(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, len, modified, fingerprint, content) of each file; a SQLite file comes with its write-ahead log merged in."""
    stores = [p for p in paths if p.endswith(SQLITE_ENDS)]
    d = spark.read.format("binaryFile").load([p for p in paths if p not in stores] + [p + "{,-wal}" for p in stores])
    d = d.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("modificationTime").alias("modified"), "content")
    if stores:
        log = d.where(F.col("path").endswith("-wal")).select(F.expr("left(path, length(path) - 4)").alias("path"), F.col("content").alias("log"), F.col("modified").alias("log_modified"))
        d = d.where(~F.col("path").endswith("-wal")).join(log, "path", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                whole = [merged(c, g) if p.endswith(SQLITE_ENDS) else c for p, c, g in zip(*(b[x].to_pylist() for x in ("path", "content", "log")))]
                yield pa.RecordBatch.from_arrays([b["path"], b["modified"], pa.array(whole, pa.binary())], names=["path", "modified", "content"])

        d = d.select("path", F.greatest("modified", "log_modified").alias("modified"), "content", "log").mapInArrow(run, "path string, modified timestamp, content binary")
    return d.select("path", F.octet_length("content").cast("bigint").alias("len"), "modified", F.sha2("content", 256).alias("fingerprint"), "content")


def unchanged_since(snap: DataFrame, paths: list[str]) -> DataFrame:
    """Snapshots whose file still has the same fingerprint; the drifted ones are left for the next run."""
    now = snapshots(snap.sparkSession, paths).select("path", F.col("fingerprint").alias("_now"))
    return snap.join(now, "path").where(F.col("fingerprint") == F.col("_now")).drop("_now")


def parse(snap: DataFrame, keep_truncated: bool = True) -> DataFrame:
    """Events of every source; each source is parsed in one task, sources in parallel. A fatal error gives one report
    with the error and nothing else of that source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, print_, data in zip(*(b[c].to_pylist() for c in ("path", "len", "fingerprint", "content"))):
                base = {"path": path, "fingerprint": print_, "len": size}
                rows = []
                try:
                    if size > (SQLITE_CAP if data[:6] == b"SQLite" else JSON_CAP * 32 if path.endswith(".jsonl") else JSON_CAP):
                        raise ValueError("the source is too large")
                    a = ad.select(path, data[:PROBE])
                    base |= {"provider_id": a.provider, "variant_id": f"{a.provider}/{a.variant}"}
                    if a.suffix == ".jsonl":
                        base["health"] = health(data)
                        if base["health"] == "partial" and keep_truncated:
                            data = valid_prefix(data)
                    for e in a.parse(data):
                        rows.append(base | e)
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a source stays with it
                    rows = [base | {"event": "report", "committed": 0, "skipped": 0, "error": f"{type(e).__name__}: {e}"[:500]}]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in _COLS} for r in rows[k : k + 10_000]], schema=_SCHEMA)

    return snap.select("path", "len", "fingerprint", "content").mapInArrow(run, EVENTS)


def fingerprint(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
