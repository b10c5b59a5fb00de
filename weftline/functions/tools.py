"""Kinds and targets of tool calls, repository slugs, path mapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tool names of each kind, case-sensitive.
TOOL_KINDS = {
    "command": ("Bash", "PowerShell", "shell", "shell_command", "exec", "exec_command"),
    "file": ("Read", "Write", "Edit", "MultiEdit", "NotebookEdit", "ApplyPatch", "apply_patch", "view_image"),
    "query": ("Glob", "Grep", "Task", "Agent", "spawn_agent"),
    "web": ("WebFetch", "WebSearch", "web_fetch", "web_search"),
}
#: Input members that name the target, in order of preference.
TARGET_KEYS = ("path", "file_path", "filePath", "target", "command", "cmd", "url", "query", "pattern", "glob", "glob_pattern", "regex", "description")
TARGET_CHARS = 512


def tool_kind(name: Column) -> Column:
    out = F.lit("unknown")
    for kind, names in TOOL_KINDS.items():
        out = F.when(name.isin(*names), kind).otherwise(out)
    return out


def tool_target(kind: Column, input_json: Column) -> Column:
    """Target of a tool call from its JSON input: the first non-blank member, a string input itself, or the first file
    of a patch; unknown tools have none."""
    member = F.coalesce(*[F.nullif(F.trim(F.get_json_object(input_json, f"$.{k}")), F.lit("")) for k in TARGET_KEYS])
    text = F.when(input_json.startswith('"'), F.get_json_object(F.concat(F.lit("["), input_json, F.lit("]")), "$[0]")).when(~input_json.rlike(r"^\s*[{\[]"), input_json)
    patch = F.nullif(F.regexp_extract(text, r"(?s)\A\*\*\* Begin Patch.*?\n\*\*\* (?:Update|Add|Delete) File: ([^\n]+)", 1), F.lit(""))
    got = F.coalesce(member, F.trim(patch), F.when(~text.startswith("*** Begin Patch"), F.nullif(F.trim(text), F.lit(""))))
    return F.when(kind != "unknown", F.left(got, F.lit(TARGET_CHARS)))


def repo_slug(url: Column) -> Column:
    """host/owner/name of a remote address in any of its usual shapes, null if it isn't one."""
    u = F.rtrim(F.trim(url), F.lit("/"))
    part = r"([A-Za-z0-9][A-Za-z0-9.-]+)"
    tail = r"([^/:\\\s]+)/([^/:\\\s]+)\z"
    forms = [rf"\Ahttps?://(?:[^@/\s]+@)?{part}/{tail}", rf"\Assh://git@{part}/{tail}", rf"\Agit@{part}:{tail}", rf"\A{part}:{tail}", rf"\A{part}/{tail}"]
    out = F.lit(None).cast("string")
    for f in reversed(forms):
        name = F.regexp_replace(F.regexp_extract(u, f, 3), r"\.git\z", "")
        slug = F.concat_ws("/", F.lower(F.regexp_extract(u, f, 1)), F.regexp_extract(u, f, 2), name)
        out = F.when(u.rlike(f) & (name != "") & (F.length(F.regexp_extract(u, f, 1)) >= 2), slug).otherwise(out)
    return F.when((F.length(out) <= 255) & ~u.contains("\\"), out)


def normal_path(p: Column) -> Column:
    """Forward slashes, no doubled or trailing slash, no '.' steps, '..' steps resolved; drive letters upper case."""
    s = F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"(?<=.)/{2,}", "/")
    root = F.regexp_extract(s, r"\A(//|/|[A-Za-z]:/?)", 1)
    steps = F.filter(F.split(F.substring(s, F.length(root) + 1, F.lit(1 << 20)), "/"), lambda x: (x != "") & (x != "."))
    walked = F.reduce(steps, F.array().cast("array<string>"), lambda a, x: F.when(x != "..", F.concat(a, F.array(x))).when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a))
    head = F.when(root.rlike(r"\A[A-Za-z]:"), F.concat(F.upper(F.substring(root, 1, 1)), F.lit(":/"))).otherwise(root)
    return F.concat(head, F.array_join(walked, "/"))


def inside(p: Column, base: Column) -> Column:
    """The normalised path lies in the normalised folder or is it."""
    a, b = normal_path(p), F.rtrim(normal_path(base), F.lit("/"))
    return (a == b) | a.startswith(F.concat(b, F.lit("/")))


def remapped(p: Column, old: Column, new: Column) -> Column:
    """The path with its folder ``old`` moved to ``new``; paths elsewhere stay."""
    a, b = normal_path(p), F.rtrim(normal_path(old), F.lit("/"))
    return F.when(inside(p, old), F.concat(F.rtrim(normal_path(new), F.lit("/")), F.substring(a, F.length(b) + 1, F.length(a)))).otherwise(a)
