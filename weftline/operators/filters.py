"""Search predicates and facets; all of them act before any cut by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other names of providers.
PROVIDER_ALIASES = {"claude": "claude-code", "grok": "grok-build", "kimi": "kimi-code", "codebuddy": "tencent-codebuddy"}
PROVIDERS = ("claude-code", "codex", "grok-build", "pi", "kimi-code", "qoder", "openclaw", "tencent-codebuddy", "opencode", "cline", "hermes", "antigravity", "cursor", "aider", "deepseek-harness", "zcode")


def providers(names: list[str]) -> list[str]:
    """Canonical provider ids, sorted and distinct; unknown names raise."""
    out = sorted({PROVIDER_ALIASES.get(n, n) for n in names})
    if unknown := [n for n in out if n not in PROVIDERS]:
        raise ValueError(f"unknown providers {unknown}")
    return out


def by_provider(messages: DataFrame, documents: DataFrame, names: list[str]) -> DataFrame:
    """Messages of any of the providers; ``documents`` has session_id and provider_id."""
    return messages.join(documents.where(F.col("provider_id").isin(*providers(names))).select("session_id"), "session_id", "left_semi")


def in_time(ts: Column, since=None, until=None) -> Column:
    """Half-open interval; rows without a time are outside any bound."""
    ok = F.lit(True)
    if since is not None:
        ok = ok & (ts >= F.lit(since))
    if until is not None:
        ok = ok & (ts < F.lit(until))
    return ok


def by_repo(messages: DataFrame, sessions: DataFrame, slug: str) -> DataFrame:
    return messages.join(sessions.where(F.col("repo_slug") == slug).select("session_id"), "session_id", "left_semi")


def visible(role: Column, include_system: bool = False) -> Column:
    """System and developer messages are hidden unless asked for; unknown roles stay."""
    return F.lit(True) if include_system else ~F.coalesce(role.isin("system", "developer"), F.lit(False))


def sidechain_facet(messages: DataFrame, placements: DataFrame, mode: str, key: str = "id") -> DataFrame:
    """include; main_only: no placement is a sidechain; subagent_only: at least one is."""
    side = placements.where("is_sidechain").select(key)
    if mode == "include":
        return messages
    if mode not in ("main_only", "subagent_only"):
        raise ValueError(f"unknown sidechain facet {mode}")
    return messages.join(side, key, "left_anti" if mode == "main_only" else "left_semi")


def tool_facet(messages: DataFrame, activities: DataFrame, kind: str | None = None, name: str | None = None, key: str = "id") -> DataFrame:
    """Messages with a tool activity of the kind and of the name (verbatim)."""
    if kind is not None and kind not in ("file", "command", "web", "query", "unknown"):
        raise ValueError(f"unknown tool kind {kind}")
    a = activities
    if kind is not None:
        a = a.where(F.col("kind") == kind)
    if name is not None:
        a = a.where(F.col("name") == name)
    return messages.join(a.select(key), key, "left_semi") if kind is not None or name is not None else messages


def validate_search(query: str, limit: int, since=None, until=None, max_bytes: int | None = None) -> None:
    """Raise on a blank query or one with control characters, a limit of zero, an empty interval or a budget below its floor."""
    if not query.strip():
        raise ValueError("the query is blank")
    if any(ord(c) < 32 or ord(c) == 127 for c in query):
        raise ValueError("the query holds control characters")
    if limit <= 0:
        raise ValueError("the limit must be positive")
    if since is not None and until is not None and not since < until:
        raise ValueError("since must be before until")
    if max_bytes is not None and max_bytes < 4096:
        raise ValueError("the byte budget must be at least 4096")
