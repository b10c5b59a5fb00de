"""Context packs for another agent, resume commands and hook output."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as tx
from weftline.functions.tools import repo_slug  # noqa: F401 - part of this surface
from weftline.operators.redact import embedded

MAX_EVIDENCE, MAX_TOKENS, MAX_BYTES, SEARCH_LIMIT = 20, 8000, 2_000_000, 50
#: Fixed value: packs are dated from here by their generation.
EPOCH = datetime(2026, 8, 16, tzinfo=UTC)
#: How a session is taken up again; ID and DIR are filled in.
RESUME = {
    "claude-code": "claude --resume ID", "codex": "codex resume ID", "pi": "pi --session ID", "grok-build": "grok --resume ID", "antigravity": "agy --conversation ID",
    "kimi-code": "kimi --session ID", "tencent-codebuddy": "codebuddy --resume ID", "opencode": "opencode DIR --session ID",
}


def evidence(hits: DataFrame, max_evidence: int = MAX_EVIDENCE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Hits (rank, id, session_id, document_id, text) that have a source and text, redacted, within both budgets:
    the first ``max_evidence``, then the longest prefix whose estimated tokens fit."""
    d = hits.where(F.col("document_id").isNotNull() & (F.trim("text") != "")).withColumn("text", embedded(F.col("text")))
    d = d.orderBy("rank").limit(max_evidence).withColumn("tokens", tx.token_estimate(F.col("text")))
    used = F.sum("tokens").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))  # at most max_evidence rows
    return d.withColumn("used_tokens", used).where(F.col("used_tokens") <= max_tokens)


def mainline_preview(line: DataFrame, chars: int = 256) -> DataFrame:
    return line.select("session_id", "position", "id", F.left("text", F.lit(chars)).alias("preview"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("is_sidechain", F.lit(False)).alias("is_sidechain"))


def confidence(ev: DataFrame) -> DataFrame:
    """low without evidence, medium from several sessions, else high."""
    return ev.agg(F.count(F.lit(1)).alias("n_evidence"), F.count_distinct("session_id").alias("n_sessions")).select("*", F.when(F.col("n_evidence") == 0, "low").when(F.col("n_sessions") > 1, "medium").otherwise("high").alias("confidence"))


def pack(query: str, ev: DataFrame, generation: int, max_bytes: int = MAX_BYTES) -> str:
    """The pack as canonical JSON; evidence is dropped from its end until the bytes fit. The same input gives the same bytes."""
    rows = [r.asDict() for r in ev.orderBy("rank").collect()]  # at most max_evidence rows
    dropped: list[str] = []
    while True:
        sessions = {r["session_id"] for r in rows}
        body = {
            "query": query, "evidence": rows, "source_locators": list(dict.fromkeys(r["document_id"] for r in rows)), "dropped_locators": list(dict.fromkeys(dropped)),
            "confidence": "low" if not rows else "medium" if len(sessions) > 1 else "high", "created_at": (EPOCH + timedelta(seconds=generation)).strftime("%Y-%m-%dT%H:%M:%SZ"),
        }
        import hashlib

        text = json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)
        out = json.dumps({"pack_id": hashlib.sha256(text.encode()).hexdigest()[:32]} | body, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)
        if len(out.encode()) <= max_bytes or not rows:
            return out
        dropped.insert(0, rows.pop()["document_id"])


def resume_command(provider: Column, native_id: Column, id_state: Column, cwd: Column | None = None) -> Column:
    """struct(available, command, reason) of a session."""
    ok = tx.safe_token(native_id)
    template = F.create_map(*[F.lit(x) for kv in RESUME.items() for x in kv])
    t = F.try_element_at(template, provider)
    folder = F.coalesce(tx.shell_quote(cwd), F.lit("")) if cwd is not None else F.lit("")
    cmd = F.regexp_replace(F.replace(F.replace(t, F.lit("DIR"), folder), F.lit("ID"), ok), r" {2,}", " ")
    reason = F.when(t.isNull(), "the provider has no resume command").when(id_state != "resolved", F.concat(F.lit("the session id is "), id_state)).when(ok.isNull(), "the session id is not safe in a command")
    return F.struct(reason.isNull().alias("available"), F.when(reason.isNull(), cmd).alias("command"), reason.alias("reason"))


def suggestions(hit_id: Column, session: Column) -> Column:
    """At most two next commands of a hit."""
    both = F.array(F.concat(F.lit("show "), tx.shell_quote(hit_id)), F.when(session.isNotNull(), F.concat(F.lit("context "), tx.shell_quote(session))))
    return F.filter(both, lambda x: x.isNotNull())


def hook_query(payload: dict) -> str | None:
    """The query of a hook call: its prompt, else the last step of its folder; null if disabled or blank."""
    prompt = str(payload.get("prompt") or "").strip()
    return prompt or str(payload.get("cwd") or "").rstrip("/").rsplit("/", 1)[-1] or None


def hook_output(hits: DataFrame, max_tokens: int, header: str = "Earlier sessions") -> str:
    """Header and hit texts, cut to four characters a token."""
    rows = [r[0] for r in hits.orderBy("rank").limit(SEARCH_LIMIT).select("text").collect()]
    return "\n".join([header, *rows])[: max_tokens * 4] if rows else ""
