"""Transcript adapters: one generator of events for each provider variant.

An event is a dict with ``event`` of 'message', 'activity', 'usage' or 'report'. Generators see the whole bytes of
one source; sources run in parallel (see :mod:`weftline.sources.ingest`). Malformed records are skipped and counted;
bytes that are no UTF-8 are fatal for the source.
"""

from __future__ import annotations

import json
import os
import re
import sqlite3
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from weftline.functions.tools import TARGET_CHARS, TARGET_KEYS, TOOL_KINDS
from weftline.sources.lines import JSON_CAP, SQLITE_CAP, lines

_KIND = {n: k for k, names in TOOL_KINDS.items() for n in names}


def tool_kind(name: str) -> str:
    return _KIND.get(name, "unknown")


def tool_target(kind: str, given) -> str | None:
    """Target of a tool call from its input value; unknown tools have none."""
    if kind == "unknown":
        return None
    if isinstance(given, str):
        try:
            loaded = json.loads(given)
            given = loaded if isinstance(loaded, dict) else given
        except ValueError:
            pass
    if isinstance(given, dict):
        for k in TARGET_KEYS:
            v = given.get(k)
            if isinstance(v, str) and v.strip():
                return v.strip()[:TARGET_CHARS]
        return None
    if isinstance(given, str) and given.strip():
        if given.startswith("*** Begin Patch"):
            m = re.search(r"^\*\*\* (?:Update|Add|Delete) File: (.+)$", given, re.M)
            return m[1].strip()[:TARGET_CHARS] if m else None
        return given.strip()[:TARGET_CHARS]
    return None


def flat(content, kinds: tuple[str, ...] = ("text",)) -> str:
    """Text of a content: a string, the blocks of an array or one block, joined by line breaks."""
    if isinstance(content, str):
        return content
    if isinstance(content, dict):
        content = [content]
    out = []
    for b in content if isinstance(content, list) else []:
        if isinstance(b, str):
            out.append(b)
        elif isinstance(b, dict) and b.get("type", "text") in kinds:
            t = b.get("thinking") if b.get("type") == "thinking" else b.get("text")
            if isinstance(t, str):
                out.append(t)
    return "\n".join(out)


def _text(v) -> str | None:
    return v if isinstance(v, str) else None


class Run:
    """Counts and numbering of one parse."""

    def __init__(self) -> None:
        self.seq = self.skipped = 0
        self.session = self.cwd = None

    def message(self, role: str, text: str, **more) -> dict:
        out = {"event": "message", "seq": self.seq, "role": role, "text": text, "is_sidechain": False, "session": self.session} | more
        self.seq += 1
        return out

    def report(self, **more) -> dict:
        return {"event": "report", "committed": self.seq, "skipped": self.skipped, "session": self.session, "cwd": self.cwd} | more

    def records(self, data: bytes) -> Iterator[tuple[int, int, dict]]:
        for start, end, _, raw in lines(data):
            if raw is None:
                self.skipped += 1
                continue
            text = raw.decode("utf-8")
            if not text.strip():
                continue
            try:
                rec = json.loads(text)
            except ValueError:
                rec = None
            if isinstance(rec, dict):
                yield start, end, rec
            else:
                self.skipped += 1


#: Openings of messages that tools write in the user's name.
_NOISE_TAGS = ("<system-reminder>", "<system-reminder ", "<local-command-caveat>", "Caveat:", "<local-command-stdout>", "<local-command-stderr>", "<bash-input>", "<bash-stdout>", "<bash-stderr>", "<user-prompt-submit-hook>", "<task-notification>")
_NOISE_WHOLE = ("[Request interrupted by user]", "[Request interrupted by user for tool use]")


def claude_noise(text: str) -> bool:
    t = text.strip()
    if t.startswith(_NOISE_TAGS) or t in _NOISE_WHOLE:
        return True
    if t.startswith("[Image:") and t.endswith("]"):
        return True
    return t.startswith("<command-name>") and not re.search(r"<command-args>\s*\S", t.split("</command-args>")[0] if "</command-args>" in t else t)


def _count(v) -> int | None:
    return 0 if v is None else v if isinstance(v, int) and not isinstance(v, bool) and v >= 0 else None


def claude(data: bytes) -> Iterator[dict]:
    run, open_tools, calls = Run(), {}, []
    for start, end, rec in run.records(data):
        msg = rec.get("message")
        if not isinstance(msg, dict):
            continue
        role = msg.get("role") or rec.get("type")
        if role not in ("user", "assistant", "system"):
            continue
        run.session, run.cwd = run.session or _text(rec.get("sessionId")), run.cwd or _text(rec.get("cwd"))
        content, parts, uses = msg.get("content"), [], []
        side = rec.get("isSidechain") is True
        anchor = _text(rec.get("uuid"))
        if isinstance(content, str):
            parts = [content]
        else:
            for b in content if isinstance(content, list) else []:
                if not isinstance(b, dict):
                    continue
                kind = b.get("type")
                if kind == "text" and isinstance(b.get("text"), str):
                    parts.append(b["text"])
                elif kind == "thinking" and isinstance(b.get("thinking"), str) and b["thinking"].strip():
                    parts.append(b["thinking"])
                elif kind == "tool_result":
                    body = flat(b.get("content"))
                    if body:
                        parts.append(body)
                    use = open_tools.pop(b.get("tool_use_id"), None)
                    if use:
                        use |= {"status": "error" if b.get("is_error") is True else "success", "anchor": anchor}
                elif kind == "tool_use" and isinstance(b.get("name"), str):
                    k = tool_kind(b["name"])
                    target = tool_target(k, b.get("input"))
                    uses.append(f"{b['name']}({target or ''})")
                    use = {"event": "activity", "kind": k, "name": b["name"], "target": target, "status": "unknown", "actor": "subagent" if side else "main", "anchor": anchor}
                    calls.append(use)
                    if b.get("id"):
                        open_tools[b["id"]] = use
        text = "\n".join(parts + uses)
        if role == "user" and claude_noise(text):
            run.skipped += 1
            continue
        meta = rec.get("isMeta") is True
        yield run.message(role, text, native_id=anchor, parent_native_id=_text(rec.get("parentUuid")), timestamp=None if meta else _text(rec.get("timestamp")), is_sidechain=side, span_start=start, span_end=end)
        u = msg.get("usage")
        if role == "assistant" and isinstance(u, dict):
            got = [_count(u.get(k)) for k in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")]
            if None not in got:
                yield {"event": "usage", "input_tokens": got[0], "output_tokens": got[1], "cache_read_tokens": got[2], "cache_write_tokens": got[3], "reasoning_tokens": 0, "token_source": "observed", "anchor": anchor}
    yield from calls
    yield run.report()


#: A total is an old one told again if it is at least this per cent of the last, or lacks at most so many turns.
STALE_PERCENT, STALE_TURNS = 98, 2


class UsageDeltas:
    """Cumulative token counts (input, cached, output, reasoning) to increments.

    A repeated total gives nothing, the first count of a fork is what it inherits, and a total that falls back a little
    was told before. Missing counts are zero; a count that is null, negative or no integer makes the whole object
    unreadable, and so do counts that are all zero.
    """

    KEYS = (("input_tokens",), ("cached_input_tokens", "cache_read_input_tokens"), ("output_tokens",), ("reasoning_output_tokens",))

    def __init__(self, forked: bool):
        self.inherits, self.base = forked, None

    @classmethod
    def read(cls, x) -> tuple[int, ...] | None:
        if not isinstance(x, dict):
            return None
        given = [[x[k] for k in names if k in x] for names in cls.KEYS]
        if any(not isinstance(v, int) or isinstance(v, bool) or v < 0 for vs in given for v in vs):
            return None
        got = tuple(max(vs, default=0) for vs in given)
        return got if any(got) else None

    def step(self, total: tuple | None, last: tuple | None) -> tuple | None:
        if self.inherits:
            self.inherits, self.base = False, total or last or self.base
            return None
        if total is None:
            if last is not None:
                self.base = last if self.base is None else tuple(a + b for a, b in zip(self.base, last))
            return last
        before = self.base
        if total == before:
            return None
        fell = before is not None and any(a < b for a, b in zip(total, before))
        if fell and (last is None or self._told_before(sum(total), sum(before), sum(last))):
            return None
        self.base = total
        return last or (total if before is None else tuple(a - b for a, b in zip(total, before)))

    @staticmethod
    def _told_before(now: int, before: int, turn: int) -> bool:
        return min(now, before, turn) > 0 and (now * 100 >= before * STALE_PERCENT or now + STALE_TURNS * turn >= before)


def codex(data: bytes) -> Iterator[dict]:
    run, calls, deltas, anchor = Run(), {}, UsageDeltas(False), None
    acts = []
    for start, end, rec in run.records(data):
        kind, p = rec.get("type"), rec.get("payload")
        if not isinstance(p, dict):
            continue
        if kind == "session_meta":
            run.session, run.cwd = _text(p.get("id")) or _text(p.get("session_id")), _text(p.get("cwd"))
            deltas = UsageDeltas(bool(p.get("forked_from_id")))
        elif kind == "event_msg" and p.get("type") == "token_count" and isinstance(p.get("info"), dict):
            got = deltas.step(UsageDeltas.read(p["info"].get("total_token_usage")), UsageDeltas.read(p["info"].get("last_token_usage")))
            if got:
                cached = min(got[1], got[0])
                yield {"event": "usage", "input_tokens": got[0] - cached, "output_tokens": got[2], "cache_read_tokens": cached, "cache_write_tokens": 0, "reasoning_tokens": got[3], "token_source": "derived", "anchor": anchor}
        elif kind == "response_item":
            t = p.get("type")
            if t == "message" and p.get("role") in ("user", "assistant", "developer", "system"):
                text = flat(p.get("content"), ("input_text", "output_text", "text"))
                if p["role"] == "user" and text.lstrip().startswith(("# AGENTS.md", "<environment_context>")):
                    run.skipped += 1
                    continue
                anchor = _text(p.get("id")) or anchor
                yield run.message(p["role"], text, native_id=_text(p.get("id")), span_start=start, span_end=end)
            elif t in ("function_call", "custom_tool_call") and isinstance(p.get("name"), str):
                k = tool_kind(p["name"])
                act = {"event": "activity", "kind": k, "name": p["name"], "target": tool_target(k, p.get("arguments", p.get("input"))), "status": "unknown", "actor": "main", "anchor": anchor}
                acts.append(act)
                calls[p.get("call_id")] = act
            elif t in ("function_call_output", "custom_tool_call_output") and p.get("call_id") in calls:
                calls.pop(p["call_id"])["status"] = "success"
    yield from acts
    yield run.report()


def grok(data: bytes) -> Iterator[dict]:
    run, out, numbered = Run(), [], False
    for start, end, rec in run.records(data):
        p = rec.get("params") if isinstance(rec.get("params"), dict) else {}
        u, meta = p.get("update") if isinstance(p.get("update"), dict) else {}, p.get("_meta") if isinstance(p.get("_meta"), dict) else {}
        kind = u.get("sessionUpdate")
        if kind == "rewind_marker":
            k, users = u.get("targetPromptIndex"), [i for i, m in enumerate(out) if m["role"] == "user"]
            if isinstance(k, int) and 0 <= k < len(users):
                del out[users[k] :]
        elif kind in ("user_message_chunk", "agent_message_chunk"):
            role = "user" if kind[0] == "u" else "assistant"
            index = meta.get("promptIndex")
            numbered = numbered or index is not None
            if role == "user" and (meta.get("bashCommand") or (numbered and index is None)):
                continue
            key = (role, index, meta.get("promptId"))
            if out and out[-1]["key"] == key:
                out[-1]["text"] += flat(u.get("content"))
                out[-1]["span_end"] = end
            else:
                out.append({"key": key, "role": role, "text": flat(u.get("content")), "span_start": start, "span_end": end})
    for m in out:
        yield run.message(m["role"], m["text"], span_start=m["span_start"], span_end=m["span_end"])
    yield run.report()


def antigravity(data: bytes) -> Iterator[dict]:
    run, roles = Run(), {"USER_EXPLICIT": "user", "MODEL": "assistant"}
    for start, end, rec in run.records(data):
        role = roles.get(rec.get("source"))
        text = next((rec[k] for k in ("content", "thinking") if isinstance(rec.get(k), str) and rec[k].strip()), None)
        if role is None or rec.get("type") == "CONVERSATION_HISTORY" or text is None:
            run.skipped += 1
            continue
        at = rec.get("created_at")
        ok = isinstance(at, str) and re.fullmatch(r"\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?(Z|z|[+-]\d\d:\d\d)", at)
        yield run.message(role, text, timestamp=at if ok else None, span_start=start, span_end=end)
    yield run.report()


def _headed(data: bytes, visible_only: bool, lineage: bool) -> Iterator[dict]:
    run = Run()
    for start, end, rec in run.records(data):
        if rec.get("type") == "session":
            run.session, run.cwd = _text(rec.get("id")), _text(rec.get("cwd"))
        elif rec.get("type") == "message" and isinstance(rec.get("message"), dict):
            m = rec["message"]
            text = flat(m.get("content"), ("text", "thinking") if lineage else ("text",))
            if m.get("role") not in ("user", "assistant") or (visible_only and not text.strip()):
                run.skipped += 1
                continue
            at = m.get("timestamp", rec.get("timestamp"))
            yield run.message(m["role"], text, native_id=_text(rec.get("id")), timestamp=_text(at), span_start=start, span_end=end)
    yield run.report()


def pi(data: bytes) -> Iterator[dict]:
    return _headed(data, False, True)


def openclaw(data: bytes) -> Iterator[dict]:
    return _headed(data, True, False)


def kimi(data: bytes) -> Iterator[dict]:
    run = Run()
    for start, end, rec in run.records(data):
        t = rec.get("type")
        if t == "append_message" and isinstance(rec.get("message"), dict) and rec["message"].get("role") in ("user", "assistant", "tool"):
            yield run.message(rec["message"]["role"], flat(rec["message"].get("content")), span_start=start, span_end=end)
        elif t in ("turn.prompt", "turn.steer"):
            yield run.message("user", flat(rec.get("input")), span_start=start, span_end=end)
        else:
            run.skipped += 1
    yield run.report()


def qoder(data: bytes) -> Iterator[dict]:
    run = Run()
    for start, end, rec in run.records(data):
        t = rec.get("type")
        if t == "session_meta":
            m = rec["session_meta"] if isinstance(rec.get("session_meta"), dict) else rec
            run.session, run.cwd = _text(m.get("session_id")), _text(m.get("cwd"))
        elif t in ("user", "assistant") and isinstance(rec.get("message"), dict):
            m = rec["message"]
            yield run.message(t, flat(m.get("content")), timestamp=_text(m.get("timestamp", rec.get("timestamp"))), span_start=start, span_end=end)
    yield run.report()


def codebuddy(data: bytes) -> Iterator[dict]:
    run, first = Run(), True
    for start, end, rec in run.records(data):
        if rec.get("type") != "message" or rec.get("role") not in ("user", "assistant"):
            continue
        run.session, run.cwd = run.session or _text(rec.get("sessionId")), run.cwd or _text(rec.get("cwd"))
        text = flat(rec.get("content"), ("text", "input_text", "output_text"))
        if rec["role"] == "user" and text.strip() and first:
            first = False
            if text.strip() == "code":
                run.skipped += 1
                continue
        yield run.message(rec["role"], text, timestamp=_text(rec.get("timestamp")), span_start=start, span_end=end)
    yield run.report()


def _whole(data: bytes):
    if len(data) > JSON_CAP:
        raise ValueError("the source is larger than 32 MiB")
    return json.loads(data.decode("utf-8-sig"))


def cline(data: bytes) -> Iterator[dict]:
    run = Run()
    for m in _whole(data):
        text = flat(m.get("content")) if isinstance(m, dict) else ""
        if not text.strip() or m.get("role") not in ("user", "assistant"):
            run.skipped += 1
            continue
        at = m.get("timestamp")
        yield run.message(m["role"], text, timestamp=at if isinstance(at, str) else None if at is None else "")
    yield run.report()


def hermes_json(data: bytes) -> Iterator[dict]:
    doc, run = _whole(data), Run()
    run.session = _text(doc.get("session_id"))
    for m in doc.get("messages") or []:
        text = flat(m.get("content"))
        if m.get("role") not in ("user", "assistant") or not text.strip():
            run.skipped += 1
            continue
        if isinstance(m.get("reasoning"), str) and m["reasoning"].strip():
            text = f"[thinking]\n{m['reasoning']}\n[/thinking]\n{text}"
        yield run.message(m["role"], text, timestamp=_text(m.get("timestamp")) or _text(doc.get("session_start")))
    yield run.report()


def aider(data: bytes) -> Iterator[dict]:
    """Markdown channels: a header opens a run, consecutive ``#### `` lines are one prompt, the rest is the answer."""
    run, role, text, at = Run(), None, [], None

    def flush() -> Iterator[dict]:
        body = "\n".join(text).strip()
        if role and body:
            yield run.message(role, body, timestamp=at)
        text.clear()

    for _, _, _, raw in lines(data):
        line = "" if raw is None else raw.decode("utf-8")
        if line.startswith("# aider chat started at "):
            yield from flush()
            role, at = None, line[24:].strip()
        elif line.startswith("#### "):
            if role != "user":
                yield from flush()
            role = "user"
            text.append(line[5:])
        elif line.startswith("> ") or line.strip() or role == "assistant":
            if role != "assistant" and line.strip():
                yield from flush()
                role = "assistant"
            text.append(line[2:] if line.startswith("> ") else line)
    yield from flush()
    yield run.report()


def _tables(data: bytes, queries: dict[str, str]) -> dict[str, list[sqlite3.Row]]:
    """Rows of a SQLite source, read from a private copy of its bytes."""
    if len(data) > SQLITE_CAP:
        raise ValueError("the source is larger than 128 MiB")
    fd, path = tempfile.mkstemp(suffix=".db")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        con = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
        con.row_factory = sqlite3.Row
        names = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        out = {k: con.execute(q).fetchall() if k in names else [] for k, q in queries.items()}
        con.close()
        return out
    finally:
        os.unlink(path)


def _millis(seconds) -> str | None:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{int(seconds * 1000) % 1000:03d}Z" if isinstance(seconds, (int, float)) else None


def opencode(data: bytes) -> Iterator[dict]:
    t, run = _tables(data, {"session": "SELECT * FROM session", "message": "SELECT * FROM message", "part": "SELECT * FROM part"}), Run()
    known = {r["id"]: r["directory"] for r in t["session"]}
    parts: dict[str, list] = {}
    for r in t["part"]:
        d = json.loads(r["data"])
        if d.get("type") == "text" and isinstance(d.get("text"), str):
            parts.setdefault(r["message_id"], []).append(((d.get("time") or {}).get("start", 0) or 0, r["id"], d["text"]))
    rows = sorted(((json.loads(r["data"]), r) for r in t["message"]), key=lambda x: ((x[0].get("time") or {}).get("created", 0), x[1]["id"]))
    for d, r in rows:
        if r["session_id"] not in known:
            raise ValueError("a message names an unknown session")
        body = "\n".join(x[2] for x in sorted(parts.get(r["id"], [])))
        if d.get("role") in ("user", "assistant"):
            yield run.message(d["role"], body, native_id=r["id"], session=r["session_id"], timestamp=_millis((d.get("time") or {}).get("created", 0) / 1000))
    yield run.report(sessions=len(known))


def hermes_db(data: bytes) -> Iterator[dict]:
    t, run = _tables(data, {"sessions": "SELECT * FROM sessions", "messages": "SELECT * FROM messages ORDER BY timestamp IS NULL, timestamp, id"}), Run()
    known = {r["id"] for r in t["sessions"]}
    for r in t["messages"]:
        if r["session_id"] not in known or r["role"] not in ("user", "assistant") or not (r["content"] or "").strip():
            run.skipped += 1
            continue
        text = r["content"]
        if "reasoning" in r.keys() and r["reasoning"]:
            text = f"[thinking]\n{r['reasoning']}\n[/thinking]\n{text}"
        yield run.message(r["role"], text, session=r["session_id"], timestamp=_millis(r["timestamp"]))
    yield run.report(sessions=len(known))


def cursor_chat(data: bytes) -> Iterator[dict]:
    t, run = _tables(data, {"ItemTable": "SELECT key, value FROM ItemTable"}), Run()
    for r in t["ItemTable"]:
        if not str(r["key"]).endswith("chatdata"):
            continue
        tabs = json.loads(r["value"]).get("tabs", [])
        for tab in sorted(tabs, key=lambda x: (x.get("createdAt") is None, x.get("createdAt") or 0)):
            for b in sorted(tab.get("bubbles", []), key=lambda x: (x.get("startTime") is None, x.get("startTime") or 0)):
                text = b.get("text") or b.get("rawText") or ""
                if text.strip():
                    at = b.get("startTime")
                    yield run.message("user" if b.get("type") == "user" else "assistant", text, session=_text(tab.get("tabId")), timestamp=None if at is None else str(at))
    yield run.report()


def cursor_kv(data: bytes) -> Iterator[dict]:
    t, run = _tables(data, {"cursorDiskKV": "SELECT key, value FROM cursorDiskKV"}), Run()
    kv = {str(r["key"]): r["value"] for r in t["cursorDiskKV"]}
    for key in sorted(k for k in kv if k.startswith("composerData:")):
        composer = key.split(":", 1)[1]
        try:
            headers = json.loads(kv[key]).get("fullConversationHeadersOnly") or []
        except (ValueError, AttributeError):
            run.skipped += 1
            continue
        for h in headers:
            try:
                b = json.loads(kv[f"bubbleId:{composer}:{h['bubbleId']}"])
            except (KeyError, TypeError, ValueError):
                run.skipped += 1
                continue
            tool = b.get("toolFormerData") or {}
            text = b.get("text") or (tool.get("rawArgs") if isinstance(tool, dict) else "") or ""
            if text.strip():
                yield run.message("user" if b.get("type") == 1 else "assistant", text, native_id=h["bubbleId"], session=composer)
    yield run.report()


@dataclass(frozen=True)
class Adapter:
    """A registered variant: ``probe`` gives 3 confirmed, 2 high, 1 low or 0 none for a path and the first bytes."""

    provider: str
    variant: str
    suffix: str
    probe: Callable[[str, bytes], int]
    parse: Callable[[bytes], Iterator[dict]]


def _sees(*marks: bytes, path: str = "", level: int = 3) -> Callable[[str, bytes], int]:
    def probe(p: str, head: bytes) -> int:
        got = all(m in head for m in marks)
        if path and path not in p:
            return 0
        return level if got else 0

    return probe


ADAPTERS: list[Adapter] = [
    Adapter("claude-code", "jsonl-v1", ".jsonl", _sees(b'"message"', b'"uuid"', b'"sessionId"'), claude),
    Adapter("codex", "rollout-jsonl-v1", ".jsonl", _sees(b'"payload"', b'"session_meta"'), codex),
    Adapter("grok-build", "acp-updates-v1", ".jsonl", _sees(b'"sessionUpdate"'), grok),
    Adapter("antigravity", "transcript-jsonl-v1", ".jsonl", _sees(b'"step_index"', b'"source"'), antigravity),
    Adapter("opencode", "sqlite-v1", ".db", _sees(b"SQLite format 3", path="opencode"), opencode),
    Adapter("pi", "session-jsonl-v1", ".jsonl", lambda p, h: 2 if b'"session"' in h and b'"cwd"' in h and "openclaw" not in p and b'"payload"' not in h else 0, pi),
    Adapter("hermes", "session-json-v1", ".json", _sees(b'"session_id"', b'"messages"'), hermes_json),
    Adapter("hermes", "sqlite-state-v1", ".db", _sees(b"SQLite format 3", path="hermes"), hermes_db),
    Adapter("cursor", "vscdb-chat-v1", ".vscdb", _sees(b"SQLite format 3", b"ItemTable", level=2), cursor_chat),
    Adapter("cursor", "disk-kv-v1", ".vscdb", _sees(b"SQLite format 3", b"cursorDiskKV"), cursor_kv),
    Adapter("kimi-code", "wire-jsonl-v1", ".jsonl", lambda p, h: 3 if b'"append_message"' in h or b'"turn.prompt"' in h else 0, kimi),
    Adapter("openclaw", "session-jsonl-v3", ".jsonl", _sees(b'"session"', path="openclaw"), openclaw),
    Adapter("qoder", "transcript-jsonl-v1", ".jsonl", _sees(b'"session_meta"', b'"session_id"', level=2), qoder),
    Adapter("tencent-codebuddy", "cli-jsonl-v1", ".jsonl", _sees(b'"type":"message"', b'"role"', b'"sessionId"', level=2), codebuddy),
    Adapter("cline", "api-conversation-history-v1", ".json", lambda p, h: 2 if h.lstrip()[:1] == b"[" and b'"role"' in h else 0, cline),
    Adapter("aider", "chat-history-md-v1", ".md", _sees(b"# aider chat started at"), aider),
]


def select(path: str, head: bytes, adapters: list[Adapter] | None = None) -> Adapter:
    """The adapter of highest confidence; several variants of the same confidence or none are refused."""
    compact = head.replace(b'": ', b'":')
    ranked = [(a.probe(path.lower(), compact), a) for a in (adapters or ADAPTERS) if path.endswith(a.suffix)]
    best = max((r for r, _ in ranked), default=0)
    hits = [a for r, a in ranked if r == best and r > 0]
    if len(hits) != 1:
        raise ValueError(f"{'no' if not hits else 'more than one'} adapter for {path}")
    return hits[0]
