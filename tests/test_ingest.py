import json
import os
import sqlite3
from datetime import UTC, datetime

import pytest

from weftline import api
from weftline.operators import canonical, reconcile
from weftline.sources import adapters, ingest, lines


def jl(*records):
    return "\n".join(json.dumps(r) if not isinstance(r, str) else r for r in records) + "\n"


CLAUDE = jl(
    {"type": "user", "uuid": "u1", "parentUuid": None, "sessionId": "s1", "cwd": "/w", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "please fix the rate limit in conf/limits.toml"}},
    {"type": "assistant", "uuid": "a1", "parentUuid": "u1", "sessionId": "s1", "timestamp": "2026-01-01T00:00:05Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "reading"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "conf/limits.toml"}}], "usage": {"input_tokens": 5, "output_tokens": 2}}},
    {"type": "user", "uuid": "u2", "parentUuid": "a1", "sessionId": "s1", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "limit = 5", "is_error": False}]}},
    {"type": "user", "uuid": "n1", "sessionId": "s1", "message": {"role": "user", "content": "<system-reminder>noise</system-reminder>"}},
    {"type": "assistant", "uuid": "a2", "parentUuid": "u2", "sessionId": "s1", "isSidechain": True, "timestamp": "2026-01-01T00:00:09Z", "message": {"role": "assistant", "content": "done 测试", "usage": {"input_tokens": -1}}},
    "", {"type": "summary", "summary": "x"}, "not json",
)


def events(parse, data):
    return list(parse(data if isinstance(data, bytes) else data.encode()))


def texts(parse, data):
    return [(e["role"], e["text"]) for e in events(parse, data) if e["event"] == "message"]


def test_lines():
    got = list(lines.lines("﻿a\r\nbé\n\nc".encode()))
    assert [(a, b, n, r) for a, b, n, r in got] == [(3, 4, 1, b"a"), (6, 9, 2, "bé".encode()), (10, 10, 3, b""), (11, 12, 4, b"c")]
    assert lines.health(b"") == "empty" and lines.health(b'{}\n{"a') == "partial" and lines.health(b'x\n{}') == "invalid" and lines.health(b"{}\n") == "clean"
    assert lines.valid_prefix(b'{}\n{"a') == b"{}\n"


def test_claude():
    ev = events(adapters.claude, CLAUDE)
    msgs = [e for e in ev if e["event"] == "message"]
    assert [m["native_id"] for m in msgs] == ["u1", "a1", "u2", "a2"]
    assert msgs[1]["text"] == "reading\nRead(conf/limits.toml)" and msgs[2]["text"] == "limit = 5" and msgs[3]["is_sidechain"]
    raw = CLAUDE.encode()
    assert json.loads(raw[msgs[1]["span_start"] : msgs[1]["span_end"]])["uuid"] == "a1"
    act = next(e for e in ev if e["event"] == "activity")
    assert (act["status"], act["anchor"], act["target"], act["kind"]) == ("success", "u2", "conf/limits.toml", "file")
    assert [e["input_tokens"] for e in ev if e["event"] == "usage"] == [5]
    rep = ev[-1]
    assert (rep["committed"], rep["skipped"], rep["session"], rep["cwd"]) == (4, 2, "s1", "/w")


def test_codex():
    tok = lambda i, o, last=None: {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": 1, "output_tokens": o, "reasoning_output_tokens": 0}}}}
    data = jl(
        {"type": "session_meta", "payload": {"id": "cs", "cwd": "/c"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "# AGENTS.md stuff"}]}},
        {"type": "response_item", "payload": {"type": "message", "id": "m1", "role": "user", "content": [{"type": "input_text", "text": "go"}]}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "go"}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "c1", "arguments": '{"command":"ls"}'}}, {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "x"}}, tok(10, 4), tok(10, 4), tok(15, 6),
    )
    ev = events(adapters.codex, data)
    assert texts(adapters.codex, data) == [("user", "go")]
    assert [(e["input_tokens"], e["output_tokens"]) for e in ev if e["event"] == "usage"] == [(9, 4), (5, 2)]
    act = next(e for e in ev if e["event"] == "activity")
    assert (act["status"], act["kind"], act["target"], act["anchor"]) == ("success", "command", "ls", "m1")


def test_other_line_formats():
    grok = jl(*[{"params": {"update": {"sessionUpdate": k, "content": {"type": "text", "text": t}, "targetPromptIndex": x}, "_meta": {"promptIndex": i}}} for k, t, i, x in (("user_message_chunk", "he", 0, None), ("user_message_chunk", "llo", 0, None), ("agent_message_chunk", "a", 0, None), ("user_message_chunk", "two", 1, None), ("rewind_marker", "", None, 1))])
    assert texts(adapters.grok, grok) == [("user", "hello"), ("assistant", "a")]
    anti = jl({"step_index": 0, "source": "USER_EXPLICIT", "content": "q", "created_at": "bad"}, {"step_index": 1, "source": "SYSTEM", "content": "s"}, {"step_index": 2, "source": "MODEL", "content": " ", "thinking": "t"})
    assert texts(adapters.antigravity, anti) == [("user", "q"), ("assistant", "t")]
    pi = jl({"type": "session", "id": "p", "cwd": "/p"}, {"type": "message", "id": "1", "message": {"role": "user", "content": [{"type": "thinking", "thinking": "h"}, {"type": "text", "text": "x"}]}}, "junk")
    assert texts(adapters.pi, pi) == [("user", "h\nx")] and texts(adapters.openclaw, pi) == [("user", "x")]
    kimi = jl({"type": "turn.prompt", "input": [{"type": "text", "text": "k"}]}, {"type": "append_message", "message": {"role": "assistant", "content": "r"}}, {"type": "loop", "x": 1})
    assert texts(adapters.kimi, kimi) == [("user", "k"), ("assistant", "r")]
    qoder = jl({"type": "session_meta", "session_meta": {"session_id": "q", "cwd": "/q"}}, {"type": "user", "message": {"content": "a"}}, {"type": "tool", "message": {"content": "b"}})
    assert texts(adapters.qoder, qoder) == [("user", "a")]
    buddy = jl({"type": "message", "role": "user", "content": " code ", "sessionId": "b"}, {"type": "message", "role": "user", "content": "code"}, {"type": "other"})
    assert texts(adapters.codebuddy, buddy) == [("user", "code")]
    cline = json.dumps([{"role": "user", "content": "a", "timestamp": 5}, {"role": "system", "content": "s"}, {"role": "assistant", "content": [{"type": "text", "text": "b"}, {"type": "text", "text": "c"}]}])
    assert texts(adapters.cline, cline) == [("user", "a"), ("assistant", "b\nc")] and events(adapters.cline, cline)[0]["timestamp"] == ""
    hermes = json.dumps({"session_id": "h", "session_start": "T", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "reasoning": "r"}]})
    assert texts(adapters.hermes_json, hermes)[1][1] == "[thinking]\nr\n[/thinking]\nb"
    aider = "# aider chat started at 2026-01-01 00:00:00\n\n#### first\n#### line\n\nanswer\n> quoted\n#### next\nyes\n"
    assert texts(adapters.aider, aider) == [("user", "first\nline"), ("assistant", "answer\nquoted"), ("user", "next"), ("assistant", "yes")]


def test_sqlite_formats(tmp_path):
    def db(name, *statements):
        p = tmp_path / name
        con = sqlite3.connect(p)
        for s, *args in statements:
            con.execute(s, args)
        con.commit()
        con.close()
        return p.read_bytes()

    data = db("o.db", ("CREATE TABLE session (id, title, directory)",), ("CREATE TABLE message (id, session_id, data)",), ("CREATE TABLE part (id, message_id, data)",), ("INSERT INTO session VALUES ('s', 't', '/d')",), ("INSERT INTO message VALUES ('m', 's', ?)", json.dumps({"role": "user", "time": {"created": 1767225600000}})), ("INSERT INTO part VALUES ('p2', 'm', ?)", json.dumps({"type": "text", "text": "b"})), ("INSERT INTO part VALUES ('p1', 'm', ?)", json.dumps({"type": "text", "text": "a"})))
    got = events(adapters.opencode, data)
    assert got[0]["text"] == "a\nb" and got[0]["timestamp"] == "2026-01-01T00:00:00.000Z" and got[0]["session"] == "s"
    data = db("h.db", ("CREATE TABLE sessions (id, started_at)",), ("CREATE TABLE messages (id, session_id, role, content, reasoning, timestamp)",), ("INSERT INTO sessions VALUES ('s', 0)",), ("INSERT INTO messages VALUES (2, 's', 'assistant', 'b', NULL, 2.5)",), ("INSERT INTO messages VALUES (1, 's', 'user', 'a', NULL, 1)",), ("INSERT INTO messages VALUES (3, 'x', 'user', 'orphan', NULL, 1)",))
    assert texts(adapters.hermes_db, data) == [("user", "a"), ("assistant", "b")]
    tabs = {"tabs": [{"tabId": "t2", "createdAt": None, "bubbles": [{"type": "ai", "rawText": "z"}]}, {"tabId": "t1", "createdAt": 1, "bubbles": [{"type": "ai", "text": "b", "startTime": 2}, {"type": "user", "text": "a", "startTime": 1}]}]}
    data = db("c.vscdb", ("CREATE TABLE ItemTable (key, value)",), ("INSERT INTO ItemTable VALUES ('workbench.aichat.chatdata', ?)", json.dumps(tabs)))
    assert texts(adapters.cursor_chat, data) == [("user", "a"), ("assistant", "b"), ("assistant", "z")]
    data = db("k.vscdb", ("CREATE TABLE cursorDiskKV (key, value)",), ("INSERT INTO cursorDiskKV VALUES ('composerData:c', ?)", json.dumps({"fullConversationHeadersOnly": [{"bubbleId": "2"}, {"bubbleId": "9"}, {"bubbleId": "1"}]})), ("INSERT INTO cursorDiskKV VALUES ('bubbleId:c:1', ?)", json.dumps({"type": 2, "text": "b"})), ("INSERT INTO cursorDiskKV VALUES ('bubbleId:c:2', ?)", json.dumps({"type": 1, "text": "a"})))
    assert texts(adapters.cursor_kv, data) == [("user", "a"), ("assistant", "b")]


def test_selection():
    assert adapters.select("/x/a.jsonl", CLAUDE.encode()).provider == "claude-code"
    with pytest.raises(ValueError):
        adapters.select("/x/a.jsonl", b'{"z":1}')


def test_discovery(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text("{}")
    (tmp_path / "y.jsonl").write_text("{}")
    (tmp_path / "n.txt").write_text("")
    os.symlink(tmp_path / "y.jsonl", tmp_path / "l.jsonl")
    got, whole = ingest.discover(str(tmp_path), ".jsonl")
    assert [os.path.relpath(p, tmp_path) for p in got] == ["a/x.jsonl", "y.jsonl"] and whole


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("src")
    (d / "one.jsonl").write_text(CLAUDE)
    (d / "two.jsonl").write_text(CLAUDE.replace('"s1"', '"s2"').replace('"u1"', '"v1"').replace('"a1"', '"b1"').replace('"u2"', '"v2"').replace('"a2"', '"b2"'))
    (d / "bad.jsonl").write_bytes(b'{"message": {"role": "user"}, "uuid": "q", "sessionId": "z"}\n\xff\xfe\n{}\n')
    snap = ingest.snapshots(spark, [str(d / n) for n in ("one.jsonl", "two.jsonl", "bad.jsonl")])
    store = reconcile.Store(spark, str(tmp_path_factory.mktemp("store")))
    store.commit({"events": ingest.parse(snap).coalesce(1)}, 0)
    made = vars(canonical.canonicalise(store.table("events")))
    store.commit({k: v.coalesce(1) for k, v in made.items()}, 1)
    return store, api.Engine(spark, canonical.Tables(**{k: store.table(k) for k in made}), datetime(2026, 1, 2, tzinfo=UTC), store.generation)


def test_canonical_tables(engine):
    ev, e = engine
    t = e.t
    assert t.messages.count() == 8 and t.sessions.count() == 2 and t.placements.count() == 8 and t.edges.count() == 6
    assert t.activities.count() == 2 and t.usage.count() == 2 and t.problems.count() == 1
    assert {r.id_state for r in t.claims.collect()} == {"resolved"}


def test_requests(engine):
    _, e = engine
    hits = e.search("rate limit").rows.collect()
    assert len(hits) == 2 and all(h.why_matched == ["rate", "limit"] and h.resume_available for h in hits) and hits[0].id < hits[1].id
    assert len(e.search("limits.toml").rows.collect()) == 4 and len(e.search("...").rows.collect()) == 0 and len(e.search("测试", sidechain="main_only").rows.collect()) == 0
    assert len(e.search("limit", tool_kind="file").rows.collect()) == 2
    assert e.search("limit", mode="semantic").warnings == ["lexical_fallback"]
    assert len(e.search("limit", providers=["codex"]).rows.collect()) == 0
    grouped = e.search("limit", group_by_session=True).rows.collect()
    assert sorted(h.occurrences for h in grouped) == [2, 2]
    with pytest.raises(api.InvalidRequest):
        e.search(" ")
    sid = e.t.sessions.orderBy("session_id").first().session_id
    line = e.context(sid).collect()
    assert [r.role for r in line] == ["user", "assistant", "user"]
    talks = e.context(sid, "talks").collect()
    assert [len(t.messages) for t in talks] == [2, 1]
    mid = line[1].message_id
    assert [r.position for r in e.message(mid, 1).collect()] == [0, 1, 2]
    with pytest.raises(api.NotFound):
        e.context("ses_v1_none")
    assert "claude --resume" in e.session_resume(sid).first().resume.command
    assert e.status().first().messages == 8
    got = e.get([mid, "msg_v1_zz", mid]).collect()
    assert [r.found for r in sorted(got, key=lambda r: r.pos)] == [True, False, True]
    assert len(e.list_sessions().collect()) == 2
    a = e.handoff("rate limit")
    assert a == e.handoff("rate limit") and json.loads(a)["confidence"] == "medium"
    assert json.loads(api.envelope(error=api.NotFound("x")))["error"]["code"] == "not_found"


def test_a_store_is_read_with_its_write_ahead_log(spark, tmp_path):
    path = tmp_path / "hermes.db"
    con = sqlite3.connect(path)
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("CREATE TABLE sessions(id TEXT, started_at REAL)")
    con.execute("CREATE TABLE messages(id INTEGER, session_id TEXT, role TEXT, content TEXT, timestamp REAL)")
    con.execute("INSERT INTO sessions VALUES ('s', 1.0)")
    con.commit()
    con.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    con.executemany("INSERT INTO messages VALUES (?, 's', 'user', ?, ?)", [(i, "text " * 200 + str(i), float(i)) for i in range(60)])
    con.commit()
    log = (tmp_path / "hermes.db-wal").read_bytes()
    (tmp_path / "plain.jsonl").write_text(CLAUDE)
    snap = ingest.snapshots(spark, [str(path), str(tmp_path / "plain.jsonl")]).collect()
    con.close()
    got = {os.path.basename(r.path): r for r in snap}
    assert set(got) == {"hermes.db", "plain.jsonl"} and len(log) > 10_000
    assert len(texts(adapters.hermes_db, bytes(got["hermes.db"].content))) == 60
    from weftline.sources.wal import merged

    empty = merged(path.read_bytes(), None)
    assert empty[18:20] == b"\x01\x01" and merged(b"", b"x") == b""
    torn = merged(bytes(got["hermes.db"].content), log[:-100])  # the last transaction isn't whole: it stays out
    assert torn == bytes(got["hermes.db"].content)


def test_pages_leave_nothing_out_and_end(engine):
    _, e = engine
    from weftline.operators import paging

    for budget, limit in ((paging.Budget(), 1), (paging.Budget(), 3), (paging.Budget(max_bytes=4096, snippet_chars=2000), 50)):
        want = [r.id for r in sorted(e.search("limit", limit=50).rows.collect(), key=lambda r: (-r.score, r.id))]
        got, cursor = [], None
        for _ in range(20):
            page = e.search("limit", limit=limit, budget=budget, cursor=cursor)
            rows = sorted(page.rows.collect(), key=lambda r: (-r.score, r.id))
            got += [r.id for r in rows]
            cursor = page.cursor
            if not cursor:
                break
            assert rows
        assert got == want and cursor is None


def test_usage_deltas():
    from weftline.sources.adapters import UsageDeltas as U

    read = lambda *v: U.read(dict(zip(("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"), v)))
    assert U.read({"input_tokens": 5, "cache_read_input_tokens": 3, "cached_input_tokens": 2}) == (5, 3, 0, 0)
    assert U.read({"input_tokens": None}) is None and U.read({"input_tokens": 0}) is None and U.read({"input_tokens": -1}) is None and U.read("x") is None
    d = U(True)  # a fork inherits its first count, be it a total or a turn
    assert d.step(None, read(7)) is None and d.step(read(10), None) == (3, 0, 0, 0)
    d = U(False)
    assert d.step(read(100, 0, 100), None) == (100, 0, 100, 0) and d.step(read(100, 0, 100), read(9)) is None
    assert d.step(read(99, 0, 100), read(1)) is None  # told before: 99.5 per cent of the last total
    assert d.step(read(60, 0, 70), read(40)) is None  # within two turns, over all four counts
    assert d.step(read(10, 0, 10), read(5)) == (5, 0, 0, 0) and d.step(read(15, 0, 12), None) == (5, 0, 2, 0)
    assert d.step(read(14, 0, 13), None) is None and d.step(None, read(2)) == (2, 0, 0, 0) and d.step(read(20, 0, 12), None) == (3, 0, 0, 0)


def test_store_and_reconcile(spark, tmp_path):
    s = reconcile.Store(spark, str(tmp_path / "store"))
    a = spark.createDataFrame([("p1", "m1"), ("p1", "m2"), ("p2", "m2")], "path string, message_id string")
    assert s.commit({"claims": a}, 0) == 1 and s.commit({}, 1) == 1
    with pytest.raises(RuntimeError):
        s.commit({"claims": a}, 0)
    new = spark.createDataFrame([("p1", "m3")], "path string, message_id string")
    whole = spark.createDataFrame([("p1", True)], "path string, complete boolean")
    part = spark.createDataFrame([("p1", False)], "path string, complete boolean")
    old = s.table("claims")
    assert [r.message_id for r in reconcile.tombstones(old, new, whole).collect()] == ["m1"]
    assert reconcile.tombstones(old, new, part).count() == 0
    nxt = reconcile.next_claims(old, new, whole)
    assert {tuple(r) for r in nxt.collect()} == {("p1", "m3"), ("p2", "m2")}
    assert s.commit({"claims": nxt}, 1) == 2 and len(s.vacuum()) == 1 and s.table("claims").count() == 2
    assert s.commit({"claims": s.table("claims").repartition(3)}, 2) == 2 and s.vacuum() == []  # the same rows: no generation
    late = reconcile.Store(spark, str(tmp_path / "store"))
    late.manifest = lambda g=None, m=s.manifest(): m  # a writer that read before the next commit
    assert s.commit({"claims": a}, 2) == 3
    with pytest.raises(reconcile.Conflict):
        late.commit({"claims": new}, 2)
    assert s.generation == 3 and s.table("claims").count() == 3 and len(s.vacuum()) == 1 and s.table("claims").count() == 3
    snap = spark.createDataFrame([("a", "f1", 5), ("b", "f2", 5), ("c", "f3", 0), ("d", "x", 0), ("e", "f5", 1)], "path string, fingerprint string, len int")
    state = spark.createDataFrame([("a", "f1", 1), ("b", "old", 1), ("c", "f3", 1), ("e", "f5", 0)], "path string, fingerprint string, parser_version int")
    assert {r.path: r.action for r in reconcile.classify(snap, state).collect()} == {"a": "unchanged", "b": "parse", "c": "withdraw", "d": "skip", "e": "reparse"}
    assert reconcile.removed_sources(state, snap.where("path <> 'a'"), True).count() == 1 and reconcile.removed_sources(state, snap.where("path <> 'a'"), False).count() == 0
