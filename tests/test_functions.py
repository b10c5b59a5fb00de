from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.functions import ids, instant, tools
from weftline.functions import text as tx
from weftline.operators import paging, redact


def one(spark, col, **values):
    d = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return d.select(col.alias("x")).first().x


def test_cjk(spark):
    assert one(spark, tx.cjk_tokens(F.col("t")), t="a 配置b 界") == "a 配 置 配置 b 界"
    assert one(spark, tx.cjk_bigrams(F.col("t")), t="a 配置项b 界") == "a 配置 置项 b 界"
    assert one(spark, tx.cjk_tokens(F.col("t")), t="no  han  here") == "no  han  here"


def test_literal_query():
    assert tx.word_phrases('mcp.json OR "x-y" ... NOT*') == [["mcp", "json"], ["or"], ["x", "y"], ["not"]]


def test_terms_and_evidence(spark):
    assert one(spark, tx.literal_terms(F.col("q")), q="B b 配置项 ... a1 B") == ["B", "b", "配置", "置项", "a1"]
    terms = F.array(F.lit("Limit"), F.lit("zz"))
    assert one(spark, tx.why_matched(terms, F.col("a"), F.col("b")), a="none", b="the limit") == ["Limit"]
    assert one(spark, tx.why_matched(terms, F.col("a")), a="none") == []


def loop_snippet(text, terms, m):
    low = text.lower()
    best = min(((low.find(t), i, t) for i, t in enumerate(terms) if low.find(t) >= 0), default=None)
    if best is None:
        return text[:m]
    s, e = best[0], best[0] + len(best[2])
    if e - s >= m:
        return text[s : s + m]
    a, b = s, e
    while b - a < m and (a > 0 or b < len(text)):
        for step in (1, 1, -1):
            if b - a >= m:
                break
            if step > 0 and b < len(text):
                b += 1
            elif step < 0 and a > 0:
                a -= 1
    return text[a:b]


def test_snippet_equals_the_loop(spark):
    rows = [("x" * i + "key" + "y" * j, m) for i in (0, 1, 5, 20, 40) for j in (0, 1, 7, 30) for m in (2, 3, 10, 25, 100)]
    for m in {m for _, m in rows}:
        texts = [t for t, k in rows if k == m] + ["nothing here at all"]
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.snippet(F.col("t"), F.array(F.lit("key"), F.lit("yyy")), m).alias("s")).collect()
        for r in got:
            assert len(r.s) == len(loop_snippet(r.t, ["key", "yyy"], m)) and r.s in r.t


def test_small_functions(spark):
    assert one(spark, tx.json_len(F.col("t")), t='a"\\\n') == 2 + 4 + 2 + 5
    assert one(spark, tx.token_estimate(F.col("t")), t="配置abcde") == 4
    assert one(spark, tx.shell_quote(F.col("t")), t="it's") == "'it'\\''s'"
    assert one(spark, tx.shell_quote(F.col("t")), t="a/b.c") == "a/b.c"
    assert one(spark, tx.percent_decode(F.col("t")), t="a%20b") == "a b"
    assert one(spark, tx.content_text(F.col("t")), t='[{"type":"text","text":"a"},{"type":"x","text":"no"},{"text":"b"}]') == "a\nb"
    assert one(spark, tx.from_base64url(tx.base64url(F.encode(F.lit("a?>b"), "UTF-8")))) == b"a?>b"


def test_ids(spark):
    a = one(spark, ids.derive("message", F.lit("ab"), F.lit("c")))
    assert a.startswith("msg_v1_") and a != one(spark, ids.derive("message", F.lit("a"), F.lit("bc")))
    for text, ok in (("x", True), ("", False), ("a b", False), ("a\n", False), ("x" * 256, True), ("x" * 257, False)):
        assert one(spark, ids.native_ok(F.col("t")), t=text) is ok
    assert one(spark, ids.wire_kind(F.lit("ses_v1_q"))) == "session" and one(spark, ids.wire_kind(F.lit("ses_v1_"))) is None


@pytest.mark.parametrize(
    ("text", "lenient", "strict"),
    [
        ("2026-01-01T00:00:00Z", (1767225600, 0), True), ("2026-01-01T00:00:00", (1767225600, 0), False), ("20260101T010000+0100", None, True), ("2026-01-01T00:00:00.1234567890Z", (1767225600, 123456789), True),
        ("2026-01-01T00:00:00.1234567891Z", (1767225600, 123456789), False), ("2026-02-30T00:00:00Z", None, False), ("2026-01-01T24:00:00Z", None, False), ("junk", None, False), (None, None, False),
    ],
)
def test_instants(spark, text, lenient, strict):
    got = one(spark, instant.lenient(F.lit(text).cast("string")))
    assert (tuple(got) if got else None) == lenient
    assert (one(spark, instant.strict(F.lit(text).cast("string"))) is not None) is strict


def test_relative():
    now = datetime(2026, 1, 10, tzinfo=UTC)
    assert instant.relative("3d", now) == now - timedelta(days=3) and instant.relative("2w", now) == now - timedelta(days=14)
    assert instant.relative("0h", now) is None and instant.relative("3x", now) is None


def test_tools(spark):
    assert one(spark, tools.tool_kind(F.lit("Bash"))) == "command" and one(spark, tools.tool_kind(F.lit("bash"))) == "unknown"
    assert one(spark, tools.tool_target(F.lit("file"), F.lit('{"file_path":" ","pattern":"p","path":"a.rs"}'))) == "a.rs"
    assert one(spark, tools.tool_target(F.lit("file"), F.lit("*** Begin Patch\n*** Update File: x/y.py\n"))) == "x/y.py"
    assert one(spark, tools.tool_target(F.lit("unknown"), F.lit('{"path":"a"}'))) is None
    for url, slug in (("git@h.example:a/b.git", "h.example/a/b"), ("https://u@h.example/a/b/", "h.example/a/b"), ("https://h.example:80/a/b", None), ("C:\\x\\y", None), ("https://h.example/a/b/c", None)):
        assert one(spark, tools.repo_slug(F.lit(url))) == slug
    assert one(spark, tools.normal_path(F.lit("c:\\a\\.\\b\\..\\c\\"))) == "C:/a/c"
    assert one(spark, tools.remapped(F.lit("/a/b/c"), F.lit("/a/b/"), F.lit("/z"))) == "/z/c" and one(spark, tools.remapped(F.lit("/a/bc"), F.lit("/a/b"), F.lit("/z"))) == "/a/bc"


def test_redaction(spark):
    hexes = "0123456789abcdef" * 2
    cases = {
        f"key sk-{hexes} end": "key [REDACTED] end", f'token = "{hexes}01234567"': f'token = "{hexes}01234567"', "Bearer abcd1234": "Bearer [REDACTED]", f"xsk-{hexes}": f"xsk-{hexes}", "AKIA" + "A" * 16: "[REDACTED]", "sk-12": "sk-12",
        "glpat-" + "a1" * 10: "[REDACTED]", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY": "[REDACTED]",
    }
    for text, want in cases.items():
        assert one(spark, redact.embedded(F.lit(text))) == want
    assert one(spark, redact.embedded_count(F.lit(f"sk-{hexes} and sk-{hexes} [REDACTED]"))) == 2
    d = spark.createDataFrame([(1, '{"password":"x","n":{"api_key":"y","input_tokens":"5"},"token":3}'), (2, "no json"), (3, None)], "id bigint, j string")
    got = {r.id: (r.json, r.n_blanked) for r in redact.json_tree(d, "j", "id").collect()}
    assert got == {1: ('{"password":"[REDACTED]","n":{"api_key":"[REDACTED]","input_tokens":"5"},"token":3}', 2), 2: ("no json", 0), 3: (None, 0)}


def test_cursors():
    now = datetime(2026, 1, 1, tzinfo=UTC)
    t = paging.make_cursor(20, "d", 3, "lexical", now)
    assert paging.read_cursor(t, "d", 3, "lexical", now)["offset"] == 20
    for args, why in (((t, "d", 3, "lexical", now + timedelta(minutes=15)), "expired"), ((t, "d", 4, "lexical", now), "generation"), ((t, "e", 3, "lexical", now), "query"), ((t[:-1] + "0", "d", 3, "lexical", now), "tampered"), (("x", "d", 3, "l", now), "malformed")):
        if args[0] == t or why in ("malformed",) or args[0] != t:
            with pytest.raises(paging.CursorError, match=why):
                paging.read_cursor(*args)
    with pytest.raises(ValueError):
        paging.Budget(max_bytes=100)
    assert paging.rank_window(True, False, 900, 20) == 512 and paging.rank_window(False, False, 40, 20) == 61 and paging.rank_window(True, True, 0, 20) == 8192


def test_every_message_has_its_vector(spark, monkeypatch):
    from weftline.operators import semantic
    from weftline.plans import search

    monkeypatch.setattr(semantic, "CHARS", 500)
    texts = [(1, "Aa aa é界\U0001f600"), (2, "x"), (3, " "), (4, None), (5, ""), (6, "\u3000\xa0"), (7, "\n\n"), (8, "\u200b")] + [(10 + i, "w%d " % i * (i + 1)) for i in range(60)]
    df = spark.createDataFrame(texts, "id bigint, text string").coalesce(1)
    for prefix in ("passage: ", ""):
        want = {i: semantic.query_vector(t, prefix=prefix) for i, t in texts if t and t.strip()}
        dense = {r.id: r.embedding for r in semantic.dense_vectors(df, prefix=prefix).collect()}
        sparse = {i: [0.0] * semantic.DIM for i in want}
        for r in semantic.bigram_buckets(df, prefix=prefix).collect():
            assert sparse[r.id][r.bucket] == 0
            sparse[r.id][r.bucket] = r.weight
        assert set(dense) == set(want)
        for i in want:
            assert max(abs(a - b) for a, b in zip(want[i], sparse[i])) < 1e-12 and max(abs(a - b) for a, b in zip(want[i], dense[i])) < 1e-6
    sf = "/root/testdata/sf0.001"
    n = search.messages(spark, sf).where(F.col("text").rlike(r"\P{IsWhite_Space}")).count()
    assert n == search.message_vectors(spark, sf).count() == search.bigram_messages(spark, sf).select("id").distinct().count()


def test_the_floor_alone_cuts_semantic_floor(spark):
    from weftline.plans import search

    plan = search.semantic_floor(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan
