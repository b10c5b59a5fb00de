from datetime import datetime

from weftline.operators import drift

SCHEMA = "line_id bigint, stream_id string, file_no int, line_no int, exported_at timestamp, raw_json string, path string"


def frame(spark, files, stream="s"):
    rows = []
    for no, texts in files.items():
        for k, t in enumerate(texts):
            rows.append((len(rows), stream, no, k, datetime(2026, 1, 1), t, "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def test_changes(spark):
    files = {
        3: ['{"type":"u","slug":"a","message":{"content":"x"},"cost":1}', '{"type":"u","slug":"a","mess'],
        5: ['{"type":"u","title_slug":"b","message":{"content":["x"]},"cost":null}', "", "null", "[1]"],
        6: ['{"type":"u","title_slug":"b","message":{"content":"x"},"extra":{"deep":{"n":1},"l":[{"q":1}]}}', '{"type":1}'],
        9: ["cut off {", None],
    }
    got = {tuple(r)[1:] for r in drift.changes(frame(spark, files)).collect()}
    assert got == {
        (5, "slug", "title_slug"), (5, "message.content", "message.content"), (5, "cost", ""), (6, "message.content", "message.content"), (6, "type", "type"), (6, "", "extra.deep.n"), (6, "", "extra.l"),
        (9, "type", ""), (9, "title_slug", ""), (9, "message.content", ""), (9, "extra.deep.n", ""), (9, "extra.l", ""),
    }


def test_moved_into_an_object_and_unknown_names(spark):
    files = {1: ['{"message":{"content":"x"},"retryCount":1}'], 2: ['{"message":{"content":{"text":"x"}},"retry_count":1}']}
    assert {tuple(r)[2:] for r in drift.changes(frame(spark, files)).collect()} == {("message.content", "message.content.text"), ("retryCount", "retry_count")}


def test_lifespans_are_islands(spark):
    files = {1: ['{"a":1}'], 2: ['{"a":1}'], 4: ['{"b":1}'], 7: ['{"a":1}']}
    spans = {(r.path, r.first_file, r.last_file, r.n_files, r.opens, r.closes) for r in drift.lifespans(drift.footers(frame(spark, files))).collect()}
    assert spans == {("a", 1, 2, 2, False, True), ("b", 4, 4, 1, True, True), ("a", 7, 7, 1, True, False)}


def test_unified(spark):
    files = {1: ['{"type":"u","ts":1700000000,"sidechain":"true","uuid":"x"}'], 2: ['{"kind":"v","timestamp":"2026-01-01T00:00:00Z","isSidechain":0,"usage":{"input_tokens":"7"}}', "broken"]}
    got = {r.type: (str(r.timestamp), r.isSidechain, r.message_usage_input_tokens) for r in drift.unified(frame(spark, files)).collect()}
    assert got == {"u": ("2023-11-14 22:13:20", True, None), "v": ("2026-01-01 00:00:00", False, 7)}


def test_unified_keeps_what_no_column_holds(spark):
    import json

    texts = ['{"type":"u","kind":"v","isSidechain":"maybe","costUsd":1.5,"new":{"deep":1.50,"a.b":"q","n":null},"message":{"content":{"lang":"en","text":"x"}},"list":[1.0,{"k":false}]}', '{"type":"u"}']
    got = {r.line_id: r for r in drift.unified(frame(spark, {1: texts})).collect()}
    assert (got[0].type, got[0].message_content, got[0].isSidechain) == ("v", "x", None)
    assert json.loads(got[0].rest) == {"type": "u", "isSidechain": "maybe", "new.deep": "1.50", r"new.a\.b": "q", "message.content.lang": "en", "list": '[1.0,{"k":false}]'}
    assert got[1].rest is None


def test_empty(spark):
    assert drift.changes(spark.createDataFrame([], SCHEMA)).count() == 0
