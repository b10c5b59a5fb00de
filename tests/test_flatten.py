import json
import random

import pyarrow as pa

from weftline.operators import flatten
from weftline.operators import jsonscan as js


def brute(text):
    try:
        rec = json.loads(text.strip(flatten.MARGIN), parse_constant=lambda x: 1 / 0)
    except Exception:
        return None
    out = []

    def walk(c, path):
        for i, e in enumerate([c] if isinstance(c, (str, dict)) else c if isinstance(c, list) else []):
            if e is not None:
                p = f"{path}.{i}" if path else str(i)
                out.append(p)
                if isinstance(e, dict):
                    walk(e.get("content"), p)

    if isinstance(rec, dict) and isinstance(rec.get("message"), dict):
        walk(rec["message"].get("content"), "")
    return sorted(out)


HAND = [
    '{"message":{"content":"x"}}', '{"message":{"content":""}}', '{"message":{"content":[]}}', '{"message":{"content":null}}', '{"message":{"content":[null,"a",{"content":[{"content":"z"},null]},5,true,[1]]}}',
    '﻿ {"message":{"content":{"type":"text"}}}\r\n', '{"message":{"content":"a"}', '{"message":{"content":"a"}}}', "", " ", "null", "[]", "not json", '{"message":{"\\u0063ontent":"x"}}', '{"message":{"content":"a","content":["b","c"]}}',
    '{"message":"content"}', '{"content":["x"]}', '{"a":tru,"message":{"content":"x"}}', '{"message":{"content":"\\x"}}', '{"message":{"content":["a\\\\","b\\""]}}', '{"message":{"content":[{"input":{"content":["no"]}}]}}', '{"message":{"content":"' + "é界" * 20000 + '"}}',
]


def damaged(seed: int, n: int):
    r = random.Random(seed)
    base = [json.dumps({"type": "user", "message": {"role": "user", "content": [{"type": "text", "text": 'a "q" \\ b'}, None, "s", {"content": [{"content": "t"}]}]}, "n": [1.5e3, -2, False]}), HAND[4], HAND[0]]
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(t))
            c = r.choice('{}[],:"\\ ntf1e0.u\t')
            k = r.random()
            if k < 0.4:
                t[i] = c
            elif k < 0.7:
                t.insert(i, c)
            elif len(t) > 1:
                del t[i]
        yield "".join(t)


def test_scan_agrees_with_a_json_parser():
    texts = [*HAND, *damaged(1, 3000)]
    trimmed = [t.strip(flatten.MARGIN) for t in texts]
    tape = js.scan(pa.array(trimmed, pa.string()))
    for i, t in enumerate(trimmed):
        try:
            json.loads(t, parse_constant=lambda x: 1 / 0)
            ok = True
        except Exception:
            ok = False
        assert tape.valid[i] == ok, t[:200]


def test_blocks_equal_brute_force(spark):
    texts = [*HAND, *damaged(2, 400), None]
    df = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "line_id bigint, raw_json string, block_path string, line_no int")
    got = {}
    for r in flatten.blocks(df).collect():
        got.setdefault(r.line_id, []).append(r.block_path)
        assert r.parent_path == (r.block_path.rpartition(".")[0] or None)
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == (brute(t) or [] if t else []), t


def test_records_and_texts(spark):
    df = spark.createDataFrame([(1, '{"type":"user","uuid":"u","message":{"role":"user","content":["a\\nb",{"type":"text","text":"\\u00e9"}]}}'), (1, '{"message":3}'), (2, "broken{")], "line_id bigint, raw_json string")
    rec = sorted((r.line_id, r.uuid, r.role, r.n_top_blocks) for r in flatten.records(df).collect() if r.uuid)
    assert rec == [(1, "u", "user", 2)]
    assert sorted(r.block_text for r in flatten.blocks(df).collect()) == ["a\nb", "é"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_id bigint, raw_json string")
    assert flatten.blocks(df).count() == 0 and flatten.records(df).count() == 0


KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def brute_members(text):
    """Rows (block_path, member_path, parent_path, name, kind, value), or none of a text that is no whole record."""
    try:
        rec = json.loads(text.strip(flatten.MARGIN), parse_constant=lambda x: 1 / 0, parse_int=Num, parse_float=Num)
    except Exception:
        return []
    out = []

    def show(block, path, up, name, v):
        kind = "number" if isinstance(v, Num) else KINDS[type(v)]
        out.append((block, path, up, name, kind, None if kind in ("object", "array", "null") else v.s if isinstance(v, Num) else v if kind == "string" else str(v).lower()))

    def one(block, path, up, name, v, holds, listed=False):
        """holds: its content is blocks; listed: its elements are blocks."""
        show(block, path, up, name, v)
        below(block, path, v, holds, listed)

    def a_block(path, v):
        if not isinstance(v, dict):
            show(path, "", None, None, v)
        below(path, "", v, isinstance(v, dict), False)

    def below(block, path, v, holds, listed):
        sub = lambda i: str(i) if block is None else f"{block}.{i}"
        if isinstance(v, list):
            for i, x in enumerate(v):
                if listed and x is not None:
                    a_block(sub(i), x)
                else:
                    one(block, f"{path}/{i}", path, str(i), x, False)
        elif isinstance(v, dict):
            for k, x in v.items():
                p = f"{path}/{k.replace('~', '~0').replace('/', '~1')}"
                if holds and k == "content" and isinstance(x, (str, dict)):
                    a_block(sub(0), x)
                else:
                    top = block is None and path == "" and k == "message" and isinstance(x, dict)
                    one(block, p, path, k, x, top, holds and k == "content" and isinstance(x, list))

    if isinstance(rec, dict):
        below(None, "", rec, False, False)
    return out


class Num:
    def __init__(self, s):
        self.s = s


MEMBERS = [
    '{"type":"assistant","isSidechain":true,"toolUseResult":{"stdout":"x","files":[{"p":"a/b~c","n":1.50}],"e":{},"l":[]},"message":{"role":"r","usage":{"in":12,"cache":{"a/b":null}},"content":[{"type":"tool_use","input":{"content":["no"],"edits":[{"old":"a"}]},"citations":[{"u":[1,[2,{"k":false}]]}],"is_error":false},null,[1,{"content":"not a block"}],7]}}',
    '{"summary":"s","summary":"last","message":{"content":{"source":{"data":"\\u00e9"},"content":{"content":["z",null,{"a":{"b":1},"a":{"c":2}}]}}}}',
    '{"a":{"message":{"content":["no"]}},"message":{"content":5,"x":{"content":["no"]}}}', '{"":{"":[]},"message":[{"content":"no"}]}', "{}",
]


def test_members_hold_everything(spark):
    texts = [*MEMBERS, *HAND, *damaged(3, 400), None]
    got = {}
    for r in flatten.members(spark.createDataFrame(list(enumerate(texts)), "line_id bigint, raw_json string")).collect():
        got.setdefault(r[0], []).append(tuple(r)[1:])
    key = lambda t: tuple((x is not None, x or "") for x in t)
    for i, t in enumerate(texts):
        assert sorted(got.get(i, []), key=key) == sorted(brute_members(t) if t else [], key=key), t


def test_scalars_of_any_kind_are_columns(spark):
    df = spark.createDataFrame([(1, '{"type":"user","isSidechain":true,"summary":"s","leafUuid":"l","message":{"content":[{"is_error":false,"signature":"g","title":"t","id":5,"name":{"x":1}}]}}')], "line_id bigint, raw_json string")
    r, b = flatten.records(df).first(), flatten.blocks(df).first()
    assert (r.isSidechain, r.summary, r.leafUuid) == ("true", "s", "l")
    assert (b.block_is_error, b.block_signature, b.block_title, b.block_id, b.block_name) == ("false", "g", "t", "5", None)
