import random
from datetime import datetime, timedelta

import numpy as np

from weftline.llm import conversations as cv

SCHEMA = "row_id bigint, session_id string, msg_uuid string, parent_uuid string, msg_role string, sent_at timestamp, msg_content string, turn_no int"
T0 = datetime(2026, 1, 1)


def rows_of(turns, sid="s", start=0):
    """turns: (uuid, parent, role, second, text)"""
    return [(start + i, sid, u, p, r, None if s is None else T0 + timedelta(seconds=s), t, 7) for i, (u, p, r, s, t) in enumerate(turns)]


def kept(spark, rows, **kw):
    out = {}
    for r in cv.conversations(spark.createDataFrame(rows, SCHEMA), **kw).collect():
        out.setdefault(r.session_id, []).append((r.turn_no, r.msg_uuid))
    return {k: [u for _, u in sorted(v)] for k, v in out.items()}


GOOD = [("a", None, "Human", 1, "hi"), ("b", "a", "bot", 2, "yes"), ("c", "b", "user", 30000, "x"), ("d", "c", "USER", 30001, "y"), ("e", "d", "function", 30002, ""), ("f", "e", " Assistant ", 90000, "z")]


def test_kept_and_ordered(spark):
    rows = rows_of(GOOD)
    random.Random(1).shuffle(rows)
    assert kept(spark, rows + rows[:2], honour_sent_at=True) == {"s": list("abcdef")}
    assert kept(spark, rows) == {"s": list("abcdef")}
    assert kept(spark, rows, span_s=1) == {"s": list("abcdef")}


def test_dropped(spark):
    def change(i, **k):
        t = list(GOOD[i])
        for key, v in k.items():
            t[["u", "p", "r", "s", "t"].index(key)] = v
        return [*GOOD[:i], tuple(t), *GOOD[i + 1 :]]

    cases = {
        "unknown role": change(0, r="narrator"), "null role": change(1, r=None), "no time": change(4, s=None), "parent elsewhere": change(2, p="zz"), "blank text": change(1, t=" ​　"), "null text": change(0, t=None),
        "unanswered end": GOOD[:-1], "split users": change(3, r="tool")[:3] + [("d", "c", "tool", 30001, "t"), ("e", "d", "user", 30002, "u"), GOOD[-1]], "no user": [("a", None, "assistant", 1, "hi")], "system only": [("a", None, "system", 1, "hi")],
    }
    rows = [r for k, (sid, turns) in enumerate(cases.items()) for r in rows_of(turns, sid, 100 * k)] + [(9999, None, "q", None, "user", T0, "x", 1), (9998, "n", None, None, "user", T0, "x", 1)]
    assert kept(spark, rows, honour_sent_at=True) == {}


def test_clock_offsets_mend_the_order(spark):
    """The assistant's clock is 100 s slow: every answer seems to come before its question."""
    turns = []
    for k in range(6):
        turns += [(f"u{k}", f"a{k - 1}" if k else None, "user", 50 * k, "q"), (f"a{k}", f"u{k}", "assistant", 50 * k + 5 - 100, "r")]
    rows = rows_of(turns)
    out = cv.clock_offsets(cv.messages(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(out) == 1 and out[0].feasible
    shift = out[0].offsets["assistant"] - out[0].offsets["user"]
    assert 95e6 <= shift <= 140e6
    assert kept(spark, rows) == {"s": [x for k in range(6) for x in (f"u{k}", f"a{k}")]}


def test_unequal_delays_stay_inside_what_the_constraints_allow(spark):
    """The assistant's clock is 5 s slow, it answers after 2 s; users take 15 s at best and 70 s on average."""
    turns, t = [], 0
    for k in range(12):
        turns += [(f"u{k:02}", f"a{k - 1:02}" if k else None, "user", t, "q"), (f"a{k:02}", f"u{k:02}", "assistant", t + 2 - 5, "r")]
        t += 2 + (15 if k % 6 == 0 else 80)
    rows = rows_of(turns)
    got = cv.clock_offsets(cv.messages(spark.createDataFrame(rows, SCHEMA))).collect()[0]
    assert got.feasible and 3e6 < got.offsets["assistant"] - got.offsets["user"] <= 20e6
    assert kept(spark, rows) == {"s": [x for k in range(12) for x in (f"u{k:02}", f"a{k:02}")]}


def test_offsets_meet_the_constraints_or_a_cycle_forbids_it():
    r = np.random.default_rng(6)
    verdicts = {True: 0, False: 0}
    for _ in range(300):
        k = int(r.integers(2, 6))
        least = np.where(r.random((k, k)) < 0.6, r.integers(-40_000_000, 90_000_000, (k, k)), np.nan)
        np.fill_diagonal(least, np.where(r.random(k) < 0.1, -1.0, 5.0))
        d = np.where(np.isnan(least), np.inf, least)
        for m in range(k):
            d = np.minimum(d, d[:, m : m + 1] + d[m : m + 1, :])
        feasible = bool((np.diag(d) >= 0).all())
        verdicts[feasible] += 1
        got = cv.offsets_of(least)
        assert (got is not None) == feasible
        if feasible:
            a, b = np.nonzero(~np.isnan(least))
            assert (least[a, b] + got[a] - got[b] >= 0).all()
    assert min(verdicts.values()) > 30


def test_a_cycle_of_three_senders_is_infeasible(spark):
    turns = [("a", "c2", "user", 1, "q"), ("b", "a", "assistant", 2, "r"), ("c", "b", "tool", 3, "t"), ("c2", "b", "tool", 40, "t"), ("d", "c", "assistant", 50, "r")]
    assert kept(spark, rows_of(turns)) == {}  # user before tool before assistant before user: no clocks mend it
    assert kept(spark, rows_of(turns), honour_sent_at=True) == {"s": ["a", "b", "c", "c2", "d"]}


def test_a_hot_session_and_many_moved_clocks(spark, monkeypatch):
    rows = rows_of([x for k in range(1500) for x in ((f"u{k:04}", None, "user", 40 * k, "q"), (f"a{k:04}", f"u{k:04}", "assistant", 40 * k + 9 - 20, "r"))], "hot")
    for n in range(30):
        rows += rows_of([("p", None, "user", 100, "q"), ("q", "p", "assistant", 95, "r"), ("z", None, "narrator" if n % 3 == 0 else "tool", 96, "")], f"s{n}", 10_000 + 10 * n)
    want = {"hot": [x for k in range(1500) for x in (f"u{k:04}", f"a{k:04}")], **{f"s{n}": ["z", "p", "q"] for n in range(30) if n % 3}}
    assert kept(spark, rows, span_s=600) == want
    monkeypatch.setattr(cv, "MOST_BROADCAST", 3)
    assert kept(spark, rows) == want
    monkeypatch.setattr(cv, "HOT_SPAN", 40)
    assert kept(spark, rows) == want
    monkeypatch.setattr(cv, "MOST_BROADCAST", 10**6)
    assert kept(spark, rows) == want


def test_infeasible_constraints(spark):
    turns = [("a", "b", "user", 1, "q"), ("b", None, "user", 2, "q"), ("c", "a", "assistant", 3, "r")]
    assert kept(spark, rows_of(turns)) == {}
    assert kept(spark, rows_of(turns), honour_sent_at=True) == {"s": ["a", "b", "c"]}


def test_empty(spark):
    assert kept(spark, []) == {}
