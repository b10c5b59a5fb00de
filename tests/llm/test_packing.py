import random

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import packing, tokens


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_patterns_hold_every_size_once(hist):
    got = {}
    for n, held, tier in packing.plan_patterns(hist, 64, (8, 32)):
        assert sum(s * m for s, m in held) <= 64 and n > 0
        assert tier >= max(s for s, _ in held)
        for s, m in held:
            got[s] = got.get(s, 0) + n * m
    assert got == hist


def test_close_to_the_least_number_of_containers():
    r = random.Random(3)
    hist = {}
    for _ in range(5000):
        s = min(1024, int(r.lognormvariate(5, 0.9)) + 1)
        hist[s] = hist.get(s, 0) + 1
    n = sum(c for c, _, _ in packing.plan_patterns(hist, 1024))
    least = -(-sum(s * c for s, c in hist.items()) // 1024)
    assert n <= least * 1.02 + 1


def test_pack(spark):
    texts = ["word " * n for n in (3, 30, 300, 7, 7, 7, 100, 250)] + ["", None, "a", "a"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "lost id", 1)], "doc_id bigint, text string, plan_id int")
    plans = spark.createDataFrame([(1, "small", 64), (2, "large", 256), (3, "none", None)], "plan_id bigint, plan_label string, capacity_tokens bigint")
    size = {r.doc_id: r.n_tokens for r in tokens.sized(docs).collect()}
    rows = packing.pack(docs, plans).collect()
    for plan, cap in ((1, 64), (2, 256)):
        mine = [r for r in rows if r.plan_id == plan]
        for i, t in enumerate(texts):
            pieces = sorted((r.piece_no, r.start_token, r.n_tokens) for r in mine if r.doc_id == i)
            if t is None:
                assert not pieces
                continue
            assert sum(p[2] for p in pieces) == max(size[i], 1) and (len(pieces) == 1 or size[i] > cap)
            assert [p[1] for p in pieces] == [k * cap for k in range(len(pieces))]
        boxes = {}
        for r in mine:
            boxes.setdefault(r.container_id, []).append((r.container_offset, r.n_tokens))
        for held in boxes.values():
            at = 0
            for off, n in sorted(held):
                assert off >= at
                at = off + n
            assert at <= cap
    rep = {r.plan_id: r for r in packing.report(packing.pack(docs, plans), plans).collect()}
    assert rep[2].n_containers >= rep[2].least_containers and rep[2].fullest <= 256


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    plans = spark.createDataFrame([(1, "x", 64)], "plan_id bigint, plan_label string, capacity_tokens bigint")
    assert packing.pack(docs, plans).count() == 0 and packing.pack(docs, plans.where("false")).count() == 0


def test_tiers_are_labels_of_best_fit_decreasing():
    for seed in range(50):
        r = random.Random(seed)
        hist = {s: r.randint(1, 9) for s in r.sample(range(1, 65), 20)}
        with_tiers, without = ([(n, held) for n, held, _ in packing.plan_patterns(hist, 64, t)] for t in ((8, 32), ()))
        assert with_tiers == without
