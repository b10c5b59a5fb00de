import random
from collections import Counter

import pytest

from weftline.llm import pii
from weftline.llm.pii_labels import NEGATIVE, POSITIVE, labelled_table


def test_held_out_accuracy():
    """Trained on three quarters of all sentence patterns and word lists, tested on the fourth, four times: sentences,
    family names, streets, places, hosts and everyday words are new, as are given names but for the tagger's lexicon."""
    ok, true, found = Counter(), Counter(), Counter()
    for fold in range(4):
        tagger = pii.Tagger(*pii.model(part=lambda i: i % 4 != fold))
        rows = labelled_table(12, seed=77, part=lambda i: i % 4 == fold, odd=0.25, free=0)
        for (text, spans), got in zip(rows, tagger.spans([t for t, _ in rows])):
            a, b = {(k, text[x:y]) for x, y, k in spans}, {(k, text[x:y]) for k, x, y in got}
            for c, s in ((ok, a & b), (true, a), (found, b)):
                c.update(k for k, _ in s)
    recall, precision = {k: ok[k] / true[k] for k in pii.KINDS}, {k: ok[k] / found[k] for k in pii.KINDS}
    print({k: (true[k], round(recall[k], 3), round(precision[k], 3)) for k in pii.KINDS})
    for k in pii.KINDS:  # names of persons in sentences never seen are the hardest
        assert recall[k] >= (0.84 if k == "person" else 0.9) and precision[k] >= (0.85 if k == "person" else 0.9), (k, recall, precision)


def test_no_row_is_lifted_from_the_table():
    """No pattern of the labelled table is a sentence of the table the tagger is run on."""
    import os
    import re

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/message_rows.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    bare = lambda s: re.sub(r"\W+", " ", re.sub(r"\{\w+\}|\d+", " ", s)).strip().lower()
    text = bare(" \n ".join(x for x in pq.read_table(path, columns=["msg_content"])["msg_content"].to_pylist() if x))
    long = [p for p in (POSITIVE + "\n" + NEGATIVE).split("\n") if len(bare(p).split()) >= 4 or len(bare(p)) >= 24]
    assert len(long) > 100 and not [p for p in long if bare(p) in text]


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    from weftline.llm.crf import Crf

    crf = Crf(5, ["O", "B-x", "I-x"])
    rng = np.random.default_rng(0)
    crf.w = rng.normal(size=crf.w.shape).astype(np.float32)
    crf.t = np.where(crf.forbid, -1e4, rng.normal(size=crf.t.shape)).astype(np.float32)
    sizes = np.array([1, 4, 5, 3])
    x = rng.integers(0, 5, size=(sizes.sum(), 2))
    got = np.split(crf.viterbi(x, sizes), np.cumsum(sizes)[:-1])
    for xs, y in zip(np.split(x, np.cumsum(sizes)[:-1]), got):
        em = crf.emissions(xs)

        def score(p, em=em):
            return crf.s[p[0]] + sum(em[i, k] for i, k in enumerate(p)) + sum(crf.t[a, b] for a, b in itertools.pairwise(p))

        assert tuple(y) == max(itertools.product(range(3), repeat=len(xs)), key=score)


def test_find_and_redact(spark):
    texts = ["ask Maria Holmquist for access, the mail is maria.h@corp.invalid.", None, "", "  ", "Done, all tests for cold cache pass now.", "请联系王伟，电话13800138000。", "text me (+49 30 23125 705) once, again (+49 30 23125 705)", "line one\nmeet me at 12 Oak Street, Norbeck, OR 97001, I will bring the laptop"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(5, texts[5], "k")], "row_id bigint, msg_content string, pii_kind string")
    got = sorted(map(tuple, pii.find(df).collect()))
    assert got == sorted([
        (0, "person", "Maria Holmquist"), (0, "email", "maria.h@corp.invalid"), (5, "person", "王伟"), (5, "phone", "13800138000"), (5, "person", "王伟"), (5, "phone", "13800138000"), (6, "phone", "+49 30 23125 705"), (7, "address", "12 Oak Street, Norbeck, OR 97001"),
    ])
    red = {r.row_id: r for r in pii.redact(df).collect()}
    assert red[0].redacted == "ask [PERSON] for access, the mail is [EMAIL]." and red[1].redacted is None and red[4].redacted == texts[4] and red[6].n_found == 2


def test_very_long_text():
    r = random.Random(1)
    words = ["queue", "drain", "shard", "the", "a", "12", "of", "and"]
    long = " ".join(r.choice(words) for _ in range(30000)) + " ask Maria Holmquist for access, the mail is maria.h@corp.invalid."
    got = pii.Tagger(*pii.model()).spans([long])[0]
    assert {long[a:b] for _, a, b in got} >= {"maria.h@corp.invalid", "Maria Holmquist"}


def test_nothing_is_cut_inside_a_long_sentence():
    tagger = pii.Tagger(*pii.model())
    for n in range(280, 301):
        text = "界" * n + "请联系王伟，电话13800138000"
        assert {text[a:b] for _, a, b in tagger.spans([text])[0]} == {"王伟", "13800138000"}, n


def test_empty(spark):
    df = spark.createDataFrame([], "row_id bigint, msg_content string")
    assert pii.find(df).count() == 0 and pii.redact(df).count() == 0
