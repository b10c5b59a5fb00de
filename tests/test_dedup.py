import random
import re
import uuid
from datetime import datetime, timedelta

import numpy as np

from weftline.operators import dedup

SCHEMA = "row_id bigint, msg_uuid string, session_id string, received_at timestamp, hi string, shard int"


def spell(u, r):
    return r.choice([u, u.upper(), "{" + u + "}", "urn:uuid:" + u, u.replace("-", ""), f" {u} "])


def test_one_row_of_each_message(spark):
    r = random.Random(5)
    pool = [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(120)] + ["not-a-uuid", "Other id"]
    t0 = datetime(2026, 1, 1)
    rows = [(i, spell(r.choice(pool), r) if r.random() < 0.95 else r.choice([None, "", "  "]), r.choice(["s1", "s1", "s2", None, ""]), r.choice([None, t0 + timedelta(seconds=r.randrange(5))]), "clash", 1) for i in range(1500)]
    best, lost = {}, set()
    for row in sorted(rows, key=lambda x: (x[3] is None, x[3] or t0, x[0])):
        u = (row[1] or "").strip().lower()
        if not u or not (row[2] or "").strip():
            continue
        h = re.sub("[^0-9a-f]", "", re.sub("^urn:uuid:", "", u))
        k = (row[2], h if len(h) == 32 else u)
        if k in best:
            lost.add(row[0])
        best.setdefault(k, row[0])
    rows.append((None, "not-a-uuid", "s2", None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    lost.add(None)
    assert {x.row_id for x in dedup.repeated(df).collect()} == lost
    assert dedup.unique(df).count() == len(rows) - len(lost - {None})  # rows without a number cannot be told apart and stay


def test_permutation_loses_nothing(spark):
    from pyspark.sql import functions as F

    ids = [f"{i:032x}" for i in range(500)] + [f"{i << 100:032x}" for i in range(1, 500)]
    hi, lo = dedup.permuted(F.col("u"))
    out = spark.createDataFrame([(x,) for x in ids], "u string").select(hi.alias("a"), lo.alias("b")).distinct()
    assert out.count() == len(ids)


def test_table_takes_each_identifier_once():
    r = np.random.default_rng(4)
    for n, pool in ((1, 1), (300, 40), (5000, 5000), (4000, 3)):
        ids = r.integers(0, 2**63, size=(pool, 2), dtype=np.uint64)
        ids[: pool // 2, 0] = ids[0, 0]  # equal quotients: long chains of probes
        pick, code = r.integers(0, pool, n), r.integers(0, 2, n)
        table, seen, want, got = dedup.QuotientTable(n), set(), [], []
        for k, c in zip(pick, code):
            want.append((k, c) not in seen)
            seen.add((k, c))
        for half in (slice(0, n // 2), slice(n // 2, n)):
            got += table.insert(ids[pick[half], 0], ids[pick[half], 1], code[half]).tolist()
        assert got == want


def test_runs_shorter_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(dedup, "RUN", 10)
    t0 = datetime(2026, 1, 1)
    r = random.Random(8)
    rows = [(i, str(uuid.UUID(int=r.choice([1, 1, 1, 2, 3, r.getrandbits(128)]))), "s", t0 + timedelta(seconds=r.randrange(50)), "", 0) for i in range(3000)]
    keep = {}
    for row in rows:
        keep[row[1]] = min(keep.get(row[1], (t0 + timedelta(days=1), 0)), (row[3], row[0]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [x.row_id for x in dedup.repeated(spark.createDataFrame(rows, SCHEMA)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == {x[0] for x in rows} - {k[1] for k in keep.values()}


def test_empty(spark):
    assert dedup.repeated(spark.createDataFrame([], SCHEMA)).count() == 0
