from weftline.llm import mixing
from weftline.operators.ranks import numbered


def docs_of(spark, counts):
    rows, i = [], 0
    for source, (n, words) in counts.items():
        for k in range(n):
            rows.append((i, "word " * (words + k % 5) if k % 50 else None if k % 100 else "", source, 1))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int")


def targets_of(spark):
    return spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 3), ("absent", 0.1, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    docs, targets = docs_of(spark, {"big": (900, 20), "mid": (300, 30), "tiny": (60, 40), "other": (50, 5), None: (10, 5)}), targets_of(spark)
    rep = {r.source: r for r in mixing.shares(docs, targets).collect()}
    assert set(rep) == {"big", "mid", "tiny", "absent"} and rep["absent"].mix_tokens == 0
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)):
        assert abs(rep[s].reached_share - share / 0.9) < 0.01
        assert rep[s].most_copies <= rep[s].max_repeats
    rows = mixing.mix(docs, targets).collect()
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows) == sum(r.mix_docs for r in rep.values())
    per = {}
    for r in rows:
        per[r.doc_id] = per.get(r.doc_id, 0) + 1
    assert max(per.values()) <= 3 and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs, targets).collect()))


def test_a_given_total(spark):
    docs, targets = docs_of(spark, {"big": (900, 20), "mid": (300, 30), "tiny": (60, 40)}), targets_of(spark)
    got = sum(r.mix_tokens for r in mixing.shares(docs, targets, total_tokens=5000).collect())
    assert abs(got - 5000) < 400


def test_numbering_is_dense(spark):
    df = spark.range(1000).selectExpr("id", "cast(if(id % 3 = 0, null, id % 2) as int) AS g", "'x' AS rank2")
    got = {}
    for r in numbered(df, ["g"], "id", salts=7).collect():
        got.setdefault(r.g, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 1000


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(docs, targets_of(spark)).count() == 0
    assert all(r.mix_tokens == 0 for r in mixing.shares(docs, targets_of(spark)).collect())
