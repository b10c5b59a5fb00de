import random

from weftline.operators import graph, ranking, ranks


def links(spark, n=160, seed=3):
    r = random.Random(seed)
    rows, edges = [], []
    for i in range(n):
        s = f"s{i % 3}"
        rows.append((s, f"p{i}", f"m{i}", "d", i, i % 11 == 10, f"2026-01-{1 + i // 20:02d}T00:{i % 60:02d}:00Z"))
        if i >= 3:
            edges.append((f"p{i}", f"m{i - 3 * r.randint(1, min(3, i // 3))}"))
    edges.append(("p0", f"m{(n - 1) // 3 * 3}"))  # a loop through the first of a session
    return spark.createDataFrame(rows, "session_id string, placement_id string, message_id string, document_id string, ordinal int, is_sidechain boolean, ts_raw string"), spark.createDataFrame(edges, "child_placement_id string, parent_message_id string")


def test_mainline_is_the_same_however_sessions_are_cut(spark, monkeypatch):
    p, e = links(spark)
    whole = sorted(map(tuple, graph.mainline(p, e).collect()))
    monkeypatch.setattr(graph, "HOT_ROWS", 5)
    assert sorted(map(tuple, graph.mainline(p, e).collect())) == whole and len(whole) > 30
    monkeypatch.setattr(graph, "MOST_HOT", 0)
    assert sorted(map(tuple, graph.mainline(p, e).collect())) == whole


def test_running_sums_by_slices(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), i, r.choice([1, 2, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    want, sums = {}, {}
    for g, i, v in rows:
        sums[g] = sums.get(g, 0) + (v or 0)
        want[i] = sums[g]
    for width in (1, 7, 1000):
        got = {x.i: x.running for x in ranks.running_sum(df, ["g"], ["i"], df["v"], (df["i"] / width).cast("int")).collect()}
        assert got == want
    fit = {x.i for x in ranking.within_budget(df, df["v"] * 1, 40, ["i"], 30, ["g"], (df["i"] / 9).cast("int")).collect()}
    seen = {}
    for g, i, _ in rows:
        seen[g] = seen.get(g, 0) + 1
        assert (i in fit) == (want[i] <= 40 and seen[g] <= 30)


def test_string_ids_keep_the_total_order(spark):
    df = spark.createDataFrame([(f"{c}{k}", f"s{k}", 1.0) for k in range(6) for c in "dbeac"], "id string, session_id string, score double")
    assert sorted(r.id for r in ranking.best_of_session(df).collect()) == [f"a{k}" for k in range(6)]
