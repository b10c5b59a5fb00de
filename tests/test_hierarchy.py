import random
from datetime import datetime, timedelta

import pytest

from weftline.operators import hierarchy

SCHEMA = "link_id bigint, msg_uuid string, parent_uuid string, session_id string, is_sidechain boolean, seen_at timestamp, path string"


def brute(rows):
    held = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[5] is not None, r[5] or datetime.min, r[0])):
        held[r[1].lower()] = (r[2] or "").lower()
    out = {}
    for x in held:
        seen, at, d = set(), x, 0
        while True:
            if at in seen:
                out[x] = ("", -1)
                break
            seen.add(at)
            up = held[at]
            if not up.strip() or up not in held:
                out[x] = (at, d)
                break
            at, d = up, d + 1
    return out


def random_links(seed, n=300):
    r = random.Random(seed)
    t0 = datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        up = r.choice([None, "", " ", "gone", f"ID{r.randrange(n)}", *[f"id{max(0, i - r.randint(1, 4))}"] * 9])
        rows.append((i, r.choice([f"id{i}", f"ID{i}"]), up, r.choice(["s1", "s1", "s2", None]), None, t0 + timedelta(hours=i), "clash"))
    rows += [(n + k, f"id{r.randrange(n)}", f"id{r.randrange(n)}", "s1", True, t0 + timedelta(hours=r.randrange(2 * n)), "clash") for k in range(20)]
    rows += [(n + 50, None, "id1", "s1", False, t0, "x"), (n + 51, "self", "self", None, None, None, None), rows[3], rows[3]]
    return rows


def shape(rows):
    """Depths, roots, sizes, heights and descendants by walking up."""
    held = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[5] is not None, r[5] or datetime.min, r[0])):
        held[r[1].lower()] = (r[2] or "").lower()
    under, height = {}, {}
    for x, (_, depth) in brute(rows).items():
        at = x
        for k in range(depth + 1):
            under.setdefault(at, set()).add(x)
            height[at] = max(height.get(at, 0), k)
            at = held[at]
    return under, height


@pytest.mark.parametrize(("seed", "n", "rows_per_task"), [(1, 300, 10**6), (2, 120, 12), (4, 500, 90), (5, 5, 2)])
def test_against_brute_force(spark, seed, n, rows_per_task):
    rows = random_links(seed, n)
    want, (under, height) = brute(rows), shape(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    tree = hierarchy.hierarchy(df, with_path=True, with_sizes=True, rows_per_task=rows_per_task).collect()
    assert {r.msg_uuid: (r.root_uuid, r.node_depth) for r in tree} == want and len(tree) == len(want)
    for r in tree:
        if r.node_depth < 0:
            assert r.path is None and r.n_descendants is None and r.height is None
        else:
            p = r.path.split("/")
            assert len(p) == r.node_depth + 1 and p[0] == r.root_uuid and p[-1] == r.msg_uuid
            assert (r.n_descendants, r.height) == (len(under[r.msg_uuid]) - 1, height[r.msg_uuid])
    narrow = hierarchy.hierarchy(df, rows_per_task=rows_per_task).collect()
    assert {r.msg_uuid: (r.root_uuid, r.node_depth) for r in narrow} == want and len(narrow) == len(want)
    walk = {r.msg_uuid: r for r in hierarchy.intervals(df, rows_per_task=rows_per_task).collect()}
    assert set(walk) == set(want)
    for r in walk.values():
        inside = {y.msg_uuid for y in walk.values() if r.first is not None and y.root_uuid == r.root_uuid and y.first is not None and r.first <= y.first <= r.last}
        assert inside == under.get(r.msg_uuid, set())


def test_many_loops_in_small_fragments(spark):
    """Loops of 2 to 60 messages, each with a tail, cut into fragments of a few rows: no path grows and rounds end."""
    t0, rows = datetime(2026, 1, 1), []
    for k, size in enumerate([2, 3, 5, 8, 13, 21, 34, 60]):
        rows += [(len(rows) + i, f"{k}x{i}", f"{k}x{(i + 1) % size}", "s", False, t0 + timedelta(days=i), "") for i in range(size)]
        rows += [(len(rows) + i, f"{k}t{i}", f"{k}t{i - 1}" if i else f"{k}x0", "s", False, t0 + timedelta(days=i), "") for i in range(9)]
    rows += [(5000 + i, f"flat{i}", "hub" if i else None, "s", False, t0 + timedelta(days=i), "") for i in range(200)] + [(6000, "hub", None, "s", False, t0, "")]
    got = hierarchy.hierarchy(spark.createDataFrame(rows, SCHEMA), with_path=True, with_sizes=True, rows_per_task=40).collect()
    assert {r.msg_uuid: (r.root_uuid, r.node_depth) for r in got} == brute(rows)
    assert {r.n_descendants for r in got if r.msg_uuid == "hub"} == {199} and all(len(r.path or "") < 12 for r in got)


def test_long_chain_and_loops_across_days(spark):
    t0 = datetime(2026, 1, 1)
    chain = [(i, f"c{i}", f"c{i - 1}" if i else None, "s", False, t0 + timedelta(hours=5 * i), "") for i in range(400)]
    loop = [(1000 + i, f"l{i}", f"l{(i + 1) % 30}", "s", False, t0 + timedelta(days=i), "") for i in range(30)]
    under = [(2000, "u", "l3", "t", False, t0, "")]
    got = {r.msg_uuid: (r.root_uuid, r.node_depth) for r in hierarchy.hierarchy(spark.createDataFrame(chain + loop + under, SCHEMA)).collect()}
    assert got == brute(chain + loop + under)
    assert got["c399"] == ("c0", 399) and got["u"] == ("", -1)


def test_descendants_and_sizes(spark):
    rows = [(1, "a", None, "s", False, datetime(2026, 1, 1), ""), (2, "b", "a", "s", False, datetime(2026, 1, 2), ""), (3, "c", "b", "s", False, datetime(2026, 1, 3), "")]
    tree = hierarchy.hierarchy(spark.createDataFrame(rows, SCHEMA), with_path=True, with_sizes=True)
    assert {(r.msg_uuid, r.n_descendants, r.height) for r in tree.collect()} == {("a", 2, 2), ("b", 1, 1), ("c", 0, 0)}
    assert {tuple(r) for r in hierarchy.descendants(tree).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_descendants_of_the_query_against_brute_force(spark, tmp_path):
    from weftline.plans import problems

    t0 = datetime(2026, 1, 1)
    chain = [(9000 + i, f"c{i}", f"C{i - 1}" if i else None, "s", False, t0 + timedelta(hours=5 * i), "") for i in range(300)]
    rows = [r for r in random_links(4) if r[1]] + chain
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/message_links.parquet")
    up = {}
    for r in sorted(rows, key=lambda r: (r[5] is not None, r[5] or datetime.min, r[0])):
        up[r[1].lower()] = (r[2] or "").lower()
    want = []
    for x, (_, depth) in brute(rows).items():
        at = x
        for k in range(1, depth + 1):
            at = up[at]
            want.append((at, x, k))
    got = [tuple(r) for r in problems.p4_descendants(spark, str(tmp_path)).select("ancestor_uuid", "descendant_uuid", "distance").collect()]
    assert sorted(got) == sorted(want) and ("c0", "c299", 299) in want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hierarchy.hierarchy(none).count() == 0 and hierarchy.hierarchy(none, with_path=True, with_sizes=True).count() == 0 and hierarchy.intervals(none).count() == 0


@pytest.mark.parametrize("most", [10**6, 1])
def test_hot_sessions_are_dealt_out(spark, monkeypatch, most):
    monkeypatch.setattr(hierarchy, "HOT_ROWS", 7)
    monkeypatch.setattr(hierarchy, "MOST_EXITS", most)
    monkeypatch.setattr(hierarchy, "MOST_HOT", most)
    t0 = datetime(2026, 1, 1)
    rows = [(i, f"c{i}", f"c{i - 1}" if i else None, "s" if i % 3 else None, False, t0 + timedelta(days=i // 9) if i % 5 else None, "") for i in range(120)]
    got = {r.msg_uuid: (r.root_uuid, r.node_depth) for r in hierarchy.hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
