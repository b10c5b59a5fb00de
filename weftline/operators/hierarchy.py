"""Problem 4: parent-child links of unknown depth to rooted hierarchies.

1. Current row of each message: the link with the latest ``seen_at`` (ties: largest ``link_id``), ids in lower case.
2. Partition-local contraction: rows are placed by session, so a chain mostly lies in one partition; a session too large
   for one task is dealt out by its days. Each partition follows its own parent
   chains by pointer doubling to the node where they leave it (the fragment exit), end at a root, or close a loop.
3. Quotient forest: one node per fragment that leaves its partition or is entered from another, pointing to the fragment
   its exit lies in. It is solved by the same function, recursively, until nothing leaves a partition any more. A quotient
   of up to ``rows_per_task`` nodes is one partition. A larger one is dealt out by coin: a node lies by its own id
   or by its parent's, so that on average a quarter or more of the links contract in each round whatever the shape.
   Loops shrink in the same way until they lie in one partition and are seen there.
4. Expansion: roots, depths and, where asked for, paths, sizes and heights of fragments go back to the partitions they
   came from; there every node gets its own. Sizes go up and paths go down the same fragments: no path is
   exploded, and a looping row never has a path.

Nothing is gathered on the driver but counts, and no task holds more than about ``rows_per_task`` nodes. Defined results:
rows with a null msg_uuid are no messages; a null, blank or unknown parent makes a root; a message on a loop or under
one has root '' and depth -1 (path, size and height null); of equal rows one counts; session and sidechain bound
nothing; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import cut, parts

ROOT, EXIT, LOOP = 0, 1, 2
SEP = "/"
#: Nodes that a task of the contraction takes.
ROWS_PER_TASK = 200_000
#: Rows of one session that are kept together.
HOT_ROWS = 100_000
#: Most hot sessions whose list is broadcast, and most exits (some twenty MB).
MOST_HOT = 100_000
MOST_EXITS = 200_000


def current_links(links: DataFrame) -> DataFrame:
    """(id, parent, session_id, day) with one row for each message; aggregated before the shuffle."""
    best = F.max_by(F.struct("parent_uuid", "session_id", "seen_at", "is_sidechain"), F.struct(F.col("seen_at"), F.col("link_id")))
    one = links.where(F.col("msg_uuid").isNotNull()).groupBy(F.lower("msg_uuid").alias("id")).agg(best.alias("b"))
    parent = F.lower(F.col("b.parent_uuid"))
    return one.select("id", F.when(F.trim(parent) != "", parent).alias("parent"), F.col("b.session_id").alias("session_id"), F.to_date("b.seen_at").alias("day"), F.col("b.is_sidechain").alias("is_sidechain"))


class _Chains:
    """Parent chains within one partition: columns id, parent (null: root) and w (weight of the step up)."""

    def __init__(self, t: pa.Table):
        n = t.num_rows
        self.ids, self.parent = t["id"].combine_chunks(), t["parent"].combine_chunks()
        up = pc.if_else(pc.is_null(self.parent), pa.scalar(None, pa.int32()), pc.index_in(self.parent, value_set=self.ids))
        self.p = p = pc.fill_null(up, -1).to_numpy().astype(np.int64)
        self.w = t["w"].to_numpy().astype(np.int64)
        anc = np.where(p >= 0, p, np.arange(n))
        dist, hops = np.where(p >= 0, self.w, 0), (p >= 0).astype(np.int64)
        for _ in range(max(1, math.ceil(math.log2(n + 1))) + 1):
            if (anc[anc] == anc).all():
                break
            dist, hops, anc = dist + dist[anc], hops + hops[anc], anc[anc]
        self.ended = p[anc] < 0
        self.top, self.dist = np.where(self.ended, anc, np.arange(n)), dist
        order = np.argsort(np.where(self.ended, hops, -1), kind="stable")
        edges = np.searchsorted(np.where(self.ended, hops, -1)[order], np.arange(hops[self.ended].max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(edges, edges[1:])]
        lost, outside = t["lost"].to_numpy(zero_copy_only=False)[anc], pc.is_valid(self.parent).to_numpy(zero_copy_only=False)[anc]
        self.kind = np.where(~self.ended | lost, LOOP, np.where(outside, EXIT, ROOT))

    def paths(self, seg: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Steps from the top down, after what ``prefix`` gives for the top; null on loops."""
        out = np.full(len(seg), None, dtype=object)
        for k, at in enumerate(self.levels):
            before, here = prefix[at] if k == 0 else out[self.p[at]], seg[at]
            out[at] = [b + SEP + x if b and x else b or x for b, x in zip(before, here)]
        return out

    def up(self, size: np.ndarray, height: np.ndarray) -> None:
        """Add to every node what hangs under it, deepest first."""
        for at in self.levels[:0:-1]:
            np.add.at(size, self.p[at], size[at])
            np.maximum.at(height, self.p[at], height[at] + self.w[at])


def _contracted(rows: DataFrame, with_path: bool, with_sizes: bool) -> DataFrame:
    """One row a node: id, parent, w, lost, top, exit, dist, exit_w, kind, part[, seg, path][, own, tall, top_own, top_tall]."""
    schema = "id string, parent string, w bigint, lost boolean, top string, exit string, dist bigint, exit_w bigint, kind int, part int"
    schema += ", seg string, path string" * with_path + ", own bigint, tall bigint, top_own bigint, top_tall bigint" * with_sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        c = _Chains(t)
        out = {"id": c.ids, "parent": c.parent, "w": pa.array(c.w), "lost": t["lost"].combine_chunks(), "top": c.ids.take(pa.array(c.top))}
        out["exit"] = pc.if_else(pa.array(c.kind == EXIT), c.parent.take(pa.array(c.top)), pa.scalar(None, pa.string()))
        out |= {"dist": pa.array(c.dist), "exit_w": pa.array(np.where(c.kind == EXIT, c.w[c.top], 0)), "kind": pa.array(c.kind.astype(np.int32))}
        out["part"] = pa.array(np.full(t.num_rows, TaskContext.get().partitionId(), np.int32))
        if with_path:
            seg = np.array(t["seg"].to_pylist(), dtype=object)
            out |= {"seg": t["seg"].combine_chunks(), "path": pa.array(c.paths(seg, np.full(len(seg), "", dtype=object)), pa.string())}
        if with_sizes:
            own, tall = (t[x].to_numpy().astype(np.int64) for x in ("own", "tall"))
            total, most = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64)
            np.add.at(total, c.top, own)
            np.maximum.at(most, c.top[c.ended], (c.dist + tall)[c.ended])
            out |= {"own": pa.array(own), "tall": pa.array(tall), "top_own": pa.array(total), "top_tall": pa.array(most)}
        yield from pa.table(out).to_batches(max_chunksize=20000)

    return rows.mapInArrow(run, schema)


def _expanded(rows: DataFrame, with_path: bool, with_sizes: bool) -> DataFrame:
    """Nodes (tag 0), solutions of fragments (tag 1: id, root, depth, lost, path) and what hangs on a node from other
    partitions (tag 2: id, size, height), each in the partition of its node, to (id, parent, part, root, depth, lost[, path][, size, height])."""
    schema = "id string, parent string, part int, root string, depth bigint, lost boolean" + ", path string" * with_path + ", size bigint, height bigint" * with_sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        nodes, solved, hung = (t.filter(pc.equal(t["tag"], k)) for k in (0, 1, 2))
        c = _Chains(nodes)
        # fragments that leave the partition take root, depth and path from their solution
        at = pc.fill_null(pc.index_in(c.ids, value_set=solved["id"].combine_chunks()), -1).to_numpy().astype(np.int64)[c.top]
        from_sol = (c.kind == EXIT) & (at >= 0)
        pick = pa.array(np.where(from_sol, at, 0), mask=~from_sol)
        lost = (c.kind == LOOP) | pc.fill_null(solved["lost"].combine_chunks().take(pick), False).to_numpy(zero_copy_only=False)
        root = pc.coalesce(solved["root"].combine_chunks().take(pick), c.ids.take(pa.array(c.top)))
        depth = c.dist + pc.fill_null(solved["depth"].combine_chunks().take(pick), 0).to_numpy()
        out = {"id": c.ids, "parent": c.parent, "part": nodes["part"].combine_chunks(), "root": root, "depth": pa.array(depth), "lost": pa.array(lost)}
        if with_path:
            prefix = np.array(pc.fill_null(solved["path"].combine_chunks().take(pick), "").to_pylist(), dtype=object)
            path = c.paths(np.array(nodes["seg"].to_pylist(), dtype=object), prefix)
            path[lost] = None
            out["path"] = pa.array(path, pa.string())
        if with_sizes:
            size, height = (nodes[x].to_numpy().astype(np.int64) for x in ("own", "tall"))
            on = pc.index_in(hung["id"].combine_chunks(), value_set=c.ids).to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(size, on, hung["own"].to_numpy())
            np.maximum.at(height, on, hung["tall"].to_numpy())
            c.up(size, height)
            out |= {"size": pa.array(size, mask=lost), "height": pa.array(height, mask=lost)}
        yield from pa.table(out).to_batches(max_chunksize=20000)

    return rows.mapInArrow(run, schema)


def _solve(nodes: DataFrame, n_parts: int, with_path: bool, with_sizes: bool, rows_per_task: int, level: int = 0) -> DataFrame:
    """Solve the forest of ``nodes`` (id, parent, w, lost[, seg][, own, tall]), which lie in ``n_parts`` partitions:
    (id, root, depth, lost[, parent, part][, path][, size, height])."""
    wide = with_path or with_sizes
    frag = cut(_contracted(nodes, with_path, with_sizes))
    leaves = frag.where(F.col("kind") == EXIT)
    base = frag.select("id", "parent", "part", "w", "lost", *(["seg"] if with_path else []), *(["own", "tall"] if with_sizes else []), F.lit(0).alias("tag"))
    if leaves.isEmpty():
        done = frag.select("id", F.col("top").alias("root"), F.col("dist").alias("depth"), (F.col("kind") == LOOP).alias("lost"))
        return _expanded(_united(base, None, None, with_path, with_sizes), with_path, with_sizes) if wide else done
    # where do the exits lead?
    tops = leaves.where(F.col("id") == F.col("top")).select("top", "exit", "exit_w", "part", *(["top_own", "top_tall"] if with_sizes else []))
    landing = frag.select(F.col("id").alias("exit"), F.col("top").alias("x_top"), F.col("dist").alias("x_dist"), F.col("kind").alias("x_kind"), F.col("part").alias("x_part"))
    # the list of exits is as long as the quotient: up to a checked size it goes to the nodes, beyond it they meet by id
    exits = tops.select("exit").distinct()
    few = tops.count() <= MOST_EXITS
    if few:
        landing = landing.join(F.broadcast(exits), "exit", "left_semi")
    landed = cut(tops.join(landing, "exit", "left"))
    # an exit to an id that is no message makes its top a root
    far = landed.select(F.col("top").alias("id"), F.col("x_top").alias("parent"), F.coalesce(F.col("exit_w") + F.col("x_dist"), F.lit(0).cast("bigint")).alias("w"), F.lit(False).alias("lost"), F.col("exit"), *([F.col("top_own").alias("own"), F.col("top_tall").alias("tall")] if with_sizes else []))
    entered = landed.where(F.col("x_kind") != EXIT).select(F.col("x_top").alias("id")).distinct()
    ends = frag.where((F.col("id") == F.col("top")) & (F.col("kind") != EXIT)).join(entered, "id", "left_semi")
    ends = ends.select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("w"), (F.col("kind") == LOOP).alias("lost"), *([F.col("top_own").alias("own"), F.col("top_tall").alias("tall")] if with_sizes else []))
    if with_path:
        steps = frag.select(F.col("id").alias("exit"), F.col("path").alias("seg"))  # from the top down to the exit
        far = far.join(steps.join(F.broadcast(exits) if few else exits, "exit", "left_semi"), "exit", "left").withColumn("seg", F.coalesce("seg", F.lit("")))
        ends = ends.withColumn("seg", F.lit(""))
    quotient = cut(far.drop("exit").unionByName(ends))
    n = quotient.count()
    deals = max(1, -(-n // rows_per_task))
    mate = F.xxhash64("id", F.lit(level)).bitwiseAND(1) == 0
    own_place, its_place = (F.pmod(F.xxhash64(x, F.lit(level + 1000)), F.lit(deals)).cast("int") for x in ("id", "parent"))
    placed = quotient.repartitionById(deals, F.when(mate | F.col("parent").isNull(), own_place).otherwise(its_place))
    solved = _solve(placed, deals, with_path, with_sizes, rows_per_task, level + 1)
    if not wide:
        done = frag.where(F.col("kind") != EXIT).select("id", F.col("top").alias("root"), F.col("dist").alias("depth"), (F.col("kind") == LOOP).alias("lost"))
        rest = leaves.select("id", "top", "dist").join(solved.select(F.col("id").alias("top"), "root", "depth", "lost"), "top")
        return done.unionByName(rest.select("id", "root", (F.col("dist") + F.col("depth")).alias("depth"), "lost"))
    solved = landed.select("top", "part", "exit", "exit_w", "x_part").join(solved.drop("part", "parent").withColumnRenamed("id", "top"), "top")
    if with_sizes:
        solved = cut(solved)
    fragments = solved.select(F.col("top").alias("id"), "part", "root", "depth", "lost", *(["path"] if with_path else []), F.lit(1).alias("tag"))
    hung = solved.where(F.col("x_part").isNotNull() & ~F.col("lost")).select(F.col("exit").alias("id"), F.col("x_part").alias("part"), F.col("size").alias("own"), (F.col("height") + F.col("exit_w")).alias("tall"), F.lit(2).alias("tag")) if with_sizes else None
    return _expanded(_united(base, fragments, hung, with_path, with_sizes).repartitionById(n_parts, "part"), with_path, with_sizes)


def _united(base: DataFrame, fragments: DataFrame | None, hung: DataFrame | None, with_path: bool, with_sizes: bool) -> DataFrame:
    out = base
    for d in (fragments, hung):
        if d is not None:
            out = out.unionByName(d, allowMissingColumns=True)
    kinds = {"root": "string", "depth": "bigint", "path": "string"}
    for c in ("root", "depth", "path"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kinds[c]))
    return out


def _placed(links: DataFrame, rows_per_task: int) -> tuple[DataFrame, int]:
    """Current links in partitions of sessions; a session too large for one task is dealt out by its days."""
    nodes = current_links(links)
    most = min(HOT_ROWS, rows_per_task)
    hot = links.groupBy("session_id").count().where(F.col("count") > most)
    hot = hot.select(F.col("session_id").alias("h_session"), F.ceil(F.col("count") / most).alias("deals"))
    n_hot = hot.limit(MOST_HOT + 1).count()
    deal = F.lit(0)
    if n_hot:
        nodes = nodes.join(F.broadcast(hot) if n_hot <= MOST_HOT else hot, F.col("session_id").eqNullSafe(F.col("h_session")), "left")
        deal = F.when(F.col("deals").isNotNull(), F.pmod(F.xxhash64("day"), F.col("deals")))
    n_parts = max(parts(links.sparkSession), -(-links.count() // rows_per_task))
    placed = nodes.repartition(n_parts, F.col("session_id"), deal)
    return placed.select("id", "parent", F.lit(1).cast("bigint").alias("w"), F.lit(False).alias("lost")), n_parts


def hierarchy(links: DataFrame, with_path: bool = False, with_sizes: bool = False, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(msg_uuid, root_uuid, node_depth[, path][, n_descendants, height]) of every message of ``links``
    (link_id, msg_uuid, parent_uuid, session_id, is_sidechain, seen_at)."""
    nodes, n_parts = _placed(links, rows_per_task)
    if with_path:
        nodes = nodes.withColumn("seg", F.col("id"))
    if with_sizes:
        nodes = nodes.withColumns({"own": F.lit(1).cast("bigint"), "tall": F.lit(0).cast("bigint")})
    full = _solve(nodes, n_parts, with_path, with_sizes, rows_per_task)
    cols = [F.col("id").alias("msg_uuid"), F.when(F.col("lost"), "").otherwise(F.col("root")).alias("root_uuid"), F.when(F.col("lost"), -1).otherwise(F.col("depth")).cast("bigint").alias("node_depth")]
    return full.select(*cols, *(["path"] if with_path else []), *([(F.col("size") - 1).alias("n_descendants"), "height"] if with_sizes else []))


def intervals(links: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(msg_uuid, root_uuid, first, last): numbers of the pre-order walk of each tree, siblings in order of their ids.
    The descendants of a message are those of its root with a number after ``first`` up to ``last``; all null on loops.

    A node lies 1 + the sizes of its elder siblings after its parent, so its number is its depth by these weights: the
    same contraction run again. Siblings are summed in slices of their ids' first two characters, so that the children of one
    message may be any share of all rows.
    """
    nodes, n_parts = _placed(links, rows_per_task)
    nodes = nodes.withColumns({"own": F.lit(1).cast("bigint"), "tall": F.lit(0).cast("bigint")})
    tree = cut(_solve(nodes, n_parts, False, True, rows_per_task))
    slice_ = F.substring("id", 1, 2).alias("slice")
    kids = tree.where(~F.col("lost") & (F.col("depth") > 0)).select("id", "parent", "part", "size", slice_)
    before = Window.partitionBy("parent").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = kids.groupBy("parent", "slice").agg(F.sum("size").alias("s")).select("parent", "slice", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    elder = F.coalesce(F.sum("size").over(Window.partitionBy("parent", "slice").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kids = kids.withColumn("elder", elder).join(starts, ["parent", "slice"])
    stepped = kids.select("id", "parent", (1 + F.col("elder") + F.col("start")).cast("bigint").alias("w"), "part")
    roots = tree.where(~F.col("lost") & (F.col("depth") == 0)).select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("w"), "part")
    placed = stepped.unionByName(roots).repartitionById(n_parts, "part").select("id", "parent", "w", F.lit(False).alias("lost"))
    walked = _solve(placed, n_parts, False, False, rows_per_task).select("id", F.col("depth").alias("first"))
    out = tree.join(walked, "id", "left")
    return out.select(F.col("id").alias("msg_uuid"), F.when(F.col("lost"), "").otherwise(F.col("root")).alias("root_uuid"), "first", (F.col("first") + F.col("size") - 1).alias("last"))


def descendants(tree: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs along the paths, the node itself left out."""
    return (
        tree.where(F.col("node_depth") > 0)
        .select(F.posexplode(F.split("path", SEP)).alias("pos", "ancestor_uuid"), F.col("msg_uuid").alias("descendant_uuid"), (F.col("node_depth") - F.col("pos")).cast("bigint").alias("distance"))
        .where(F.col("distance") > 0)
        .drop("pos")
    )
