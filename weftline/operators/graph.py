"""Conversation graphs: validation, mainline, leaves, talks and windows, for all sessions at once.

Placements: session_id, placement_id, message_id, document_id, ordinal, is_sidechain, ts_raw. Edges:
child_placement_id, parent_message_id. The mainlines of all sessions are found together, by vectorised walks inside
partitions of sessions; a session too large for one task is cut into its days.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.instant import order_key
from weftline.operators.ranks import running_sum
from weftline.session import cut, parts


def violations(sessions: DataFrame, messages: DataFrame, documents: DataFrame, placements: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, key): one row for each breach. A parent that is in no session is legal."""
    rules = []

    def rule(name: str, d: DataFrame, key: str) -> None:
        rules.append(d.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key")))

    for name, d, key in (("message_id_repeated", messages, "message_id"), ("document_id_repeated", documents, "document_id"), ("placement_id_repeated", placements, "placement_id")):
        rule(name, d.groupBy(key).count().where("count > 1"), key)
    coords = placements.groupBy("session_id", "document_id", "message_id", "ordinal").agg(F.count(F.lit(1)).alias("n"), F.min("placement_id").alias("placement_id")).where("n > 1")
    rule("coordinates_repeated", coords, "placement_id")
    rule("placement_session_unknown", placements.join(sessions, "session_id", "left_anti"), "placement_id")
    rule("placement_message_unknown", placements.join(messages, "message_id", "left_anti"), "placement_id")
    rule("placement_document_unknown", placements.join(documents, "document_id", "left_anti"), "placement_id")
    if {"span_start", "span_end"} <= set(placements.columns) and "len" in documents.columns:
        p = placements.join(documents.select("document_id", "len"), "document_id")
        rule("span_outside", p.where("span_start > span_end OR span_end > len OR span_start < 0"), "placement_id")
    child = edges.withColumnRenamed("child_placement_id", "placement_id")
    rule("edge_child_unknown", child.join(placements.select("placement_id"), "placement_id", "left_anti"), "placement_id")
    rule("edge_child_repeated", child.groupBy("placement_id").count().where("count > 1"), "placement_id")
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def candidates(placements: DataFrame) -> DataFrame:
    """Placements outside sidechains; of a session without any, all."""
    main = placements.where(~F.coalesce("is_sidechain", F.lit(False))).select("session_id").distinct().withColumn("_main", F.lit(True))
    d = placements.join(main, "session_id", "left")
    return d.where(F.col("_main").isNull() | ~F.coalesce("is_sidechain", F.lit(False))).drop("_main")


def placement_order(ts_raw: str = "ts_raw") -> Column:
    return F.struct(order_key(F.col(ts_raw)).alias("k"), "document_id", "ordinal", "placement_id")


def leaves(placements: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates whose message is no candidate's parent, with ``has_parent``: the placement has an edge of its own."""
    c = candidates(placements)
    e = edges.select(F.col("child_placement_id").alias("placement_id"), "parent_message_id")
    own = c.join(e, "placement_id").select("session_id", F.col("parent_message_id").alias("message_id")).distinct()
    out = c.join(own, ["session_id", "message_id"], "left_anti")
    return out.join(e.select("placement_id").distinct().withColumn("has_parent", F.lit(True)), "placement_id", "left").withColumn("has_parent", F.coalesce("has_parent", F.lit(False)))


def chosen_leaf(placements: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, placement_id): the latest leaf that has a parent, else the latest leaf, else the latest candidate."""
    lf = leaves(placements, edges).select("session_id", placement_order().alias("o"), F.when(F.col("has_parent"), 2).otherwise(1).alias("p"))
    al = candidates(placements).select("session_id", placement_order().alias("o"), F.lit(0).alias("p"))
    return lf.unionByName(al).groupBy("session_id").agg(F.max(F.struct("p", "o")).alias("b")).select("session_id", F.col("b.o.placement_id").alias("placement_id"))


#: Placements of one session that are kept together, and most sessions beyond it whose list is broadcast.
HOT_ROWS = 100_000
MOST_HOT = 100_000


def _bucketed(placements: DataFrame) -> DataFrame:
    """Add ``bucket``: empty, or the day in sessions of more than HOT_ROWS placements, so that a long session spreads over its days."""
    hot = placements.groupBy("session_id").count().where(F.col("count") > HOT_ROWS).select("session_id", F.lit(True).alias("_hot"))
    n = hot.limit(MOST_HOT + 1).count()
    if not n:
        return placements.withColumn("bucket", F.lit(""))
    d = placements.join(F.broadcast(hot) if n <= MOST_HOT else hot, "session_id", "left")
    return d.withColumn("bucket", F.when(F.col("_hot"), F.coalesce(F.left("ts_raw", F.lit(10)), F.lit(""))).otherwise("")).drop("_hot")


def resolved_parents(placements: DataFrame, edges: DataFrame) -> DataFrame:
    """(placement_id, session_id, parent_placement_id, parent_bucket, ambiguous) over all placements of the session:
    none, the only one, or of several the only one in the child's document."""
    e = edges.select(F.col("child_placement_id").alias("placement_id"), "parent_message_id")
    child = placements.select("placement_id", "session_id", F.col("document_id").alias("doc")).join(e, "placement_id")
    bucket = F.col("bucket") if "bucket" in placements.columns else F.lit("")
    up = placements.select("session_id", F.col("message_id").alias("parent_message_id"), F.struct(F.col("placement_id").alias("id"), bucket.alias("bucket")).alias("pp"), "document_id")
    j = child.join(up, ["session_id", "parent_message_id"], "left").groupBy("placement_id", "session_id").agg(
        F.count("pp").alias("n"), F.min("pp").alias("one"), F.count(F.when(F.col("document_id") == F.col("doc"), 1)).alias("same"), F.min(F.when(F.col("document_id") == F.col("doc"), F.col("pp"))).alias("near")
    )
    parent = F.when(F.col("n") == 1, F.col("one")).when((F.col("n") > 1) & (F.col("same") == 1), F.col("near"))
    return j.select("placement_id", "session_id", parent["id"].alias("parent_placement_id"), parent["bucket"].alias("parent_bucket"), ((F.col("n") > 1) & (F.col("same") != 1)).alias("ambiguous"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the entries of a partition up its own placements, all sessions in step; where a parent lies elsewhere, an exit."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    is_entry = t["up"].is_valid().to_numpy()
    nodes, entries = t.filter(pa.array(~is_entry)), t.filter(pa.array(is_entry))
    ids = nodes["id"].combine_chunks()
    parent = nodes["parent"].combine_chunks()
    p = pc.fill_null(pc.if_else(pc.is_null(parent), pa.scalar(None, pa.int32()), pc.index_in(parent, value_set=ids)), -1).to_numpy().astype(np.int64)
    at = pc.fill_null(pc.index_in(entries["id"].combine_chunks(), value_set=ids), -1).to_numpy().astype(np.int64)
    up = entries["up"].to_numpy().astype(np.int64)
    up, at = up[at >= 0], at[at >= 0]
    seen = np.zeros(len(ids), bool)
    rows, ups, outs, out_ups = [], [], [], []
    while len(at):
        fresh = ~seen[at]
        at, up = at[fresh], up[fresh]
        seen[at] = True
        rows.append(at)
        ups.append(up)
        nxt = p[at]
        gone = (nxt < 0) & pc.is_valid(parent.take(pa.array(at))).to_numpy(zero_copy_only=False)
        outs.append(at[gone])
        out_ups.append(up[gone] + 1)
        at, up = nxt[nxt >= 0], up[nxt >= 0] + 1
    if rows:
        r, o = pa.array(np.concatenate(rows)), pa.array(np.concatenate(outs))
        found = [nodes["session_id"].take(r), nodes["bucket"].take(r), ids.take(r), pa.array(np.concatenate(ups)), pa.array(np.zeros(len(r), bool))]
        left = [nodes["session_id"].take(o), nodes["parent_bucket"].take(o), parent.take(o), pa.array(np.concatenate(out_ups)), pa.array(np.ones(len(o), bool))]
        names = ["session_id", "bucket", "id", "up", "is_exit"]
        yield from pa.concat_tables([pa.table(dict(zip(names, c))) for c in (found, left)]).to_batches()


def mainline(placements: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, position, placement_id, message_id, ambiguous): the branch of the chosen leaf, root first, from 0.

    Placements lie by session; every partition walks all its branches upward at once. Only in sessions cut into days
    can a branch go on elsewhere and take a further round, with just the placements of their sessions. A loop ends at
    the first placement seen again. ``ambiguous`` marks a placement whose parent could not be told.
    """
    n = parts(placements.sparkSession)
    placements = _bucketed(placements)
    par = resolved_parents(placements, edges)
    nodes = cut(placements.select("session_id", "placement_id", "message_id", "bucket").join(par.drop("session_id"), "placement_id", "left"))
    leaf = chosen_leaf(placements, edges)
    entries = nodes.select("session_id", "placement_id", "bucket").join(leaf.select("placement_id"), "placement_id", "left_semi").select("session_id", "bucket", F.col("placement_id").alias("id"), F.lit(0).cast("bigint").alias("up"))
    base = nodes.select("session_id", "bucket", F.col("placement_id").alias("id"), F.col("parent_placement_id").alias("parent"), "parent_bucket", F.lit(None).cast("bigint").alias("up"))
    line, here = None, base
    while True:
        tagged = here.unionByName(entries.select("session_id", "bucket", "id", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("parent_bucket"), "up"))
        step = cut(tagged.repartition(n, "session_id", "bucket").mapInArrow(_walk, "session_id string, bucket string, id string, up bigint, is_exit boolean"))
        found = step.where("NOT is_exit").select("session_id", F.col("id").alias("placement_id"), "up")
        line = found if line is None else line.unionByName(found)
        if step.where("is_exit").isEmpty():
            break
        # a branch that comes back to where it was is a loop
        entries = step.where("is_exit").select("session_id", "bucket", "id", "up").join(line.select(F.col("placement_id").alias("id")), "id", "left_anti").select("session_id", "bucket", "id", "up")
        if entries.isEmpty():
            break
        # without the placements already on the line, so that a walk that meets its own line leaves it as an exit and ends
        here = base.join(entries.select("session_id").distinct(), "session_id", "left_semi").join(line.select(F.col("placement_id").alias("id")), "id", "left_anti").select(*base.columns)
    top = line.groupBy("session_id").agg(F.max("up").alias("top"))
    out = line.join(top, "session_id").join(nodes.select("placement_id", "message_id", "ambiguous"), "placement_id")
    return out.select("session_id", (F.col("top") - F.col("up")).alias("position"), "placement_id", "message_id", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def full_order(placements: DataFrame) -> DataFrame:
    return placements.orderBy("session_id", placement_order())


def talks(line: DataFrame, order: str = "position", role: str = "role", session: str = "session_id", stretch: int = 10_000) -> DataFrame:
    """Add talk_no: each user message opens a talk, assistant and tool messages join it; what precedes the first user
    message and all other roles fall away. Sessions are counted in stretches of ``stretch`` of the numeric ``order``."""
    d = line.where(F.col(role).isin("user", "assistant", "tool"))
    d = running_sum(d, [session], [order], (F.col(role) == "user").cast("bigint"), F.floor(F.col(order) / stretch), "talk_no")
    return d.withColumn("talk_no", F.col("talk_no").cast("bigint")).where("talk_no > 0")


def window_around(line: DataFrame, anchors: DataFrame, around: int, order: str = "position", session: str = "session_id") -> DataFrame:
    """Rows within ``around`` positions of the session's anchor position; ends clamp."""
    a = anchors.select(session, F.col(order).alias("_anchor"))
    return line.join(a, session).where(F.abs(F.col(order) - F.col("_anchor")) <= around).drop("_anchor")


def grown_window(line: DataFrame, anchors: DataFrame, cost: Column, max_items: int, max_bytes: int, order: str = "position", session: str = "session_id") -> DataFrame:
    """Window grown from the anchor, before and after in turn, until the items or bytes are used up; a side that ends
    leaves its turns to the other."""
    a = anchors.select(session, F.col(order).alias("_anchor"))
    d = line.join(a, session).withColumn("_cost", cost).withColumn("_d", F.col(order) - F.col("_anchor"))
    both = Window.partitionBy(session)
    d = d.withColumns({"_before": F.max(F.greatest(-F.col("_d"), F.lit(0))).over(both), "_after": F.max(F.greatest(F.col("_d"), F.lit(0))).over(both)})
    k = F.abs("_d")
    other = F.when(F.col("_d") < 0, F.col("_after")).otherwise(F.col("_before"))
    turn = F.when(F.col("_d") == 0, 0).when(k <= other, 2 * k - (F.col("_d") < 0).cast("int")).otherwise(k + other)
    w = Window.partitionBy(session).orderBy(turn)
    d = d.withColumns({"_i": F.row_number().over(w), "_sum": F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return d.where((F.col("_i") <= max_items) & (F.col("_sum") <= max_bytes)).drop("_anchor", "_cost", "_d", "_before", "_after", "_i", "_sum")
