"""Problem 8: texts packed into containers of fixed capacity, in tiers of context size.

Sizes are small integers, so a corpus of any length packs through its size histogram: at most ``capacity`` counts a
plan, the only thing that reaches the driver. Sizes are packed best fit decreasing (:func:`plan_patterns`): as all
containers of a plan have one capacity, going through context-size tiers from the longest to the shortest and filling
the gaps of longer ones first is the same, so tiers only label a container by its longest text. A pattern is a multiset of sizes with the number of containers that hold it. Rows then
find their place by arithmetic: the number of a row among those of its size (:mod:`weftline.operators.ranks`)
looks up pattern, container and offset. Containers are dealt to step groups in snake order of their fill, so the
groups of a step carry about the same number of tokens.

Defined results: null texts are in no container; an empty text takes one token's room; a text longer than the
capacity is cut into full pieces and a rest, no other text is cut; repeated texts are packed each; no documents or
no plans give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import TOKENIZER, sized
from weftline.operators.ranks import numbered
from weftline.session import cut

#: Upper bounds of the context-size tiers below a plan's capacity.
TIERS = (256, 1024, 4096, 16384, 65536)
GROUP = 8


def plan_patterns(histogram: Mapping[int, int], capacity: int, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int]], int]]:
    """Pack sizes (size -> count, sizes <= capacity): (containers, [(size, times)], tier) for each pattern."""
    bounds = sorted({t for t in tiers if t < capacity} | {capacity})
    groups: list[tuple[int, int]] = []  # (room left, pattern), sorted
    count: dict[int, int] = {}
    items: dict[int, dict[int, int]] = {}
    tier_of: dict[int, int] = {}
    fresh = 0

    def put(room: int, held: dict[int, int], n: int, tier: int) -> None:
        nonlocal fresh
        count[fresh], items[fresh], tier_of[fresh] = n, held, tier
        insort(groups, (room, fresh))
        fresh += 1

    for level in range(len(bounds) - 1, -1, -1):
        low = bounds[level - 1] if level else 0
        for size in sorted((s for s in histogram if low < s <= bounds[level]), reverse=True):
            left = histogram[size]
            while left:
                i = bisect_left(groups, (size, -1))
                if i == len(groups):
                    each = capacity // size
                    whole, rest = divmod(left, each)
                    if whole:
                        put(capacity - each * size, {size: each}, whole, bounds[level])
                    if rest:
                        put(capacity - rest * size, {size: rest}, 1, bounds[level])
                    break
                room, p = groups.pop(i)
                each = min(room // size, left)
                n = min(count[p], left // each)
                held = dict(items[p])
                held[size] = held.get(size, 0) + each
                if n < count[p]:
                    count[p] -= n
                    insort(groups, (room, p))
                    put(room - each * size, held, n, tier_of[p])
                else:
                    items[p] = held
                    insort(groups, (room - each * size, p))
                left -= n * each
    return [(count[p], sorted(items[p].items(), reverse=True), tier_of[p]) for _, p in sorted(groups, key=lambda g: g[1])]


def _lookup(patterns: list[tuple[int, list[tuple[int, int]], int]], capacity: int) -> dict[str, np.ndarray]:
    """Arrays that turn (size, number among its size) into container, offset, fill order and tier."""
    rows, first = [], 0
    by_fill = sorted(range(len(patterns)), key=lambda k: -sum(s * m for s, m in patterns[k][1]))
    dealt, at = {}, 0
    for k in by_fill:
        dealt[k] = at
        at += patterns[k][0]
    used: dict[int, int] = {}
    for k, (n, held, tier) in enumerate(patterns):
        offset = 0
        for size, times in held:
            start = used.get(size, 0)
            rows.append((size, start, first, times, offset, dealt[k], tier))
            used[size] = start + n * times
            offset += size * times
        first += n
    rows.sort()
    t = np.array(rows, np.int64).reshape(-1, 7)
    return {"key": t[:, 0] << 40 | t[:, 1], "first": t[:, 2], "times": t[:, 3], "offset": t[:, 4], "dealt": t[:, 5], "tier": t[:, 6], "total": np.array([max(first, 1)])}


def pack(docs: DataFrame, plans: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, max_plans: int = 100) -> DataFrame:
    """(plan_id, container_id, step_group, doc_id, piece_no, start_token, n_tokens, container_offset, tier).

    ``plans`` (plan_id, capacity_tokens) is a small parameter table: more than ``max_plans`` rows are refused.
    """
    spark = docs.sparkSession
    plan_rows = sorted({(r[0], r[1]) for r in plans.where(F.col("plan_id").isNotNull() & (F.col("capacity_tokens") > 0)).select("plan_id", "capacity_tokens").limit(max_plans + 1).collect()})
    if len(plan_rows) > max_plans:
        raise ValueError(f"more than {max_plans} plans")
    schema = "plan_id bigint, container_id bigint, step_group bigint, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint, container_offset bigint, tier bigint"
    if not plan_rows:
        return spark.createDataFrame([], schema)
    sizes = cut(sized(docs, id_col, text_col, path=path).where("n_tokens IS NOT NULL").select(F.col(id_col).alias("doc_id"), F.greatest("n_tokens", F.lit(1)).alias("n_tokens")))
    plan = F.explode(F.array(*[F.struct(F.lit(p).cast("bigint").alias("plan_id"), F.lit(c).cast("bigint").alias("cap")) for p, c in plan_rows]))
    pieces = sizes.withColumn("p", plan).select("doc_id", "n_tokens", "p.*")
    pieces = pieces.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / F.col("cap")).cast("int") - 1)))
    pieces = pieces.select("plan_id", "doc_id", "piece_no", (F.col("piece_no") * F.col("cap")).alias("start_token"), F.least("cap", F.col("n_tokens") - F.col("piece_no") * F.col("cap")).alias("size"))
    # at most the sum of all capacities counts; nothing that grows with the corpus
    hist: dict[int, dict[int, int]] = {p: {} for p, _ in plan_rows}
    for p, s, n in pieces.groupBy("plan_id", "size").count().collect():
        hist[p][s] = n
    tables = {p: _lookup(plan_patterns(hist[p], c), c) for p, c in plan_rows}
    box = spark.sparkContext.broadcast(tables)
    ranked = numbered(pieces.withColumn("k", F.struct("doc_id", "piece_no")), ["plan_id", "size"], "k").drop("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            plan, size, rank = (b[c].to_numpy() for c in ("plan_id", "size", "rank"))
            for p in np.unique(plan):
                at = np.flatnonzero(plan == p)
                rows, t = b.take(pa.array(at)), box.value[int(p)]
                key = size[at] << 40 | rank[at]
                i = np.searchsorted(t["key"], key, "right") - 1
                off = key - t["key"][i]
                nth = off // t["times"][i]
                deal = t["dealt"][i] + nth
                groups = -(-int(t["total"][0]) // GROUP)
                lap, col = deal // groups, deal % groups
                step = np.where(lap % 2 == 0, col, groups - 1 - col)
                cols = [rows["plan_id"], pa.array(t["first"][i] + nth), pa.array(step), rows["doc_id"], rows["piece_no"], rows["start_token"], rows["size"], pa.array(t["offset"][i] + off % t["times"][i] * size[at]), pa.array(t["tier"][i])]
                yield pa.RecordBatch.from_arrays(cols, names=["plan_id", "container_id", "step_group", "doc_id", "piece_no", "start_token", "n_tokens", "container_offset", "tier"])

    return ranked.select("plan_id", "doc_id", "piece_no", "start_token", "size", "rank").mapInArrow(run, schema)


def report(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """Containers, fill and step balance of each plan, with the least number of containers any packing needs."""
    box = packed.groupBy("plan_id", "container_id", "step_group").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n_pieces"))
    group = box.groupBy("plan_id", "step_group").agg(F.sum("used").alias("used"), F.count(F.lit(1)).alias("n"), F.max("used").alias("fullest"), F.sum("n_pieces").alias("n_pieces"))
    out = group.groupBy("plan_id").agg(F.sum("n").alias("n_containers"), F.sum("used").alias("used_tokens"), F.max("fullest").alias("fullest"), F.sum("n_pieces").alias("n_pieces"), F.count(F.lit(1)).alias("n_step_groups"), F.min("used").alias("lightest_group"), F.max("used").alias("heaviest_group"))
    out = out.join(F.broadcast(plans.select("plan_id", "plan_label", "capacity_tokens").limit(100)), "plan_id", "left")
    return out.withColumns({"least_containers": F.ceil(F.col("used_tokens") / F.col("capacity_tokens")), "fill": F.round(F.col("used_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6)})
