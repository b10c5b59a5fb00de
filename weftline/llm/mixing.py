"""Problem 9: a mix of sources with target shares by size.

The expected number of copies of a document is the same within a source, e = share x total / tokens of the source,
never above the source's ``max_repeats``; by default the total is the largest at which no source passes its cap.
Within a source, documents are numbered in order of size class (so the sampled sizes are spread evenly), the
numbers times e are the prefix sums of expected copies, and with one random offset a document is emitted once for
each integer its interval crosses: floor(e) or ceil(e) times, and e times on average over offsets. What a source
misses of its quota, less than a document of each size class or so, is reported by :func:`shares`. Numbering is cut into (size class, salt) slices, so a
source with a third of all rows is never sorted in one task; only the histogram of slices is summed over.

Defined results: null texts, null sources and sources without a target are left out; a target without documents
is reported with what it reached, 0, and the others share its part; empty texts have size 0 and are emitted like
others; repeated texts count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.tokens import TOKENIZER, sized
from weftline.operators.ranks import numbered
from weftline.session import cut


def quotas(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, share, max_repeats, n_docs, tokens, copies): expected copies of each document of a source."""
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    t = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(have, "source", "left").fillna(0, ["n_docs", "tokens"])
    every = Window.partitionBy(F.lit(1))  # one row a source of the target table
    t = t.withColumn("share", F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0))
    t = t.withColumn("share", F.coalesce(F.try_divide("share", F.sum("share").over(every)), F.lit(0.0)))
    limit = F.min(F.when(F.col("share") > 0, F.col("max_repeats") * F.col("tokens") / F.col("share"))).over(every)
    t = t.withColumn("total", F.least(limit, F.lit(float(total_tokens))) if total_tokens else limit)
    return t.withColumn("copies", F.when(F.col("tokens") > 0, F.least(F.col("share") * F.col("total") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0))


def _sizes(docs: DataFrame, path: str) -> DataFrame:
    return cut(sized(docs.where("source IS NOT NULL"), "doc_id", "text", ("source",), path).where("n_tokens IS NOT NULL"))


def _emitted(sizes: DataFrame, targets: DataFrame, total_tokens: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    quota = quotas(sizes, targets, total_tokens)
    # 8 size classes an octave; a class and salt is a slice of the numbering
    cls = F.floor(8 * F.log2(F.col("n_tokens") + 1)).cast("int")
    d = numbered(sizes.withColumn("cls", cls), ["source", "cls"], "doc_id")
    per = sizes.withColumn("cls", cls).groupBy("source", "cls").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("source", "cls", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    # both are bounded: a few hundred size classes a source, one row a target
    d = d.join(starts, ["source", "cls"]).join(F.broadcast(quota.select("source", "copies").where("copies > 0")), "source")
    d = d.select("doc_id", "source", "n_tokens", "copies", (F.col("start") + F.col("rank")).alias("i"))
    u = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) / float(1 << 30)
    n = F.floor((F.col("i") + 1) * F.col("copies") + u) - F.floor(F.col("i") * F.col("copies") + u)
    return d.select("doc_id", "source", "n_tokens", n.cast("int").alias("n_copies")).where("n_copies > 0"), quota


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 20, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens): one row for each emitted copy."""
    out, _ = _emitted(_sizes(docs, path), targets, total_tokens, seed)
    return out.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"), "n_tokens")


def shares(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 20, path: str = TOKENIZER) -> DataFrame:
    """One row a target: its share, what it has, the expected copies, its quota, and the tokens and share it reached."""
    out, quota = _emitted(_sizes(docs, path), targets, total_tokens, seed)
    got = out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("mix_tokens"), F.sum("n_copies").cast("bigint").alias("mix_docs"), F.max("n_copies").alias("most_copies"))
    t = quota.join(got, "source", "left").fillna(0, ["mix_tokens", "mix_docs", "most_copies"])
    every = Window.partitionBy(F.lit(1))
    return t.select("source", "target_share", "max_repeats", "n_docs", "tokens", F.round("copies", 6).alias("expected_copies"), F.round(F.col("tokens") * F.col("copies"), 3).alias("quota_tokens"), "mix_docs", "mix_tokens", "most_copies", F.round(F.coalesce(F.try_divide(F.col("mix_tokens"), F.sum("mix_tokens").over(every)), F.lit(0.0)), 6).alias("reached_share"))
