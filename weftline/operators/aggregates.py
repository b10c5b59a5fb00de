"""Totals and summaries. Unknown is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")


def usage_totals(usage: DataFrame) -> DataFrame:
    """One row: distinct sessions, five sums, observed and derived events; sums are null without any event."""
    return usage.agg(F.count_distinct("session_id").alias("sessions"), *[F.sum(b).alias(b) for b in BUCKETS], F.count_if(F.col("token_source") == "observed").alias("observed"), F.count_if(F.col("token_source") == "derived").alias("derived"))


def repo_totals(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("repo_slug").isNotNull()).groupBy("repo_slug").agg(F.count_distinct("session_id").alias("sessions")).orderBy(F.desc("sessions"), F.asc("repo_slug"))


def session_summary(line: DataFrame, refs: DataFrame | None = None, order: str = "ordinal") -> DataFrame:
    """(session_id, first_request, message_count, turn_count[, file_references]) of each session."""
    key = F.struct(order, "id")
    out = line.groupBy("session_id").agg(F.min_by("text", F.when(F.col("role") == "user", key)).alias("first_request"), F.count(F.lit(1)).alias("message_count"), F.count_if(F.col("role") == "user").alias("turn_count"))
    if refs is not None:
        first = refs.groupBy("session_id", "target").agg(F.min(order).alias("o"))
        files = first.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "target"))), lambda x: x["target"]).alias("file_references"))
        out = out.join(files, "session_id", "left")
    return out


def session_peek(line: DataFrame, order: str = "ordinal", chars: int = 200) -> DataFrame:
    """First and last non-blank user text of each session, cut to ``chars`` characters."""
    u = line.where((F.col("role") == "user") & (F.trim("text") != ""))
    key = F.struct(order, "id")
    return u.groupBy("session_id").agg(F.left(F.trim(F.min_by("text", key)), F.lit(chars)).alias("first"), F.left(F.trim(F.max_by("text", key)), F.lit(chars)).alias("last"))


def fit_peek(peek: DataFrame, max_bytes: int = 1024) -> DataFrame:
    """Shorten both texts evenly until their JSON fits; closed form per row, checked and shrunk by quarters."""
    size = F.octet_length(F.to_json(F.struct("first", "last")))
    d = peek
    for cut_to in (200, 150, 110, 80, 60, 40, 20):
        over = size > max_bytes
        d = d.withColumns({c: F.when(over, F.left(F.col(c), F.lit(cut_to))).otherwise(F.col(c)) for c in ("first", "last")})
    return d


def session_title(sessions: DataFrame, line: DataFrame, order: str = "ordinal", chars: int = 80) -> DataFrame:
    """Custom title, else the summary, else the first user message with visible text; at most ``chars`` characters."""
    first = line.where((F.col("role") == "user") & (F.trim("text") != "")).groupBy("session_id").agg(F.min_by("text", F.struct(order, "id")).alias("request"))
    cols = [F.nullif(F.trim(c), F.lit("")) for c in ("title", "summary") if c in sessions.columns] + [F.trim("request")]
    return sessions.join(first, "session_id", "left").select("session_id", F.left(F.coalesce(*cols), F.lit(chars)).alias("title"))


def latest_activity(line: DataFrame, ts: str = "ts") -> DataFrame:
    return line.groupBy("session_id").agg(F.date_format(F.max(ts), "yyyy-MM-dd").alias("latest"))


def orphan_counts(facts: dict[str, DataFrame], messages: DataFrame, key: str = "message_id") -> DataFrame:
    out = None
    for name, d in facts.items():
        n = d.where(F.col(key).isNotNull()).join(messages.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("facts"), "orphans")
        out = n if out is None else out.unionByName(n)
    return out


def matched_sessions(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """Hits counted by session, in order of first appearance, with the score of the first."""
    return hits.groupBy("session_id").agg(F.count(F.lit(1)).alias("occurrences"), F.min(rank).alias("first_rank"), F.min_by("score", rank).alias("first_score")).orderBy("first_rank")


def recall_at(found: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Recall of each query: ``found`` (query_id, id, rank), ``wanted`` (query_id, id)."""
    hit = wanted.join(found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def percentiles(df: DataFrame, col: str, groups: list[str], at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles."""
    return df.groupBy(*groups).agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})").alias(f"p{round(p * 100)}") for p in at])


def content_hash(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, digest): a digest of each table's contents that does not depend on the order of its rows.

    A row is the SHA-256 of its columns in order of their names, each framed by its length in bytes; null is a dash, times
    are microseconds, nested values JSON. The four 60-bit quarters of the digests are summed modulo 2**61 - 1, so partial
    sums combine in any order and equal rows count each. Nothing is gathered or sorted.
    """

    def text(df: DataFrame, c: str) -> Column:
        kind = df.schema[c].dataType.typeName()
        return F.unix_micros(F.col(c).cast("timestamp")).cast("string") if kind.startswith("timestamp") else F.to_json(c) if kind in ("array", "struct", "map") else F.col(c).cast("string")

    out = None
    for name, df in tables.items():
        framed = [F.coalesce(F.concat(F.octet_length(text(df, c)).cast("string"), F.lit(":"), text(df, c)), F.lit("-")) for c in sorted(df.columns)]
        d = df.select(F.sha2(F.concat_ws(",", *framed), 256).alias("h"))
        quarter = [F.conv(F.substring("h", 16 * k + 2, 15), 16, 10).cast("decimal(28,0)") for k in range(4)]
        one = d.agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(q), F.lit(0)).cast("decimal(38,0)").alias(f"q{k}") for k, q in enumerate(quarter)])
        one = one.select(F.lit(name).alias("table_name"), "n_rows", F.concat(*[F.lpad(F.hex((F.col(f"q{k}") % F.lit(2**61 - 1).cast("decimal(38,0)")).cast("bigint")), 16, "0") for k in range(4)]).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def activity_targets(activities: DataFrame, kind: str, status: str | None = None, order: str = "ordinal") -> DataFrame:
    """Distinct targets of a kind of activity of each session, in order of first use."""
    a = activities.where((F.col("kind") == kind) & F.col("target").isNotNull())
    if status:
        a = a.where(F.col("status") == status)
    first = a.groupBy("session_id", "target").agg(F.min(order).alias("o"))
    return first.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "target"))), lambda x: x["target"]).alias("targets"))
