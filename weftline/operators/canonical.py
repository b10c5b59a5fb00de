"""Events of parsed sources to the canonical tables: sessions, documents, messages, placements, edges, activities, usage.

Everything is joins and aggregates on ids; a source with an error contributes nothing (all or nothing per source).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import ids


@dataclass
class Tables:
    sessions: DataFrame
    documents: DataFrame
    messages: DataFrame
    placements: DataFrame
    edges: DataFrame
    activities: DataFrame
    usage: DataFrame
    claims: DataFrame
    problems: DataFrame


def problems(events: DataFrame) -> DataFrame:
    """(path, problem): fatal errors, and sources that emitted other than they report."""
    rep = events.where("event = 'report'")
    n = events.where("event = 'message'").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    off = rep.where("error IS NULL").join(n, "path", "left").where(F.coalesce("n", F.lit(0)) != F.col("committed"))
    return rep.where("error IS NOT NULL").select("path", F.col("error").alias("problem")).unionByName(off.select("path", F.lit("emitted and committed counts differ").alias("problem")))


def canonicalise(events: DataFrame, namespace: str = "default") -> Tables:
    bad = problems(events)
    ok = events.join(bad.select("path").distinct(), "path", "left_anti")
    doc = ids.document_id(F.col("provider_id"), F.col("variant_id"), F.col("fingerprint"))
    ok = ok.withColumn("document_id", doc)
    rep = ok.where("event = 'report'").groupBy("document_id").agg(F.first("session", True).alias("rep_session"), F.first("cwd", True).alias("rep_cwd"))
    m = ok.where("event = 'message'").join(rep, "document_id", "left")
    native = F.coalesce("session", "rep_session")
    m = m.withColumn("session_id", ids.session_id(F.col("provider_id"), F.lit(namespace), native, F.col("document_id"))).withColumn("session_native", native)
    mid, stable = ids.message_id(F.col("native_id"), F.col("provider_id"), F.col("variant_id"), F.col("document_id"), F.col("seq"))
    m = m.withColumn("message_id", mid).withColumn("stable", stable)
    m = m.withColumn("placement_id", ids.placement_id(F.col("session_id"), F.col("document_id"), F.col("message_id"), F.col("seq")))
    # one message of an id within a source must say one thing
    conflict = m.groupBy("path", "message_id").agg(F.count_distinct(F.struct("role", "text", F.coalesce("timestamp", F.lit("\u0000")))).alias("n")).where("n > 1")
    bad = bad.unionByName(conflict.select("path", F.concat(F.lit("message differs from itself: "), "message_id").alias("problem")))
    m = m.join(conflict.select("path").distinct(), "path", "left_anti")
    placements = m.dropDuplicates(["placement_id"]).select("placement_id", "session_id", "document_id", "message_id", F.col("seq").alias("ordinal"), "is_sidechain", "span_start", "span_end", F.col("timestamp").alias("ts_raw"))
    order = F.struct("seq", "placement_id")
    parent = F.when(F.min(F.coalesce("parent_native_id", F.lit(""))) == F.max(F.coalesce("parent_native_id", F.lit(""))), F.nullif(F.min(F.coalesce("parent_native_id", F.lit(""))), F.lit("")))
    messages = m.groupBy("message_id").agg(
        F.min_by("role", order).alias("role"), F.max_by("text", F.struct(F.length("text"), "placement_id")).alias("text"), F.min_by("timestamp", order).alias("timestamp"), parent.alias("parent_native_id"),
        F.when(F.min("is_sidechain") == F.max("is_sidechain"), F.min("is_sidechain")).alias("is_sidechain"), F.sort_array(F.collect_set("session_id")).alias("sessions"),
    )
    messages = messages.withColumn("session_id", F.when(F.size("sessions") == 1, F.get("sessions", F.lit(0))))
    edges = m.where(ids.native_ok(F.col("parent_native_id"))).select(F.col("placement_id").alias("child_placement_id"), F.concat(F.lit(ids.PREFIXES["message"]), "parent_native_id").alias("parent_message_id"), "parent_native_id", F.when(F.col("is_sidechain"), "subagent").otherwise("reply").alias("relation")).dropDuplicates(["child_placement_id"])
    # facts hang on the first message with the anchor's native id
    anchor = m.where(ids.native_ok(F.col("native_id"))).groupBy("document_id", F.col("native_id").alias("anchor")).agg(F.min_by(F.struct("message_id", "session_id", "seq"), order).alias("at"))
    activities = ok.where("event = 'activity'").join(anchor, ["document_id", "anchor"]).select(F.col("at.message_id").alias("message_id"), F.col("at.session_id").alias("session_id"), F.col("at.seq").alias("ordinal"), "kind", "actor", "name", "target", "status")
    one = m.groupBy("document_id").agg(F.count_distinct("session_id").alias("n"), F.min("session_id").alias("only_session"))
    u = ok.where("event = 'usage'").join(anchor, ["document_id", "anchor"], "left").join(one, "document_id", "left")
    usage = u.where(F.col("at").isNotNull() | (F.col("anchor").isNull() & (F.col("n") == 1))).select(F.coalesce("at.session_id", "only_session").alias("session_id"), F.col("at.message_id").alias("message_id"), "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "token_source")
    claims = resume_claims(m.select("session_id", "provider_id", F.col("session_native").alias("native"), F.coalesce("rep_cwd", "cwd").alias("cwd")))
    documents = ok.select("document_id", "provider_id", "variant_id", "fingerprint", "len").dropDuplicates(["document_id"])
    sessions = m.groupBy("session_id").agg(F.min("provider_id").alias("provider_id"), F.min("session_native").alias("native_id"), F.min("rep_cwd").alias("cwd"))
    return Tables(sessions, documents, messages, placements, edges, activities, usage, claims, bad)


def resume_claims(facts: DataFrame) -> DataFrame:
    """Each session's provider id and folder as missing, resolved or ambiguous; ``pair_observed``: both came together."""

    def state(c: str):
        n = F.count_distinct(F.col(c))
        return F.when(n == 0, "missing").when(n == 1, "resolved").otherwise("ambiguous")

    return facts.groupBy("session_id").agg(
        F.min("provider_id").alias("provider_id"), state("native").alias("id_state"), F.when(F.count_distinct("native") == 1, F.min("native")).alias("provider_session_id"),
        state("cwd").alias("cwd_state"), F.when(F.count_distinct("cwd") == 1, F.min("cwd")).alias("cwd"), F.bool_or(F.col("native").isNotNull() & F.col("cwd").isNotNull()).alias("pair_observed"),
    )


def merge_messages(parts: list[DataFrame]) -> DataFrame:
    """One message of several sources: the longer text stays, sessions are united."""
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return d.groupBy("message_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"), F.min("role").alias("role"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sessions")))).alias("sessions"))


def payload(messages: DataFrame, placements: DataFrame) -> DataFrame:
    """(message_id, payload): the JSON a message is shown as, with its spans in document order."""
    spans = placements.where(F.col("span_start").isNotNull()).groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "placement_id", F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end")).alias("s")))), lambda x: x["s"]).alias("spans"))
    j = messages.join(spans, "message_id", "left")
    return j.select("message_id", F.to_json(F.struct("role", "text", "timestamp", "parent_native_id", "is_sidechain", F.col("session_id").alias("session"), "sessions", F.get("spans", F.lit(0)).alias("span"), "spans")).alias("payload"))
