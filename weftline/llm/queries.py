"""Queries of the problems on conversation texts (3, 7, 8, 9, 10), with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import conversations, mixing, packing, pii, reading
from weftline.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "chat_rows")).select("session_id", "turn_no", "msg_uuid")


def p3_clocks(spark: SparkSession, d: str) -> DataFrame:
    """The clock model alone: sessions with broken reply-before constraints, their offsets and verdicts."""
    out = conversations.clock_offsets(conversations.messages(table(spark, d, "chat_rows")))
    return out.select("session_id", "feasible")


def p3_skewed(spark: SparkSession, d: str) -> DataFrame:
    """The clock model under planted clock errors: assistants' and tools' clocks are moved by up to some minutes in
    either direction, and in a fifth of the sessions by an amount that changes within the conversation."""
    rows = table(spark, d, "chat_rows").where("session_id IS NOT NULL AND msg_uuid IS NOT NULL")
    role, mark = conversations.role_of(F.col("msg_role")), F.ascii(F.right("session_id", F.lit(1)))
    wanders = (mark % 5 == 0) & (F.ascii(F.right("msg_uuid", F.lit(1))) % 2 == 0)
    late = F.when(role == "assistant", mark % 7 * 40 - 120).when(role == "tool", mark % 3 * 90 - 60).otherwise(0) + F.when(wanders, -400).otherwise(0)
    rows = rows.withColumn("sent_at", F.timestamp_micros(F.unix_micros(F.col("sent_at").cast("timestamp")) - late.cast("bigint") * 1_000_000))
    return conversations.clock_offsets(conversations.messages(rows)).select("session_id", "feasible")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "message_rows"))


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "message_rows"))


def p8_assignments(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_plans"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    plans = table(spark, d, "pack_plans")
    return packing.report(packing.pack(table(spark, d, "documents"), plans), plans)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding(table(spark, d, "documents"), table(spark, d, "graded_samples"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "graded_samples")).select("doc_id", "reading_level", "n_units")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source by level."""
    docs = table(spark, d, "documents")
    lev = reading.levels(docs, table(spark, d, "graded_samples")).select("doc_id", "reading_level", "n_units")
    return lev.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_units").alias("n_units"))


QUERIES = {f.__name__: f for f in (p3_found, p3_clocks, p3_skewed, p7_found, p7_redacted, p8_assignments, p8_report, p9_mix, p9_shares, p10_found, p10_levels, p10_profile)}

_ROLE_SQL = "CASE regexp_replace(lower(msg_role), '[^a-z]', '', 'g') " + " ".join(f"WHEN '{n}' THEN '{role}'" for role, names in conversations.ROLES.items() for n in names) + " END"

_GAP_SQL = """m AS (SELECT *, row_number() OVER (PARTITION BY session_id, msg_uuid ORDER BY sent_at NULLS LAST, row_id) AS rn FROM r),
o AS (SELECT * FROM m WHERE rn = 1),
e AS (SELECT c.session_id, c.role AS a, p.role AS b, min(c.us - p.us) AS w FROM o c JOIN o p ON c.session_id = p.session_id AND c.parent_uuid = p.msg_uuid
 WHERE c.role IS NOT NULL AND p.role IS NOT NULL AND c.us IS NOT NULL AND p.us IS NOT NULL GROUP BY ALL),
w1 AS (SELECT * FROM e),
""" + ",\n".join(f"w{k} AS (SELECT x.session_id, x.a, e.b, min(x.w + e.w) AS w FROM w{k - 1} x JOIN e ON x.session_id = e.session_id AND x.b = e.a GROUP BY ALL)" for k in range(2, 6)) + """
SELECT session_id, session_id NOT IN (SELECT session_id FROM (""" + " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(1, 6)) + """) WHERE a = b AND w < 0) AS feasible FROM (SELECT DISTINCT session_id FROM e WHERE w < 0)"""

ORACLES: dict[str, str] = {
    "p3_clocks": f"WITH r AS (SELECT *, {_ROLE_SQL} AS role, epoch_us(sent_at) AS us FROM chat_rows WHERE session_id IS NOT NULL AND msg_uuid IS NOT NULL), {_GAP_SQL}",
    "p3_skewed": f"""WITH r0 AS (SELECT *, {_ROLE_SQL} AS role, ascii(right(session_id, 1)) AS mark FROM chat_rows WHERE session_id IS NOT NULL AND msg_uuid IS NOT NULL),
r AS (SELECT *, epoch_us(sent_at) - 1000000 * (CASE role WHEN 'assistant' THEN mark % 7 * 40 - 120 WHEN 'tool' THEN mark % 3 * 90 - 60 ELSE 0 END + CASE WHEN mark % 5 = 0 AND ascii(right(msg_uuid, 1)) % 2 = 0 THEN -400 ELSE 0 END)::BIGINT AS us FROM r0), {_GAP_SQL}""",
    "p3_found": f"""WITH m AS (
 SELECT *, {_ROLE_SQL} AS role, row_number() OVER (PARTITION BY session_id, msg_uuid ORDER BY sent_at NULLS LAST, row_id) AS rn FROM chat_rows WHERE session_id IS NOT NULL AND msg_uuid IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sent_at, msg_uuid) AS turn_no FROM m WHERE rn = 1),
s AS (SELECT session_id, turn_no, lead(role) OVER w AS nrole, lead(turn_no) OVER w AS nturn FROM o WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY turn_no)),
bad AS (
 SELECT session_id FROM o WHERE sent_at IS NULL OR role IS NULL OR (role IN ('user', 'assistant') AND length(regexp_replace(coalesce(msg_content, ''), '[\\s\\p{{Z}}\\p{{C}}]', '', 'g')) = 0)
 UNION SELECT o.session_id FROM o LEFT JOIN o p ON o.session_id = p.session_id AND o.parent_uuid = p.msg_uuid WHERE o.parent_uuid IS NOT NULL AND p.msg_uuid IS NULL
 UNION SELECT o.session_id FROM o LEFT JOIN s USING (session_id, turn_no) WHERE o.role = 'user' AND (s.nrole IS NULL OR (s.nrole = 'user' AND s.nturn <> o.turn_no + 1)))
SELECT session_id, turn_no, msg_uuid FROM o WHERE session_id NOT IN (SELECT session_id FROM bad) AND session_id IN (SELECT session_id FROM o WHERE role = 'user')""",
}
