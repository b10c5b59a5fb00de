"""Graph, aggregate, look-up, reconciliation, streaming and function queries over the driver's tables, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import ids, instant, tools
from weftline.functions import text as tx
from weftline.operators import aggregates, canonical, flatten, graph, handoff, lookups, maintenance, paging, reconcile
from weftline.plans.search import M_SQL, messages
from weftline.session import scratch, table
from weftline.streaming import streams

_ORD = "l_orderkey"


def session_of_min(spark: SparkSession, d: str) -> DataFrame:
    return lookups.least_of(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "session")


def first_placement(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return lookups.first_placement(p, "l_partkey", "l_suppkey")


def get_many_ordered(spark: SparkSession, d: str) -> DataFrame:
    return lookups.get_many(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [5, 3, 5, -1, 7, 1], "o_orderkey")


def message_contexts(spark: SparkSession, d: str) -> DataFrame:
    c = lookups.contexts(table(spark, d, "message_rows").where("msg_uuid IS NOT NULL AND session_id IS NOT NULL"), "msg_uuid", "session_id", "row_id")
    return c.select("msg_uuid", "session_id", F.array_join(F.transform("placements", lambda x: x.cast("string")), ",").alias("placements"))


def integrity_both_ways(spark: SparkSession, d: str) -> DataFrame:
    return lookups.both_ways(table(spark, d, "message_rows").select("session_id"), table(spark, d, "chat_rows").select("session_id"), "session_id").where("session_id IS NOT NULL")


def talks(spark: SparkSession, d: str) -> DataFrame:
    return graph.talks(messages(spark, d), "id").select("session_id", "talk_no", "id")


def message_window(spark: SparkSession, d: str) -> DataFrame:
    """Three messages either side of the message in the middle of each session."""
    from pyspark.sql.window import Window

    m = messages(spark, d).where("ts IS NOT NULL")
    line = m.select("session_id", "id", (F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "id")) - 1).alias("position"))
    mid = line.groupBy("session_id").agg(F.floor(F.max("position") / 2).cast("int").alias("position"))
    return graph.window_around(line, mid, 3)


def grown_window(spark: SparkSession, d: str) -> DataFrame:
    """Window around the message in the middle of each session within 7 items and 600 characters."""
    from pyspark.sql.window import Window

    m = messages(spark, d).where("ts IS NOT NULL")
    line = m.select("session_id", "id", "text", (F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "id")) - 1).alias("position"))
    mid = line.groupBy("session_id").agg(F.floor(F.max("position") / 2).cast("int").alias("position"))
    return graph.grown_window(line, mid, F.length("text").cast("bigint"), 7, 600).select("session_id", "id", "position")


def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.session_summary(messages(spark, d).withColumn("ordinal", F.col("id")))


def session_peek(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.session_peek(messages(spark, d).withColumn("ordinal", F.col("id")))


def session_title(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "message_rows").where("session_id IS NOT NULL AND msg_content IS NOT NULL").select("session_id", F.lower("msg_role").alias("role"), F.col("msg_content").alias("text"), F.col("row_id").alias("id"), F.col("row_id").alias("ordinal"))
    return aggregates.session_title(table(spark, d, "session_catalog").select("session_id", "title"), m)


def latest_activity(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.latest_activity(messages(spark, d).where("ts IS NOT NULL"))


def repo_totals(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.repo_totals(table(spark, d, "session_catalog"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.doctor({n: table(spark, d, n) for n in ("message_rows", "chat_rows", "session_catalog", "documents")})


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Token usage of the transcripts; negative or broken counts drop the event."""
    t = table(spark, d, "raw_transcripts").select(F.btrim("raw_json", F.lit(flatten.MARGIN)).alias("j"))
    t = t.where(F.try_parse_json("j").isNotNull() & F.get_json_object("j", "$.message.usage").isNotNull())
    n = {b: F.coalesce(F.get_json_object("j", f"$.message.usage.{k}"), F.lit("0")).try_cast("bigint") for b, k in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_read_tokens", "cache_read_input_tokens"), ("cache_write_tokens", "cache_creation_input_tokens"))}
    u = t.select(F.get_json_object("j", "$.sessionId").alias("session_id"), *[c.alias(b) for b, c in n.items()], F.lit(0).cast("bigint").alias("reasoning_tokens"), F.lit("observed").alias("token_source"))
    return aggregates.usage_totals(u.where(" AND ".join(f"{b} >= 0" for b in n)))


def tool_activities(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls by name and kind, from the blocks of the transcripts."""
    b = flatten.blocks(table(spark, d, "raw_transcripts"), fields=("type", "name")).where("block_type = 'tool_use' AND block_name IS NOT NULL")
    return b.groupBy("block_name", tools.tool_kind(F.col("block_name")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _chat_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = messages(spark, d).where("msg_uuid IS NOT NULL").groupBy("session_id", "msg_uuid").agg(F.min_by(F.struct("parent_uuid", "ts", "id"), "id").alias("x"))
    m = m.select("session_id", F.col("msg_uuid").alias("message_id"), F.concat_ws("/", "session_id", "msg_uuid").alias("placement_id"), F.lit("doc").alias("document_id"), F.col("x.id").alias("ordinal"), F.lit(False).alias("is_sidechain"), F.date_format("x.ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts_raw"), F.col("x.parent_uuid").alias("parent"))
    return m.drop("parent"), m.where("parent IS NOT NULL").select(F.col("placement_id").alias("child_placement_id"), F.col("parent").alias("parent_message_id"))


def mainline_walk(spark: SparkSession, d: str) -> DataFrame:
    """Main branch of every chat session, root first."""
    return graph.mainline(*_chat_graph(spark, d)).select("session_id", "position", "message_id")


def graph_violations(spark: SparkSession, d: str) -> DataFrame:
    """Chat rows held against a graph whose sessions are the catalogue's: rule and number of breaches."""
    p, e = _chat_graph(spark, d)
    m = p.select("message_id").distinct()
    v = graph.violations(table(spark, d, "session_catalog").select("session_id"), m, spark.range(1).select(F.lit("doc").alias("document_id")), p, e)
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _claims(spark: SparkSession, d: str, col: str) -> DataFrame:
    return table(spark, d, "documents").where(f"source IS NOT NULL AND {col}").select(F.col("source").alias("path"), F.sha2("text", 256).alias("message_id")).distinct()


def tombstone_diff(spark: SparkSession, d: str) -> DataFrame:
    """Texts withdrawn when every source loses the documents whose id ends in 7; only complete sources withdraw."""
    old, new = _claims(spark, d, "true"), _claims(spark, d, "doc_id % 10 <> 7")
    scanned = old.select("path").distinct().withColumn("complete", F.col("path") != "prompt")
    return reconcile.tombstones(old, new.join(scanned.where("complete").select("path"), "path", "left_semi").unionByName(old.where("path = 'prompt'")), scanned)


def unchanged_detection(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sources against a former state: some changed, some new, some of an older parser, some empty."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    snap = t.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("fingerprint"), F.when(F.col("doc_id") % 11 == 0, 0).otherwise(F.octet_length("text")).alias("len"))
    state = t.where("doc_id % 5 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.sha2("text", 256)).alias("fingerprint"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("parser_version"))
    return reconcile.classify(snap, state).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def matched_sessions(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where(F.lower("text").contains("limit")).select("session_id", F.col("id").alias("rank"), F.length("text").alias("score"))
    return aggregates.matched_sessions(m)


def orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chat_rows").select(F.col("parent_uuid").alias("message_id"))
    ln = table(spark, d, "message_links").select(F.lower("parent_uuid").alias("message_id"))
    return aggregates.orphan_counts({"chat_parents": c, "link_parents": ln}, table(spark, d, "chat_rows").select(F.col("msg_uuid").alias("message_id")))


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.percentiles(table(spark, d, "events"), "value", ["event_type"])


def activity_targets(spark: SparkSession, d: str) -> DataFrame:
    """Folders of each repository's sessions, in order of first use."""
    a = table(spark, d, "session_catalog").where("repo_slug IS NOT NULL").select(F.col("repo_slug").alias("session_id"), F.lit("file").alias("kind"), F.lit("success").alias("status"), F.col("cwd").alias("target"), F.struct("started_at", "session_id").alias("ordinal"))
    return aggregates.activity_targets(a, "file").select("session_id", F.array_join("targets", ",").alias("targets"))


def instant_parse(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "message_rows").where("timestamp_raw IS NOT NULL")
    p = instant.lenient(F.col("timestamp_raw"))
    s = instant.strict(F.col("timestamp_raw"))
    return t.select("row_id", p["seconds"].alias("seconds"), p["nanos"].alias("nanos"), s["seconds"].alias("strict_seconds"))


def timestamp_order(spark: SparkSession, d: str) -> DataFrame:
    """Latest message of each session under the order missing < invalid < valid."""
    t = table(spark, d, "message_rows").where("session_id IS NOT NULL")
    return t.groupBy("session_id").agg(F.max_by("row_id", F.struct(instant.order_key(F.col("timestamp_raw")).alias("k"), "row_id")).alias("row_id"))


def url_slug(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "session_catalog").where("repo_slug IS NOT NULL")
    n = F.pmod(F.length("session_id") + F.ascii(F.substring("session_id", -1, 1)), F.lit(5))
    url = F.when(n == 0, F.concat(F.lit("git@code.example:"), "repo_slug", F.lit(".git"))).when(n == 1, F.concat(F.lit("https://code.example/"), "repo_slug", F.lit("/"))).when(n == 2, F.concat(F.lit("ssh://git@code.example/"), "repo_slug")).when(n == 3, F.concat(F.lit("https://code.example:8080/"), "repo_slug")).otherwise(F.concat(F.lit("https://code.example/a/"), "repo_slug"))
    return s.select("session_id", tools.repo_slug(url).alias("slug"))


def relocation_preview(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.relocation_preview(table(spark, d, "session_catalog"), "/home/dev01", "/srv/./moved/../dev01/")


def resume_commands(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "session_catalog")
    r = handoff.resume_command(F.col("provider_id"), F.col("session_id"), F.lit("resolved"), F.col("cwd"))
    return s.select("session_id", r["available"].alias("available"), r["command"].alias("command"))


def resume_claims(spark: SparkSession, d: str) -> DataFrame:
    """Installations as sessions: which of their facts are missing, resolved or ambiguous."""
    s = table(spark, d, "session_catalog")
    return canonical.resume_claims(s.select(F.col("install_id").alias("session_id"), "provider_id", F.col("repo_slug").alias("native"), "cwd")).select("session_id", "id_state", "cwd_state", "pair_observed")


def provider_matrix(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.provider_matrix(spark).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def hit_costs(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    c = paging.hit_cost(F.col("msg_uuid"), F.col("session_id"), F.col("text"), F.array(F.lit("limit")), F.array().cast("array<string>"), F.lit(12))
    return m.where("msg_uuid IS NOT NULL").select("id", c.cast("bigint").alias("cost"))


def derived_ids(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "session_catalog")
    return s.select("session_id", ids.derive("session", F.col("provider_id"), F.col("session_id")).alias("wire"), ids.wire_kind(F.col("session_id")).alias("kind"))


def union_of_placements(spark: SparkSession, d: str) -> DataFrame:
    """Session-message placements of both message tables, each once."""
    a, b = (table(spark, d, t).where("session_id IS NOT NULL AND msg_uuid IS NOT NULL").select("session_id", F.lower("msg_uuid").alias("msg_uuid")) for t in ("message_links", "chat_rows"))
    return a.unionByName(b).dropDuplicates()


def encoded_tokens(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "session_catalog")
    return s.select("session_id", tx.digest16(F.col("session_id")).alias("digest"), tx.base64url(F.encode("session_id", "UTF-8")).alias("token"), F.decode(tx.from_base64url(tx.base64url(F.encode("session_id", "UTF-8"))), "UTF-8").alias("back"), tx.shell_quote(F.col("title")).alias("quoted"))


def activity_cube(spark: SparkSession, d: str) -> DataFrame:
    """Messages by role and provider with all subtotals."""
    m = table(spark, d, "message_rows").where("session_id IS NOT NULL").select("session_id", F.lower("record_type").alias("record_type"))
    s = table(spark, d, "session_catalog").select("session_id", "provider_id")
    return m.join(s, "session_id").cube("record_type", "provider_id").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("g"))


def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Star join over five tables; dimensions are small and left to the optimizer's size statistics."""
    li, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n_lines"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The table is a file or a folder of files: as a pattern its path may be either."""
    return streams.event_stream(spark, f"{d}/{{events.parquet}}", table(spark, d, "events").schema)


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = streams.run_once(streams.tumbling(_stream(spark, d), "1 hour", ["event_type"]), f"tumbling_{abs(hash(d))}", "complete", scratch(spark))
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = streams.run_once(streams.sliding(_stream(spark, d), "2 hours", "1 hour", ["event_type"]), f"sliding_{abs(hash(d))}", "complete", scratch(spark))
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = streams.sessions(_stream(spark, d), "30 minutes", "user_id").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
    return streams.run_once(out, f"sessions_{abs(hash(d))}", "complete", scratch(spark))


QUERIES = {
    f.__name__: f
    for f in (
        session_of_min, first_placement, get_many_ordered, message_contexts, integrity_both_ways, talks, message_window, grown_window, session_summary, session_peek, session_title, latest_activity, repo_totals, status_counts,
        usage_totals, tool_activities, mainline_walk, graph_violations, tombstone_diff, unchanged_detection, matched_sessions, orphan_counts, percentiles,
        activity_targets, instant_parse, timestamp_order, url_slug, relocation_preview, resume_commands, resume_claims, provider_matrix, hit_costs, derived_ids, union_of_placements, encoded_tokens, activity_cube,
        revenue_by_nation, stream_tumbling, stream_sliding, stream_sessions,
    )
}

_LINE = f"WITH {M_SQL}, l AS (SELECT session_id, id, text, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) - 1 AS position FROM m WHERE ts IS NOT NULL)"
_GRAPH = f"""{M_SQL}, g AS (SELECT session_id, msg_uuid, parent_uuid, ts, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, msg_uuid ORDER BY id) AS rn FROM m WHERE msg_uuid IS NOT NULL) WHERE rn = 1),
leaf AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g k WHERE k.session_id = g.session_id AND k.parent_uuid = g.msg_uuid)),
best AS (SELECT session_id, msg_uuid FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY p DESC, ts IS NOT NULL DESC, ts DESC, id DESC) AS rn FROM (SELECT *, CASE WHEN parent_uuid IS NOT NULL THEN 2 ELSE 1 END AS p FROM leaf UNION ALL SELECT *, 0 FROM g)) WHERE rn = 1)"""
_TS = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(Z|z|[+-]\d{2}:?\d{2})?$"
_STRICT = r"^(\d{4})-?(\d{2})-?(\d{2})[Tt](\d{2}):?(\d{2}):?(\d{2})(?:\.(\d+))?(Z|z|[+-]\d{2}:?\d{2})$"


def _instant_sql(pattern: str) -> str:
    g = [f"regexp_extract(timestamp_raw, '{pattern}', {i})" for i in range(1, 9)]
    sign = f"CASE WHEN {g[7]} LIKE '-%' THEN -1 ELSE 1 END * (coalesce(try_cast(substring(regexp_replace({g[7]}, '[^0-9]', '', 'g'), 1, 2) AS INT), 0) * 3600 + coalesce(try_cast(substring(regexp_replace({g[7]}, '[^0-9]', '', 'g'), 3, 2) AS INT), 0) * 60)"
    return f"""CASE WHEN regexp_matches(timestamp_raw, '{pattern}') AND NOT contains(timestamp_raw, chr(10)) AND try_cast({g[3]} AS INT) <= 23 AND try_cast({g[4]} AS INT) <= 59 AND coalesce(try_cast({g[5]} AS INT), 0) <= 59
 THEN (try_cast({g[0]} || '-' || {g[1]} || '-' || {g[2]} AS DATE) - DATE '1970-01-01')::BIGINT * 86400 + try_cast({g[3]} AS INT) * 3600 + try_cast({g[4]} AS INT) * 60 + coalesce(try_cast({g[5]} AS INT), 0) - ({sign}) END"""


ORACLES = {
    "session_of_min": "SELECT l_partkey, min(l_suppkey) AS session FROM lineitem GROUP BY l_partkey",
    "first_placement": "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1",
    "get_many_ordered": "SELECT pos, w AS o_orderkey, o_orderkey IS NOT NULL AS found, o_custkey, o_totalprice FROM (VALUES (0, 5), (1, 3), (2, 5), (3, -1), (4, 7), (5, 1)) v(pos, w) LEFT JOIN orders ON o_orderkey = w",
    "message_contexts": "SELECT msg_uuid, session_id, string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS placements FROM message_rows WHERE msg_uuid IS NOT NULL AND session_id IS NOT NULL GROUP BY ALL",
    "integrity_both_ways": "SELECT coalesce(a.session_id, b.session_id) AS session_id, CASE WHEN b.session_id IS NULL THEN 'missing_right' ELSE 'missing_left' END AS side FROM (SELECT DISTINCT session_id FROM message_rows WHERE session_id IS NOT NULL) a FULL OUTER JOIN (SELECT DISTINCT session_id FROM chat_rows WHERE session_id IS NOT NULL) b ON a.session_id = b.session_id WHERE a.session_id IS NULL OR b.session_id IS NULL",
    "talks": f"WITH {M_SQL} SELECT session_id, talk_no, id FROM (SELECT session_id, id, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY id ROWS UNBOUNDED PRECEDING)::BIGINT AS talk_no FROM m WHERE role IN ('user', 'assistant', 'tool')) WHERE talk_no > 0",
    "message_window": f"{_LINE} SELECT session_id, id, position FROM l JOIN (SELECT session_id, max(position) // 2 AS a FROM l GROUP BY session_id) USING (session_id) WHERE abs(position - a) <= 3",
    "grown_window": f"{_LINE}, a AS (SELECT l.*, l.position - x.a AS k FROM l JOIN (SELECT session_id, max(position) // 2 AS a FROM l GROUP BY session_id) x USING (session_id)) SELECT session_id, id, position FROM (SELECT *, row_number() OVER w AS i, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM a WINDOW w AS (PARTITION BY session_id ORDER BY abs(k), k > 0)) WHERE i <= 7 AND s <= 600",
    "session_summary": f"WITH {M_SQL} SELECT session_id, arg_min(text, id) FILTER (WHERE role = 'user') AS first_request, count(*) AS message_count, count(*) FILTER (WHERE role = 'user') AS turn_count FROM m GROUP BY session_id",
    "session_peek": f"WITH {M_SQL} SELECT session_id, left(trim(arg_min(text, id), ' '), 200) AS first, left(trim(arg_max(text, id), ' '), 200) AS last FROM m WHERE role = 'user' AND trim(text, ' ') <> '' GROUP BY session_id",
    "session_title": """SELECT c.session_id, left(coalesce(nullif(trim(title, ' '), ''), trim(t, ' ')), 80) AS title FROM session_catalog c LEFT JOIN (
 SELECT session_id, arg_min(msg_content, row_id) AS t FROM message_rows WHERE session_id IS NOT NULL AND lower(msg_role) = 'user' AND trim(msg_content, ' ') <> '' GROUP BY session_id) USING (session_id)""",
    "latest_activity": f"WITH {M_SQL} SELECT session_id, strftime(max(ts), '%Y-%m-%d') AS latest FROM m WHERE ts IS NOT NULL GROUP BY session_id",
    "repo_totals": "SELECT repo_slug, count(DISTINCT session_id) AS sessions FROM session_catalog WHERE repo_slug IS NOT NULL GROUP BY repo_slug",
    "status_counts": " UNION ALL ".join(f"SELECT 'rows:{t}' AS item, count(*) AS n FROM {t}" for t in ("message_rows", "chat_rows", "session_catalog", "documents")),
    "usage_totals": """WITH v AS (SELECT CASE WHEN json_valid(trim(raw_json, chr(65279) || ' ' || chr(13))) THEN trim(raw_json, chr(65279) || ' ' || chr(13))::JSON END AS j FROM raw_transcripts),
u AS (SELECT j->>'sessionId' AS session_id, j->'message'->'usage' AS u FROM v WHERE json_type(j->'message'->'usage') = 'OBJECT'),
n AS (SELECT session_id, coalesce(u->>'input_tokens', '0')::BIGINT AS a, coalesce(u->>'output_tokens', '0')::BIGINT AS b, coalesce(u->>'cache_read_input_tokens', '0')::BIGINT AS c, coalesce(u->>'cache_creation_input_tokens', '0')::BIGINT AS d FROM u)
SELECT count(DISTINCT session_id) AS sessions, sum(a)::BIGINT AS input_tokens, sum(b)::BIGINT AS output_tokens, sum(c)::BIGINT AS cache_read_tokens, sum(d)::BIGINT AS cache_write_tokens, 0::BIGINT AS reasoning_tokens, count(*) AS observed, 0::BIGINT AS derived FROM n""",
    "mainline_walk": f"""WITH RECURSIVE {_GRAPH}, w AS (SELECT g.session_id, g.msg_uuid, g.parent_uuid, 0 AS up, [g.msg_uuid] AS seen FROM g JOIN best USING (session_id, msg_uuid)
 UNION ALL SELECT g.session_id, g.msg_uuid, g.parent_uuid, up + 1, list_append(seen, g.msg_uuid) FROM w JOIN g ON g.session_id = w.session_id AND g.msg_uuid = w.parent_uuid WHERE NOT list_contains(seen, g.msg_uuid))
SELECT session_id, max(up) OVER (PARTITION BY session_id) - up AS position, msg_uuid AS message_id FROM w""",
    "graph_violations": f"WITH {_GRAPH} SELECT 'placement_session_unknown' AS rule, count(*) AS n FROM g WHERE session_id NOT IN (SELECT session_id FROM session_catalog) HAVING count(*) > 0",
    "tombstone_diff": """WITH o AS (SELECT DISTINCT source AS path, sha256(text) AS h FROM documents WHERE source IS NOT NULL), n AS (SELECT DISTINCT source AS path, sha256(text) AS h FROM documents WHERE source IS NOT NULL AND (doc_id % 10 <> 7 OR source = 'prompt'))
SELECT DISTINCT h AS message_id FROM o WHERE h NOT IN (SELECT h FROM n)""",
    "unchanged_detection": """SELECT CASE WHEN doc_id % 11 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'skip' ELSE 'withdraw' END WHEN length(text) = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'skip' ELSE 'withdraw' END WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'parse' WHEN doc_id % 3 = 0 THEN 'reparse' ELSE 'unchanged' END AS action, count(*) AS n
FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "matched_sessions": f"WITH {M_SQL} SELECT session_id, count(*) AS occurrences, min(id) AS first_rank, arg_min(length(text), id) AS first_score FROM m WHERE contains(lower(text), 'limit') GROUP BY session_id",
    "orphan_counts": """SELECT 'chat_parents' AS facts, count(*) AS orphans FROM chat_rows WHERE parent_uuid IS NOT NULL AND parent_uuid NOT IN (SELECT msg_uuid FROM chat_rows)
UNION ALL SELECT 'link_parents', count(*) FROM message_links WHERE parent_uuid IS NOT NULL AND lower(parent_uuid) NOT IN (SELECT msg_uuid FROM chat_rows)""",
    "percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type",
    "activity_targets": "SELECT repo_slug AS session_id, string_agg(cwd, ',' ORDER BY o, s) AS targets FROM (SELECT repo_slug, cwd, min(started_at) AS o, arg_min(session_id, (started_at, session_id)) AS s FROM session_catalog WHERE repo_slug IS NOT NULL AND cwd IS NOT NULL GROUP BY ALL) GROUP BY repo_slug",
    "instant_parse": f"""SELECT row_id, seconds, CASE WHEN seconds IS NOT NULL THEN coalesce(try_cast(rpad(left(regexp_extract(timestamp_raw, '{_TS}', 7), 9), 9, '0') AS INT), 0) END AS nanos, strict_seconds FROM (
 SELECT row_id, timestamp_raw, {_instant_sql(_TS)} AS seconds, {_instant_sql(_STRICT)} AS strict_seconds FROM message_rows WHERE timestamp_raw IS NOT NULL)""",
    "timestamp_order": f"""SELECT session_id, row_id FROM (SELECT session_id, row_id, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN timestamp_raw IS NULL THEN 0 WHEN s IS NULL THEN 1 ELSE 2 END DESC, CASE WHEN s IS NULL THEN encode(timestamp_raw) END DESC, s DESC, f DESC, row_id DESC) AS rn
 FROM (SELECT *, {_instant_sql(_TS)} AS s, coalesce(try_cast(rpad(left(regexp_extract(timestamp_raw, '{_TS}', 7), 9), 9, '0') AS INT), 0) AS f FROM message_rows WHERE session_id IS NOT NULL)) WHERE rn = 1""",
    "url_slug": "SELECT session_id, CASE WHEN (length(session_id) + ascii(right(session_id, 1))) % 5 <= 2 THEN 'code.example/' || repo_slug END AS slug FROM session_catalog WHERE repo_slug IS NOT NULL",
    "relocation_preview": "SELECT session_id, cwd, '/srv/dev01' || substring(cwd, 12) AS moved FROM session_catalog WHERE cwd = '/home/dev01' OR cwd LIKE '/home/dev01/%'",
    "resume_commands": """SELECT session_id, c IS NOT NULL AS available, c AS command FROM (SELECT session_id, CASE provider_id WHEN 'claude-code' THEN 'claude --resume ' || session_id WHEN 'codex' THEN 'codex resume ' || session_id WHEN 'pi' THEN 'pi --session ' || session_id
 WHEN 'opencode' THEN 'opencode ' || coalesce(cwd || ' ', '') || '--session ' || session_id END AS c FROM session_catalog)""",
    "resume_claims": """SELECT install_id AS session_id, CASE count(DISTINCT repo_slug) WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS id_state, CASE count(DISTINCT cwd) WHEN 0 THEN 'missing' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS cwd_state,
 bool_or(repo_slug IS NOT NULL AND cwd IS NOT NULL) AS pair_observed FROM session_catalog GROUP BY install_id""",
    "hit_costs": r"""WITH t AS (SELECT row_id AS id, session_id, msg_uuid, msg_content AS c FROM chat_rows WHERE session_id IS NOT NULL AND msg_content IS NOT NULL AND msg_uuid IS NOT NULL)
SELECT id, (length(msg_uuid) + 16 + length(session_id) + 10 + 2 + octet_length(encode(c)) + length(regexp_replace(c, '[^"\\]', '', 'g')) + 5 * length(regexp_replace(c, '[^\x00-\x1f\x7f]', '', 'g')) + 7 + 1 + 15 + 16 + 56)::BIGINT AS cost FROM t""",
    "derived_ids": "SELECT session_id, 'ses_v1_' || left(sha256('ses_v1_' || lpad(length(provider_id)::VARCHAR, 20, '0') || provider_id || lpad(length(session_id)::VARCHAR, 20, '0') || session_id), 32) AS wire, 'session' AS kind FROM session_catalog",
    "union_of_placements": "SELECT session_id, lower(msg_uuid) AS msg_uuid FROM message_links WHERE session_id IS NOT NULL AND msg_uuid IS NOT NULL UNION SELECT session_id, lower(msg_uuid) FROM chat_rows WHERE session_id IS NOT NULL AND msg_uuid IS NOT NULL",
    "encoded_tokens": """SELECT session_id, left(sha256(session_id), 16) AS digest, rtrim(translate(to_base64(encode(session_id)), '+/', '-_'), '=') AS token, session_id AS back,
 CASE WHEN regexp_full_match(title, '[A-Za-z0-9_@%+=:,./-]+') THEN title ELSE '''' || replace(title, '''', '''\\''''') || '''' END AS quoted FROM session_catalog""",
    "activity_cube": "SELECT lower(record_type) AS record_type, provider_id, count(*) AS n, grouping(lower(record_type), provider_id) AS g FROM message_rows JOIN session_catalog USING (session_id) GROUP BY CUBE (lower(record_type), provider_id)",
    "revenue_by_nation": """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "stream_tumbling": "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": "SELECT start_us, event_type, count(*) AS n FROM (SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type FROM events UNION ALL SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour'), event_type FROM events) GROUP BY ALL",
    "stream_sessions": """WITH s AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER w >= INTERVAL '30 minutes')::INT, 1) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL '30 minutes') AS end_us, count(*) AS n FROM g GROUP BY user_id, k""",
}
