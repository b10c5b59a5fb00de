"""Adapter, canonical-table and graph queries over the transcript and link tables, with the SQL that gives the same rows.

The lines of each ``source_path`` are put together again as the file they come from and go through the same ingest as
files do: probe, health, adapter, canonical tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import ids
from weftline.functions.tools import TOOL_KINDS
from weftline.operators import aggregates, canonical, filters, graph, reconcile, semantic
from weftline.plans import problems
from weftline.session import cut, table
from weftline.sources import ingest


def _files(lines: DataFrame, path: str, order: list[str], text: str) -> DataFrame:
    """(path, len, fingerprint, content): the sources whose lines are rows of a table."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_t")))), lambda x: x["_t"]), "\n")
    d = lines.groupBy(path).agg(body.alias("b"))
    return d.select(F.concat(F.col(path).cast("string"), F.when(F.col(path).cast("string").endswith(".jsonl"), "").otherwise(".jsonl")).alias("path"), F.octet_length("b").cast("bigint").alias("len"), F.sha2("b", 256).alias("fingerprint"), F.encode("b", "UTF-8").alias("content"))


def claude_events(spark: SparkSession, d: str) -> DataFrame:
    return ingest.parse(_files(table(spark, d, "raw_transcripts"), "source_path", ["line_no", "line_id"], "raw_json"))


def claude_messages(spark: SparkSession, d: str) -> DataFrame:
    return claude_events(spark, d).where("event = 'message'").select("path", F.col("seq").cast("bigint").alias("seq"), "native_id", "parent_native_id", "role", "is_sidechain", "timestamp")


def claude_texts(spark: SparkSession, d: str) -> DataFrame:
    """Flattened texts, as digests."""
    return claude_events(spark, d).where("event = 'message'").select("path", F.col("seq").cast("bigint").alias("seq"), F.md5("text").alias("digest"))


def claude_activities(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls with the result they are paired with."""
    a = claude_events(spark, d).where("event = 'activity'")
    return a.groupBy("path", "name", "kind", "status", "actor", "anchor").agg(F.count(F.lit(1)).alias("n"))


def claude_usage(spark: SparkSession, d: str) -> DataFrame:
    u = claude_events(spark, d).where("event = 'usage'")
    return u.select("path", "anchor", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "token_source")


def claude_reports(spark: SparkSession, d: str) -> DataFrame:
    """Health, committed and skipped counts of each source."""
    return claude_events(spark, d).where("event = 'report'").select("path", "health", F.col("committed").cast("bigint").alias("committed"), F.col("skipped").cast("bigint").alias("skipped"), "error")


def sync_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of one run in which every third source is known and unchanged."""
    snap = _files(table(spark, d, "raw_transcripts"), "source_path", ["line_no", "line_id"], "raw_json")
    state = snap.where("len % 3 = 0").select("path", "fingerprint", F.lit(reconcile.PARSER_VERSION).alias("parser_version"))
    classified = reconcile.classify(snap, state)
    events = ingest.parse(classified.where("action = 'parse'"))
    return reconcile.report(classified.drop("content"), events)


def _tables(spark: SparkSession, d: str) -> canonical.Tables:
    return canonical.canonicalise(cut(claude_events(spark, d)))


def canonical_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with their placements and messages."""
    t = _tables(spark, d)
    n = t.placements.groupBy("session_id").agg(F.count(F.lit(1)).alias("placements"), F.count_distinct("message_id").alias("messages"))
    return t.sessions.select("session_id", "native_id").join(n, "session_id").drop("session_id")


def canonical_edges(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    return t.edges.groupBy("parent_message_id", "relation").agg(F.count(F.lit(1)).alias("n"))


def canonical_facts(spark: SparkSession, d: str) -> DataFrame:
    """Activities and usage at the message they hang on."""
    t = _tables(spark, d)
    a = t.activities.groupBy("message_id").agg(F.count(F.lit(1)).alias("activities"))
    u = t.usage.where("message_id IS NOT NULL").groupBy("message_id").agg(F.count(F.lit(1)).alias("usage_events"), F.sum("output_tokens").alias("output_tokens"))
    return a.join(u, "message_id", "full_outer").fillna(0, ["activities", "usage_events"])


def canonical_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Sources in which a message differs from itself: every 50th line comes again with another parent's text."""
    t = table(spark, d, "raw_transcripts")
    again = t.where("line_no % 50 = 0").withColumn("raw_json", F.regexp_replace("raw_json", '"role":"', '"role":"assistant","was":"')).withColumn("line_id", F.col("line_id") + (1 << 40))
    t = t.select("source_path", "line_no", "line_id", "raw_json").unionByName(again.select("source_path", "line_no", "line_id", "raw_json"))
    problems = canonical.canonicalise(cut(ingest.parse(_files(t, "source_path", ["line_no", "line_id"], "raw_json")))).problems
    return problems.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def usage_of_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the adapter's usage events."""
    return aggregates.usage_totals(_tables(spark, d).usage)


def facet_tool_kind(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    return filters.tool_facet(t.messages.select(F.col("message_id").alias("id")), t.activities.withColumnRenamed("message_id", "id"), "command")


def facet_tool_name(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    return filters.tool_facet(t.messages.select(F.col("message_id").alias("id")), t.activities.withColumnRenamed("message_id", "id"), None, "Read")


def usage_delta(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user as the token counts of a rollout file: totals to increments, through the adapter."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.floor("value").cast("bigint").alias("total"))
    info = F.struct(F.struct(F.col("total").alias("input_tokens")).alias("total_token_usage"))
    count = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload")))
    item = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.col("event_id").cast("string").alias("id"), F.array(F.struct(F.lit("text").alias("type"), F.lit("x").alias("text"))).alias("content")).alias("payload")))
    head = table(spark, d, "events").select("user_id").distinct().select("user_id", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("bigint").alias("event_id"), F.concat(F.lit('{"type":"session_meta","payload":{"id":"'), F.col("user_id").cast("string"), F.lit('"}}')).alias("line"))
    rows = e.select("user_id", "ts", "event_id", F.concat(item, F.lit("\n"), count).alias("line")).unionByName(head)
    got = ingest.parse(_files(rows, "user_id", ["ts", "event_id"], "line")).where("event = 'usage'")
    return got.select(F.col("anchor").cast("bigint").alias("event_id"), F.col("input_tokens").alias("increment"))


def _link_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Link rows as placements: repeated rows place a message more than once, relations are the documents."""
    ln = table(spark, d, "message_links").where("msg_uuid IS NOT NULL AND session_id IS NOT NULL")
    p = ln.select("session_id", F.col("link_id").cast("string").alias("placement_id"), F.lower("msg_uuid").alias("message_id"), F.coalesce("relation", F.lit("none")).alias("document_id"), F.col("link_id").alias("ordinal"), "is_sidechain", F.date_format("seen_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts_raw"))
    e = ln.where("trim(parent_uuid) <> ''").select(F.col("link_id").cast("string").alias("child_placement_id"), F.lower("parent_uuid").alias("parent_message_id"))
    return p, e


def branch_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves among the candidates: placements outside sidechains, or all where a session has nothing else."""
    return graph.leaves(*_link_graph(spark, d)).select("session_id", "placement_id", "message_id", "has_parent")


def parent_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The parent placement of every placement with a parent, or that it can't be told."""
    return graph.resolved_parents(*_link_graph(spark, d)).select("placement_id", "session_id", "parent_placement_id", "ambiguous")


def link_violations(spark: SparkSession, d: str) -> DataFrame:
    """Breaches of each rule in a graph with planted faults: spans past the end, unknown documents and children."""
    p, e = _link_graph(spark, d)
    p = p.withColumns({"span_start": F.col("ordinal") % 90, "span_end": F.col("ordinal") % 70 + 20})
    docs = p.select("document_id").distinct().where("document_id <> 'fork'").withColumn("len", F.lit(80))
    docs = docs.unionByName(docs.where("document_id = 'reply'"))
    messages = p.where("ordinal % 13 <> 0").select("message_id").distinct()
    e = e.unionByName(e.where("child_placement_id LIKE '%7'")).unionByName(e.where("child_placement_id LIKE '%11'").withColumn("child_placement_id", F.concat("child_placement_id", F.lit("x"))))
    v = graph.violations(table(spark, d, "session_catalog").select("session_id"), messages, docs, p.unionByName(p.where("ordinal % 17 = 0")), e)
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def recall_at_10(spark: SparkSession, d: str) -> DataFrame:
    """How many of the ten nearest by the whole vector are found by its first 32 members, for each query."""
    e = table(spark, d, "embeddings")
    short = e.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    wanted = semantic.topk_each(e, e.where("vec_id % 50 = 0"), 10)
    found = semantic.topk_each(short, short.where("vec_id % 50 = 0"), 10)
    return aggregates.recall_at(found, wanted, 10).select("query_id", F.round("recall", 6).alias("recall"))


_HASHED = {"session_catalog": ("session_id", "provider_id", "install_id", "cwd", "repo_slug", "title", "started_at"), "installations": ("install_id", "tz_name", "locale_tag", "provider_id", "root_dir"), "chat_rows": ("row_id", "session_id", "msg_uuid", "parent_uuid", "msg_role", "sent_at", "msg_content"), "message_links": ("link_id", "msg_uuid", "parent_uuid", "session_id", "is_sidechain", "relation", "seen_at"), "raw_transcripts": ("line_id", "source_path", "line_no", "raw_json"), "export_lines": ("line_id", "stream_id", "file_no", "line_no", "exported_at", "raw_json"), "pack_plans": ("plan_id", "plan_label", "capacity_tokens")}


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.content_hash({n: table(spark, d, n) for n in _HASHED})


QUERIES = {
    f.__name__: f
    for f in (claude_messages, claude_texts, claude_activities, claude_usage, claude_reports, sync_report, canonical_sessions, canonical_edges, canonical_facts, canonical_conflicts, usage_of_sessions, facet_tool_kind, facet_tool_name, usage_delta, branch_leaves, parent_resolution, link_violations, recall_at_10, content_hash)
}


def _claude_sql(source: str = "raw_transcripts") -> str:
    """CTEs: v (whole lines), m (messages with seq), b (their blocks), u (tool calls and results in order)."""
    kinds = " ".join(f"WHEN name = '{n}' THEN '{k}'" for k, names in TOOL_KINDS.items() for n in names)
    return rf"""f AS (SELECT CASE WHEN source_path LIKE '%.jsonl' THEN source_path ELSE source_path || '.jsonl' END AS path, line_no, line_id, raw_json, row_number() OVER (PARTITION BY source_path ORDER BY line_no, line_id) AS n FROM {source}),
t AS (SELECT path, n, trim(CASE WHEN n = 1 THEN ltrim(coalesce(raw_json, ''), chr(65279)) ELSE coalesce(raw_json, '') END, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM f),
v AS (SELECT path, n, t, CASE WHEN json_valid(t) AND t[1] = '{{' THEN t::JSON END AS j FROM t),
m0 AS (SELECT path, n, j, coalesce(nullif(j->'message'->>'role', ''), j->>'type') AS role FROM v WHERE json_type(j->'message') = 'OBJECT'),
m AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS seq, j->>'uuid' AS uuid, coalesce((j->>'isSidechain') = 'true', false) AS side FROM m0 WHERE role IN ('user', 'assistant', 'system')),
b AS (SELECT path, n, seq, uuid, side, i, c->i AS b FROM (SELECT path, n, seq, uuid, side, j->'message'->'content' AS c, unnest(range(json_array_length(j->'message'->'content')::BIGINT)) AS i FROM m WHERE json_type(j->'message'->'content') = 'ARRAY') WHERE json_type(c->i) = 'OBJECT'),
u AS (SELECT path, n, i, uuid, side, 'use' AS what, b->>'id' AS id, b->>'name' AS name, false AS err FROM b WHERE b->>'type' = 'tool_use' AND json_type(b->'name') = 'VARCHAR'
 UNION ALL SELECT path, n, i, uuid, side, 'result', b->>'tool_use_id', NULL, coalesce(b->>'is_error' = 'true', false) FROM b WHERE b->>'type' = 'tool_result'),
a0 AS (SELECT *, lead(what) OVER w AS w2, lead(err) OVER w AS e2, lead(uuid) OVER w AS u2 FROM u WINDOW w AS (PARTITION BY path, id ORDER BY n, i)),
a AS (SELECT path, name, CASE {kinds} ELSE 'unknown' END AS kind, CASE WHEN id IS NULL OR w2 IS DISTINCT FROM 'result' THEN 'unknown' WHEN e2 THEN 'error' ELSE 'success' END AS status, CASE WHEN side THEN 'subagent' ELSE 'main' END AS actor, CASE WHEN id IS NOT NULL AND w2 = 'result' THEN u2 ELSE uuid END AS anchor FROM a0 WHERE what = 'use'),
s AS (SELECT path, arg_min(j->>'sessionId', n) FILTER (WHERE json_type(j->'sessionId') = 'VARCHAR') AS native FROM m GROUP BY path),
g AS (SELECT path, n, uuid AS anchor, {', '.join(f"CASE WHEN coalesce(json_type(j->'message'->'usage'->'{k}'), 'NULL') = 'NULL' THEN 0 WHEN json_type(j->'message'->'usage'->'{k}') = 'UBIGINT' THEN (j->'message'->'usage'->>'{k}')::BIGINT END AS {c}" for k, c in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_read_input_tokens", "cache_read_tokens"), ("cache_creation_input_tokens", "cache_write_tokens")))}
 FROM m WHERE role = 'assistant' AND json_type(j->'message'->'usage') = 'OBJECT'),
o AS (SELECT * FROM g WHERE input_tokens + output_tokens + cache_read_tokens + cache_write_tokens IS NOT NULL)"""


_C = _claude_sql()
_HEALTH = """l AS (SELECT path, n, json_valid(ltrim(t, chr(65279))) AS ok, j IS NULL AS odd, n = max(n) OVER (PARTITION BY path) AS tail FROM v WHERE t <> ''),
h AS (SELECT path, CASE WHEN bool_and(ok) THEN 'clean' WHEN bool_and(ok OR tail) AND count(*) > 1 THEN 'partial' ELSE 'invalid' END AS health, count(*) FILTER (WHERE odd) - CASE WHEN bool_and(ok OR tail) AND NOT bool_and(ok) AND count(*) > 1 THEN 1 ELSE 0 END AS skipped FROM l GROUP BY path)"""
_MSG = ids.PREFIXES["message"]
_FLAT = "CASE json_type({0}) WHEN 'VARCHAR' THEN {0}->>'$' WHEN 'ARRAY' THEN array_to_string(list_filter(list_transform(range(json_array_length({0})::BIGINT), lambda k: CASE WHEN json_type({0}->k) = 'VARCHAR' THEN {0}->>k WHEN json_type({0}->k) = 'OBJECT' AND coalesce({0}->k->>'type', 'text') = 'text' AND json_type({0}->k->'text') = 'VARCHAR' THEN {0}->k->>'text' END), lambda x: x IS NOT NULL), chr(10)) WHEN 'OBJECT' THEN CASE WHEN coalesce({0}->>'type', 'text') = 'text' THEN {0}->>'text' END END"
_P = "p AS (SELECT link_id, session_id, lower(msg_uuid) AS message_id, coalesce(relation, 'none') AS document_id, is_sidechain, nullif(trim(lower(parent_uuid)), '') AS parent FROM message_links WHERE msg_uuid IS NOT NULL AND session_id IS NOT NULL)"


def _near(cols: str) -> str:
    return f"""(SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS sim
 FROM (SELECT vec_id, ({cols})::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0) a JOIN (SELECT vec_id, ({cols})::DOUBLE[] AS e FROM embeddings) b ON a.vec_id <> b.vec_id) QUALIFY rank <= 10)"""


def _hash_sql(name: str, cols: tuple[str, ...]) -> str:
    def text(c: str) -> str:
        return f"epoch_us({c})::VARCHAR" if c.endswith("_at") else f"{c}::VARCHAR"

    row = " || ',' || ".join(f"coalesce(octet_length(encode({text(c)}))::VARCHAR || ':' || {text(c)}, '-')" for c in sorted(cols))
    parts = " || ".join(f"printf('%016X', (coalesce(sum(('0x' || substring(h, {16 * k + 2}, 15))::HUGEINT), 0) % 2305843009213693951)::BIGINT)" for k in range(4))
    return f"SELECT '{name}' AS table_name, count(*) AS n_rows, {parts} AS digest FROM (SELECT sha256({row}) AS h FROM {name})"


_KINDS = " ".join(f"WHEN '{n}' THEN '{k}'" for k, names in TOOL_KINDS.items() for n in names)

ORACLES = {
    "tool_activities": problems.ORACLES["p1_found"].rsplit("\n", 1)[0] + f"\nSELECT e->>'name' AS block_name, CASE e->>'name' {_KINDS} ELSE 'unknown' END AS kind, count(*) AS n FROM b WHERE e->>'type' = 'tool_use' AND json_type(e->'name') = 'VARCHAR' GROUP BY ALL",
    "claude_messages": f"WITH {_C} SELECT path, seq, uuid AS native_id, CASE WHEN json_type(j->'parentUuid') = 'VARCHAR' THEN j->>'parentUuid' END AS parent_native_id, role, side AS is_sidechain, CASE WHEN coalesce(j->>'isMeta', '') <> 'true' THEN j->>'timestamp' END AS timestamp FROM m",
    "claude_activities": f"WITH {_C} SELECT path, name, kind, status, actor, anchor, count(*) AS n FROM a GROUP BY ALL",
    "claude_usage": f"WITH {_C} SELECT path, anchor, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, 'observed' AS token_source FROM o",
    "claude_reports": f"WITH {_C}, {_HEALTH} SELECT path, health, coalesce(c, 0) AS committed, skipped, NULL::VARCHAR AS error FROM h LEFT JOIN (SELECT path, count(*) AS c FROM m GROUP BY path) USING (path)",
    "sync_report": f"""WITH {_C}, {_HEALTH}, z AS (SELECT path, sum(octet_length(encode(coalesce(raw_json, '')))) + count(*) - 1 AS len FROM f GROUP BY path)
SELECT count(*) AS sources, count(*) FILTER (WHERE len % 3 = 0) AS unchanged, 0::BIGINT AS withdrawn, (SELECT count(*) FROM m JOIN z USING (path) WHERE len % 3 <> 0) AS emitted, (SELECT count(*) FROM m JOIN z USING (path) WHERE len % 3 <> 0) AS committed,
 (SELECT coalesce(sum(skipped), 0)::BIGINT FROM h JOIN z USING (path) WHERE len % 3 <> 0) AS skipped, 0::BIGINT AS failed FROM z""",
    "canonical_conflicts": f"""WITH tt AS (SELECT source_path, line_no, line_id, raw_json FROM raw_transcripts UNION ALL SELECT source_path, line_no, line_id + 1099511627776, replace(raw_json, '"role":"', '"role":"assistant","was":"') FROM raw_transcripts WHERE line_no % 50 = 0), {_claude_sql('tt')}
SELECT path, count(*) AS n FROM (SELECT path, uuid FROM m WHERE uuid IS NOT NULL GROUP BY ALL HAVING count(DISTINCT role) > 1) GROUP BY path""",
    "link_violations": f"""WITH {_P}, q AS (SELECT *, link_id % 90 AS a, link_id % 70 + 20 AS b FROM p UNION ALL SELECT *, link_id % 90, link_id % 70 + 20 FROM p WHERE link_id % 17 = 0), d AS (SELECT DISTINCT document_id FROM p WHERE document_id <> 'fork'), dd AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE document_id = 'reply'),
r AS (SELECT 'document_id_repeated' AS rule, count(*) AS n FROM d WHERE document_id = 'reply' UNION ALL SELECT 'placement_id_repeated', count(*) FROM p WHERE link_id % 17 = 0 UNION ALL SELECT 'coordinates_repeated', count(*) FROM p WHERE link_id % 17 = 0
 UNION ALL SELECT 'placement_session_unknown', count(*) FROM q WHERE session_id NOT IN (SELECT session_id FROM session_catalog) UNION ALL SELECT 'placement_message_unknown', count(*) FROM q WHERE message_id NOT IN (SELECT message_id FROM p WHERE link_id % 13 <> 0)
 UNION ALL SELECT 'placement_document_unknown', count(*) FROM q WHERE document_id NOT IN (SELECT document_id FROM d) UNION ALL SELECT 'span_outside', count(*) FROM q JOIN dd USING (document_id) WHERE a > b OR b > 80
 UNION ALL SELECT 'edge_child_unknown', count(*) FROM p WHERE parent IS NOT NULL AND link_id::VARCHAR LIKE '%11' UNION ALL SELECT 'edge_child_repeated', count(*) FROM p WHERE parent IS NOT NULL AND link_id::VARCHAR LIKE '%7')
SELECT rule, n FROM r WHERE n > 0""",
    "canonical_sessions": f"WITH {_C} SELECT native AS native_id, count(*) AS placements, count(DISTINCT coalesce(uuid, path || seq)) AS messages FROM m JOIN s USING (path) GROUP BY native",
    "canonical_edges": f"WITH {_C} SELECT '{_MSG}' || (j->>'parentUuid') AS parent_message_id, CASE WHEN side THEN 'subagent' ELSE 'reply' END AS relation, count(*) AS n FROM m WHERE json_type(j->'parentUuid') = 'VARCHAR' AND j->>'parentUuid' <> '' GROUP BY ALL",
    "canonical_facts": f"""WITH {_C}, x AS (SELECT '{_MSG}' || anchor AS message_id, count(*) AS activities FROM a WHERE anchor IS NOT NULL GROUP BY ALL), y AS (SELECT '{_MSG}' || anchor AS message_id, count(*) AS usage_events, sum(output_tokens)::BIGINT AS output_tokens FROM o WHERE anchor IS NOT NULL GROUP BY ALL)
SELECT coalesce(x.message_id, y.message_id) AS message_id, coalesce(activities, 0) AS activities, coalesce(usage_events, 0) AS usage_events, output_tokens FROM x FULL OUTER JOIN y ON x.message_id = y.message_id""",
    "usage_of_sessions": f"WITH {_C} SELECT count(DISTINCT native) AS sessions, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_write_tokens)::BIGINT AS cache_write_tokens, 0::BIGINT AS reasoning_tokens, count(*) AS observed, 0::BIGINT AS derived FROM o JOIN s USING (path) WHERE anchor IS NOT NULL",
    "facet_tool_kind": f"WITH {_C} SELECT DISTINCT '{_MSG}' || anchor AS id FROM a WHERE kind = 'command' AND anchor IS NOT NULL",
    "facet_tool_name": f"WITH {_C} SELECT DISTINCT '{_MSG}' || anchor AS id FROM a WHERE name = 'Read' AND anchor IS NOT NULL",
    "claude_texts": f"""WITH {_C}, q AS (SELECT path, seq, i, CASE b->>'type' WHEN 'text' THEN CASE WHEN json_type(b->'text') = 'VARCHAR' THEN b->>'text' END WHEN 'thinking' THEN CASE WHEN json_type(b->'thinking') = 'VARCHAR' AND trim(b->>'thinking', ' ' || chr(10) || chr(9)) <> '' THEN b->>'thinking' END WHEN 'tool_result' THEN nullif({_FLAT.format("b->'content'")}, '') END AS x FROM b),
k AS (SELECT path, n, seq, i, b->>'name' AS name, list_filter(list_transform(['path', 'file_path', 'filePath', 'target', 'command', 'cmd', 'url', 'query', 'pattern', 'glob', 'glob_pattern', 'regex', 'description'], lambda k: CASE WHEN json_type(b->'input') = 'OBJECT' AND json_type(b->'input'->k) = 'VARCHAR' THEN nullif(trim(b->'input'->>k), '') END), lambda x: x IS NOT NULL)[1] AS target FROM b WHERE b->>'type' = 'tool_use' AND json_type(b->'name') = 'VARCHAR'),
z AS (SELECT path, seq, i, 0 AS late, x FROM q WHERE x IS NOT NULL UNION ALL SELECT path, seq, i, 1, name || '(' || coalesce(CASE WHEN name IN ({', '.join(f"'{n}'" for names in TOOL_KINDS.values() for n in names)}) THEN left(target, 512) END, '') || ')' FROM k)
SELECT m.path, m.seq, md5(CASE WHEN json_type(m.j->'message'->'content') = 'VARCHAR' THEN m.j->'message'->>'content' ELSE coalesce(y.x, '') END) AS digest FROM m LEFT JOIN (SELECT path, seq, string_agg(x, chr(10) ORDER BY late, i) AS x FROM z GROUP BY ALL) y USING (path, seq)""",
    "usage_delta": """WITH t AS (SELECT event_id, user_id, ts, floor(value)::BIGINT AS total FROM events), p AS (SELECT *, max(CASE WHEN total > 0 THEN total END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM t)
SELECT event_id, total - coalesce(base, 0) AS increment FROM p WHERE total > 0 AND total > coalesce(base, 0)""",
    "branch_leaves": f"""WITH {_P}, c AS (SELECT * FROM (SELECT *, bool_or(NOT coalesce(is_sidechain, false)) OVER (PARTITION BY session_id) AS main FROM p) WHERE NOT main OR NOT coalesce(is_sidechain, false))
SELECT session_id, link_id::VARCHAR AS placement_id, message_id, parent IS NOT NULL AS has_parent FROM c WHERE NOT EXISTS (SELECT 1 FROM c k WHERE k.session_id = c.session_id AND k.parent = c.message_id)""",
    "parent_resolution": f"""WITH {_P}, r AS (SELECT c.link_id, c.session_id, count(q.link_id) AS n, min(q.link_id::VARCHAR) AS one, count(q.link_id) FILTER (WHERE q.document_id = c.document_id) AS same, min(q.link_id::VARCHAR) FILTER (WHERE q.document_id = c.document_id) AS near
 FROM p c LEFT JOIN p q ON q.session_id = c.session_id AND q.message_id = c.parent WHERE c.parent IS NOT NULL GROUP BY ALL)
SELECT link_id::VARCHAR AS placement_id, session_id, CASE WHEN n = 1 THEN one WHEN n > 1 AND same = 1 THEN near END AS parent_placement_id, n > 1 AND same <> 1 AS ambiguous FROM r""",
    "recall_at_10": f"WITH w AS MATERIALIZED {_near('embedding')}, f AS MATERIALIZED {_near('embedding[1:32]')} SELECT w.query_id, round(sum(CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.query_id = w.query_id AND f.id = w.id) THEN 1 ELSE 0 END) / count(*), 6) AS recall FROM w GROUP BY w.query_id",
    "content_hash": " UNION ALL ".join(_hash_sql(n, c) for n, c in _HASHED.items()),
}
