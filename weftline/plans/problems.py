"""Queries of the general data problems (1, 2, 4, 5, 6) over the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import dedup, drift, flatten, hierarchy, instants
from weftline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.blocks(table(spark, d, "raw_transcripts"), fields=()).select("line_id", "block_path")


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    return flatten.blocks(table(spark, d, "raw_transcripts"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return flatten.records(table(spark, d, "raw_transcripts"))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    return flatten.members(table(spark, d, "raw_transcripts"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.restated(table(spark, d, "message_rows"), table(spark, d, "installations"))


def p2_normalised(spark: SparkSession, d: str) -> DataFrame:
    return instants.normalise(table(spark, d, "message_rows"), table(spark, d, "installations"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "message_links"))


def p4_tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "message_links"), with_path=True, with_sizes=True)


def p4_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Pre-order numbers: the descendants of a message are those with numbers inside its interval."""
    return hierarchy.intervals(table(spark, d, "message_links"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every message under every other one, with the number of steps between them."""
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, d, "message_links"), with_path=True))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.repeated(table(spark, d, "message_rows"))


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Rows and messages of each session before and after."""
    rows = table(spark, d, "message_rows").select("row_id", "msg_uuid", "session_id", "received_at")
    lost = dedup.repeated(rows).withColumn("lost", F.lit(1))
    return rows.select("row_id", "session_id").join(lost, "row_id", "left").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count("lost")).alias("n_kept"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "export_lines"))


def p6_lifespans(spark: SparkSession, d: str) -> DataFrame:
    return drift.lifespans(drift.footers(table(spark, d, "export_lines"))).drop("ends_before")


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "export_lines"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_blocks, p1_records, p1_members, p2_found, p2_normalised, p4_found, p4_tree, p4_intervals, p4_descendants, p5_found, p5_sessions, p6_found, p6_lifespans, p6_unified)}

_UUID_SQL = r"""CASE WHEN regexp_full_match(lower(trim(msg_uuid)), '(urn:uuid:)?\{?[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}\}?')
 THEN regexp_replace(regexp_replace(lower(trim(msg_uuid)), '^urn:uuid:', ''), '[^0-9a-f]', '', 'g') ELSE lower(trim(msg_uuid)) END"""

_LINKS_SQL = """WITH RECURSIVE cur AS (
 SELECT lower(msg_uuid) AS id, nullif(trim(lower(parent_uuid)), '') AS parent FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(msg_uuid) ORDER BY seen_at DESC NULLS LAST, link_id DESC) AS rn FROM message_links WHERE msg_uuid IS NOT NULL) WHERE rn = 1),
t AS (
 SELECT id AS msg_uuid, id AS root_uuid, CAST(0 AS BIGINT) AS node_depth FROM cur WHERE parent IS NULL OR parent NOT IN (SELECT id FROM cur)
 UNION ALL SELECT c.id, t.root_uuid, t.node_depth + 1 FROM cur c JOIN t ON c.parent = t.msg_uuid)
"""

_ALIAS_SQL = ", ".join(f"('{n}', '{c}')" for c, names in drift.ALIASES.items() for n in (c, *names))
_FOOT_SQL = f"""WITH RECURSIVE al(path, concept) AS (VALUES {_ALIAS_SQL}),
t AS (SELECT stream_id, file_no, trim(raw_json, chr(65279) || chr(8203) || chr(160) || ' ' || chr(9) || chr(10) || chr(13)) AS t FROM export_lines WHERE stream_id IS NOT NULL AND file_no IS NOT NULL),
v AS (SELECT stream_id, file_no, t::JSON AS j FROM t WHERE json_valid(t) AND t[1] = '{{'),
r AS (SELECT stream_id, file_no, k AS path, json_extract(j, '$."' || k || '"') AS x FROM (SELECT stream_id, file_no, j, unnest(json_keys(j)) AS k FROM v)
 UNION ALL SELECT stream_id, file_no, path || '.' || k, json_extract(x, '$."' || k || '"') FROM (SELECT stream_id, file_no, path, x, unnest(json_keys(x)) AS k FROM r WHERE json_type(x) = 'OBJECT')),
d AS (SELECT DISTINCT stream_id, file_no, path, CASE json_type(x) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS type FROM r WHERE json_type(x) NOT IN ('NULL', 'OBJECT')),
g AS (SELECT stream_id, file_no, path, string_agg(type, ',' ORDER BY type) AS types FROM d GROUP BY ALL),
fl AS (SELECT stream_id, file_no, row_number() OVER w AS idx, lag(file_no) OVER w AS before, lead(file_no) OVER w AS after FROM (SELECT DISTINCT stream_id, file_no FROM t) WINDOW w AS (PARTITION BY stream_id ORDER BY file_no)),
n AS (SELECT g.stream_id, g.file_no, path, types FROM g JOIN fl USING (stream_id, file_no) WHERE before IS NOT NULL),
o AS (SELECT g.stream_id, fl.after AS file_no, path, types FROM g JOIN fl USING (stream_id, file_no) WHERE after IS NOT NULL),
c AS (SELECT coalesce(n.stream_id, o.stream_id) AS stream_id, coalesce(n.file_no, o.file_no) AS file_no, coalesce(n.path, o.path) AS path, n.types AS nt, o.types AS ot FROM n FULL OUTER JOIN o ON n.stream_id = o.stream_id AND n.file_no = o.file_no AND n.path = o.path)"""

ORACLES: dict[str, str] = {
    "p4_found": _LINKS_SQL + "SELECT msg_uuid, root_uuid, node_depth FROM t UNION ALL SELECT id, '', -1 FROM cur WHERE id NOT IN (SELECT msg_uuid FROM t)",
    "p4_descendants": _LINKS_SQL + """, u AS (
 SELECT c.parent AS ancestor_uuid, c.id AS descendant_uuid, CAST(1 AS BIGINT) AS distance FROM cur c JOIN t ON c.id = t.msg_uuid WHERE t.node_depth > 0
 UNION ALL SELECT t.parent, u.descendant_uuid, u.distance + 1 FROM u JOIN (SELECT c.id, c.parent FROM cur c JOIN t ON c.id = t.msg_uuid WHERE t.node_depth > 0) t ON u.ancestor_uuid = t.id)
SELECT ancestor_uuid, descendant_uuid, distance FROM u""",
    "p4_tree": _LINKS_SQL.replace("CAST(0 AS BIGINT) AS node_depth", "CAST(0 AS BIGINT) AS node_depth, id AS path").replace("t.node_depth + 1", "t.node_depth + 1, t.path || '/' || c.id") + """,
a AS (SELECT msg_uuid, node_depth, unnest(string_split(path, '/')) AS above, generate_subscripts(string_split(path, '/'), 1) - 1 AS pos FROM t),
s AS (SELECT above, count(*) - 1 AS n_descendants, max(node_depth - pos) AS height FROM a GROUP BY above)
SELECT msg_uuid, root_uuid, node_depth, path, n_descendants, height FROM t JOIN s ON above = msg_uuid UNION ALL SELECT id, '', -1, NULL, NULL, NULL FROM cur WHERE id NOT IN (SELECT msg_uuid FROM t)""",
    "p4_intervals": _LINKS_SQL.replace("CAST(0 AS BIGINT) AS node_depth", "CAST(0 AS BIGINT) AS node_depth, [id] AS path").replace("t.node_depth + 1", "t.node_depth + 1, list_append(t.path, c.id)") + """,
s AS (SELECT above, count(*) - 1 AS n FROM (SELECT unnest(path) AS above FROM t) GROUP BY above),
w AS (SELECT msg_uuid, root_uuid, row_number() OVER (PARTITION BY root_uuid ORDER BY path) - 1 AS first FROM t)
SELECT msg_uuid, root_uuid, first, first + n AS last FROM w JOIN s ON above = msg_uuid UNION ALL SELECT id, '', NULL, NULL FROM cur WHERE id NOT IN (SELECT msg_uuid FROM t)""",
    "p5_found": f"""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY session_id, {_UUID_SQL} ORDER BY received_at, row_id) AS rn
 FROM message_rows WHERE coalesce(trim(session_id), '') <> '' AND coalesce(trim(msg_uuid), '') <> '') WHERE rn > 1""",
    "p5_sessions": f"""SELECT session_id, count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce(lost, false)) AS n_kept FROM (
 SELECT session_id, coalesce(trim(session_id), '') <> '' AND coalesce(trim(msg_uuid), '') <> '' AND row_number() OVER (PARTITION BY session_id, {_UUID_SQL} ORDER BY received_at, row_id) > 1 AS lost FROM message_rows)
 GROUP BY session_id""",
    "p6_found": _FOOT_SQL + """, once AS (SELECT c.*, coalesce(al.concept, '~' || c.path) AS concept, row_number() OVER (PARTITION BY stream_id, file_no, coalesce(al.concept, '~' || c.path), nt IS NULL ORDER BY c.path) AS k FROM c LEFT JOIN al USING (path) WHERE nt IS NULL OR ot IS NULL)
SELECT coalesce(a.stream_id, b.stream_id) AS stream_id, coalesce(a.file_no, b.file_no) AS file_no, coalesce(a.path, '') AS old_path, coalesce(b.path, '') AS new_path FROM (SELECT * FROM once WHERE nt IS NULL) a FULL OUTER JOIN (SELECT * FROM once WHERE ot IS NULL) b USING (stream_id, file_no, concept, k)
UNION ALL SELECT stream_id, file_no, path, path FROM c WHERE nt <> ot""",
    "p6_lifespans": _FOOT_SQL + """, i AS (SELECT stream_id, file_no, path, types, before, after, idx, idx - row_number() OVER (PARTITION BY stream_id, path, types ORDER BY idx) AS q FROM g JOIN fl USING (stream_id, file_no)),
s AS (SELECT stream_id, path, types, q, min(file_no) AS first_file, max(file_no) AS last_file, count(*) AS n_files, arg_min(coalesce(before, -1), idx) <> -1 AS opens, arg_max(coalesce(after, -1), idx) <> -1 AS closes FROM i GROUP BY ALL)
SELECT stream_id, path, types, row_number() OVER (PARTITION BY stream_id, path, types ORDER BY first_file) AS island, first_file, last_file, n_files, opens, closes FROM s""",
    "p1_found": r"""WITH RECURSIVE ok AS (SELECT line_id, trim(raw_json, chr(65279) || chr(8203) || chr(160) || ' ' || chr(9) || chr(10) || chr(13)) AS j FROM raw_transcripts),
v AS (SELECT line_id, CASE WHEN json_valid(j) AND j[1] = '{' THEN j::JSON END AS j FROM ok),
b AS (
 SELECT line_id, CAST(i AS VARCHAR) AS block_path, CASE WHEN json_type(c) = 'ARRAY' THEN c->i ELSE c END AS e FROM (
  SELECT line_id, c, unnest(range(CASE json_type(c) WHEN 'ARRAY' THEN json_array_length(c)::BIGINT WHEN 'OBJECT' THEN 1 WHEN 'VARCHAR' THEN 1 ELSE 0 END)) AS i
  FROM (SELECT line_id, CASE WHEN json_type(j->'message') = 'OBJECT' THEN j->'message'->'content' END AS c FROM v WHERE j IS NOT NULL))
 UNION ALL
 SELECT line_id, block_path || '.' || i, CASE WHEN json_type(c) = 'ARRAY' THEN c->i ELSE c END FROM (
  SELECT line_id, block_path, c, unnest(range(CASE json_type(c) WHEN 'ARRAY' THEN json_array_length(c)::BIGINT WHEN 'OBJECT' THEN 1 WHEN 'VARCHAR' THEN 1 ELSE 0 END)) AS i
  FROM (SELECT line_id, block_path, e->'content' AS c FROM b WHERE json_type(e) = 'OBJECT')))
SELECT line_id, block_path FROM b WHERE json_type(e) <> 'NULL'""",
}
