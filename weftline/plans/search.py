"""Search, ranking, vector and text queries over the driver's tables, each with the SQL that gives the same rows.

``chat_rows`` serves as the message table: id = row_id, with its session, role, text and time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as tx
from weftline.operators import filters, index, ranking, semantic
from weftline.operators.redact import embedded
from weftline.session import scratch, spread, table

QUERY = "rate limit"
PHRASE = "retry.py"
PROSE = "deploy script"
NOW = datetime(2026, 11, 1)
NOW_SQL = "TIMESTAMP '2026-11-01 00:00:00'"
_H = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
M_SQL = "m AS (SELECT row_id AS id, session_id, lower(msg_role) AS role, msg_content AS text, sent_at AS ts, msg_uuid, parent_uuid FROM chat_rows WHERE session_id IS NOT NULL AND msg_content IS NOT NULL)"


def messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chat_rows").where("session_id IS NOT NULL AND msg_content IS NOT NULL")
    return c.select(F.col("row_id").alias("id"), "session_id", F.lower("msg_role").alias("role"), F.col("msg_content").alias("text"), F.col("sent_at").cast("timestamp").alias("ts"), F.col("row_id").alias("ordinal"), "msg_uuid", "parent_uuid")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang", "repo_slug", F.col("created_at").cast("timestamp").alias("ts"))


_INDEXES: dict[tuple[str, str, str], index.Index] = {}


def indexed(spark: SparkSession, d: str, corpus: str) -> index.Index:
    """The persisted index of a corpus, built on first use in the shared folder and then read by every search."""
    key = (spark.sparkContext.applicationId, d, corpus)
    if key not in _INDEXES:
        m = {
            "messages": lambda: messages(spark, d), "visible": lambda: messages(spark, d).where(filters.visible(F.col("role"))), "documents": lambda: documents(spark, d), "whole": lambda: documents(spark, d),
            "sessions": lambda: index.session_documents(table(spark, d, "session_catalog"), messages(spark, d)),
        }[corpus]()
        _INDEXES[key] = index.Index.build(m, f"{scratch(spark)}/{corpus}", cap=None if corpus == "whole" else tx.INDEX_CHARS)
    return _INDEXES[key]


def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    w = messages(spark, d).select(F.explode(tx.words(tx.cjk_tokens(tx.bounded_index_text(F.col("text"))))).alias("term"))
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def search_lexical_and(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, "visible").bm25(QUERY).select("id", F.round("score", 6).alias("score"))


def search_unindexed(spark: SparkSession, d: str) -> DataFrame:
    """The same over a frame that has no index."""
    m = messages(spark, d).where(filters.visible(F.col("role")))
    return index.bm25(m, QUERY).select("id", F.round("score", 6).alias("score"))


def search_whole_texts(spark: SparkSession, d: str) -> DataFrame:
    """A search over an index without the cap on characters."""
    return indexed(spark, d, "whole").bm25(QUERY).select("id", F.round("score", 6).alias("score"))


def search_postings(spark: SparkSession, d: str) -> DataFrame:
    """The same match through the inverted index: ids and term counts."""
    return indexed(spark, d, "messages").match(QUERY).select("id", (F.col("tf0") + F.col("tf1")).cast("bigint").alias("n"))


def search_phrase_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, "documents").match(PHRASE).select("id")


def search_top_page(spark: SparkSession, d: str) -> DataFrame:
    """Third page of twenty of the total order."""
    hits = indexed(spark, d, "visible").bm25(QUERY).select("id", F.round("score", 6).alias("score"))
    return ranking.page(hits, [F.desc("score"), F.asc("id")], 20, 40)


def search_capped_projection(spark: SparkSession, d: str) -> DataFrame:
    t = documents(spark, d).where("text IS NOT NULL")
    return t.where(F.length("text") > tx.INDEX_CHARS).select("id", F.length(tx.bounded_index_text(F.col("text"))).alias("indexed"), F.length("text").alias("whole"))


def search_group_by_session(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    hits = indexed(spark, d, "messages").bm25(QUERY).select("id", F.round("score", 6).alias("score")).join(m.select("id", "session_id"), "id")
    return ranking.best_of_session(hits.select("id", "session_id", "score"))


def search_rank_signals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "message_rows").where("msg_content IS NOT NULL")
    rel = (F.length("msg_content") % 10).cast("double") / 10.0
    s = ranking.final_score(rel, F.col("received_at"), NOW, F.col("is_sidechain"), F.col("install_id").endswith("a"))
    return e.select("row_id", F.round(s, 6).alias("score"))


def search_session_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Sessions found by their folder or first request, each shown by its standing message."""
    return indexed(spark, d, "sessions").bm25(QUERY).select("id", F.round("score", 6).alias("score"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    t = documents(spark, d).where("text IS NOT NULL")
    a = index.rrf_rank(t.select("id", F.length("text").alias("score")), window=512)
    b = index.rrf_rank(indexed(spark, d, "documents").bm25(PROSE).select("id", F.round("score", 6).alias("score")), window=512)
    return index.rrf([(a, 1.0), (b, 1.0)]).select("id", F.round("score", 9).alias("score"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector with the smallest id serves as the query."""
    return table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return semantic.topk(table(spark, d, "embeddings"), _query_vector(spark, d), 25).select("id", F.round("sim", 6).alias("sim"))


def semantic_floor(spark: SparkSession, d: str) -> DataFrame:
    return semantic.topk(table(spark, d, "embeddings"), _query_vector(spark, d), None, floor=0.2).select("id", F.round("sim", 6).alias("sim"))


def semantic_each(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return semantic.topk_each(e, e.where("vec_id % 50 = 0"), 5).select("query_id", "id", F.round("sim", 5).alias("sim"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    lex = index.rrf_rank(indexed(spark, d, "documents").bm25(PROSE).select("id", F.round("score", 6).alias("score")), window=512)
    sem = index.rrf_rank(semantic.topk(e, _query_vector(spark, d), 512).select("id", F.round("sim", 6).alias("score")), window=512)
    return semantic.dedup_hybrid(lex, sem).select("id", F.round("score", 9).alias("score"))


def bigram_vector(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "graded_samples").select(F.col("sample_id").alias("id"), F.col("sample_text").alias("text"))
    return semantic.bigram_buckets(g).select("id", "bucket", F.round("weight", 6).alias("weight"))


def bigram_messages(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of all messages in sparse form."""
    return semantic.bigram_buckets(messages(spark, d)).select("id", "bucket", F.round("weight", 6).alias("weight"))


def message_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The same in the form a vector index is built from."""
    return semantic.dense_vectors(messages(spark, d))


def filter_provider_time(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "message_rows").select("row_id", "session_id", "msg_role", F.col("received_at").cast("timestamp").alias("ts"))
    s = table(spark, d, "session_catalog").select("session_id", "provider_id", "repo_slug")
    out = filters.by_provider(m, s, ["claude", "codex"])
    return out.where(filters.in_time(F.col("ts"), datetime(2026, 1, 1), datetime(2026, 7, 1)) & filters.visible(F.lower("msg_role"))).select("row_id")


def filter_repo(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "message_rows").select("row_id", "session_id")
    return filters.by_repo(m, table(spark, d, "session_catalog"), "lab/cinderbus")


def facet_main_only(spark: SparkSession, d: str) -> DataFrame:
    ln = table(spark, d, "message_links").select(F.lower("msg_uuid").alias("id"), "is_sidechain")
    return filters.sidechain_facet(ln.select("id").distinct(), ln, "main_only")


def facet_subagent_only(spark: SparkSession, d: str) -> DataFrame:
    ln = table(spark, d, "message_links").select(F.lower("msg_uuid").alias("id"), "is_sidechain")
    return filters.sidechain_facet(ln.select("id").distinct(), ln, "subagent_only")


def snippet_window(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where(F.lower("text").contains("limit"))
    return m.select("id", tx.snippet(F.col("text"), F.array(F.lit("limit")), 40).alias("snippet"))


def why_matched(spark: SparkSession, d: str) -> DataFrame:
    terms = tx.literal_terms(F.lit("Limit retry.py budget 租约续期"))
    return messages(spark, d).select("id", F.array_join(tx.why_matched(terms, F.col("text")), "|").alias("why"))


def cjk_tokens(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where(tx.has_han(F.col("text")))
    return m.select("id", F.size(F.split(tx.cjk_bigrams(F.col("text")), r"\s+")).alias("n_bigram_tokens"), F.md5(F.concat_ws(" ", tx.words(tx.cjk_tokens(F.regexp_replace("text", tx.HAN + "{2,}", "界"))))).alias("digest"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text IS NOT NULL").select("id", tx.token_estimate(F.col("text")).alias("tokens"), tx.json_len(F.col("text")).cast("bigint").alias("json_bytes"))


def redact_text(spark: SparkSession, d: str) -> DataFrame:
    """Messages with credentials planted from their own ids, and ordinary ones, through the redactor."""
    m = table(spark, d, "message_rows").where("msg_content IS NOT NULL AND msg_uuid IS NOT NULL")
    key = F.regexp_replace("msg_uuid", "[^0-9a-fA-F]", "")
    t = F.when(F.col("row_id") % 3 == 0, F.concat("msg_content", F.lit(" key sk-"), key, F.lit(" end"))).when(F.col("row_id") % 3 == 1, F.concat("msg_content", F.lit(" token = \""), key, F.lit("\""))).otherwise(F.concat(F.lit("use AKIA"), F.upper(F.left(key, F.lit(16))), F.lit(", Bearer "), key, F.lit(" ok")))
    return spread(m.select("row_id", t.alias("t"))).select("row_id", F.md5(embedded(F.col("t"))).alias("redacted"))


def redact_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every message whole, with one credential of each planted shape after it, through the redactor."""
    m = table(spark, d, "message_rows").where("msg_content IS NOT NULL AND msg_uuid IS NOT NULL")
    key = F.regexp_replace("msg_uuid", "[^0-9a-fA-F]", "")
    t = F.concat("msg_content", F.lit(" key sk-"), key, F.lit(" end, use AKIA"), F.upper(F.left(key, F.lit(16))), F.lit(", Bearer "), key, F.lit(" ok"))
    return spread(m.select("row_id", t.alias("t"))).select("row_id", F.md5(embedded(F.col("t"))).alias("redacted"))


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Of each repository, the longest run of its oldest documents that fits 20,000 bytes."""
    t = documents(spark, d).where("text IS NOT NULL AND repo_slug IS NOT NULL AND ts IS NOT NULL")
    return ranking.within_budget(t.select("id", "repo_slug", "ts", F.octet_length("text").cast("bigint").alias("bytes")), F.col("bytes"), 20_000, ["ts", "id"], groups=["repo_slug"], slice_=F.to_date("ts")).select("id", "repo_slug", "used")


def list_page(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page(table(spark, d, "session_catalog").select("session_id", "provider_id"), [F.asc("session_id")], 50, 100)


def handoff_evidence(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.handoff import evidence

    t = documents(spark, d).where("text IS NOT NULL")
    hits = indexed(spark, d, "documents").bm25(PROSE).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).join(t.select("id", "text", F.col("source").alias("session_id")), "id")
    return evidence(ranked.withColumn("document_id", F.col("id").cast("string")), 20, 4000).select("id", "rank", "tokens", F.col("used_tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        token_frequency, search_lexical_and, search_unindexed, search_whole_texts, search_postings, search_phrase_adjacent, search_top_page, search_capped_projection, search_group_by_session, search_rank_signals, search_session_metadata, rrf_fusion, semantic_topk,
        semantic_floor, semantic_each, hybrid_search, bigram_vector, bigram_messages, message_vectors, filter_provider_time, filter_repo, facet_main_only, facet_subagent_only, snippet_window, why_matched, cjk_tokens, token_estimate, redact_text, redact_messages,
        budget_prefix, list_page, handoff_evidence,
    )
}


def _bm25_sql(src: str, q: str, name: str = "s") -> str:
    """CTEs ending in ``name``(id, score): BM25 over ``src``(id, text) for the blank-separated terms of q."""
    terms = q.split()
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE) + 1) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / adl))" for i in range(len(terms)))
    return rf"""{name}0 AS (SELECT id, regexp_extract_all(regexp_replace(lower(left(text, 16000)), '[{_H}]+', ' ', 'g'), '[\p{{L}}\p{{N}}]+') AS w, regexp_extract_all(lower(left(text, 16000)), '[{_H}]+') AS h FROM {src}),
{name}1 AS (SELECT id, len(w) + coalesce(list_sum(list_transform(h, lambda r: 2 * length(r) - 1)), 0) AS dl, {tf} FROM {name}0),
{name}2 AS (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS adl, {df} FROM {name}1),
{name} AS (SELECT id, round({score}, 6) AS score FROM {name}1, {name}2 WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(terms)))})"""


_VIS = "coalesce(role NOT IN ('system', 'developer'), true)"
_DOCS = "docs AS (SELECT doc_id AS id, text, source FROM documents WHERE text IS NOT NULL)"
_Q = "q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1)"
_SIM = "sims AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], e) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e, e))) AS s FROM embeddings, q)"
_NEAR = """near AS (SELECT a.vec_id AS query_id, a.label AS ql, b.vec_id AS id, b.label AS label, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS sim
 FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) a JOIN embeddings b ON a.vec_id <> b.vec_id)"""
_RL = [f"(SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM {{}} ORDER BY score DESC, id LIMIT 512))"]

ORACLES = {
    "token_frequency": rf"""WITH {M_SQL}, t AS (SELECT lower(left(text, 16000)) AS t FROM m),
h AS (SELECT unnest(regexp_extract_all(t, '[{_H}]+')) AS r FROM t),
w AS (SELECT unnest(regexp_extract_all(regexp_replace(t, '[{_H}]+', ' ', 'g'), '[\p{{L}}\p{{N}}]+')) AS term FROM t
 UNION ALL SELECT unnest(list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1))) FROM h UNION ALL SELECT unnest(list_transform(range(1, length(r)), lambda i: substring(r, i, 2))) FROM h)
SELECT term, count(*) AS n FROM w GROUP BY term""",
    "search_lexical_and": f"WITH {M_SQL}, v AS (SELECT * FROM m WHERE {_VIS}), {_bm25_sql('v', QUERY)} SELECT id, score FROM s",
    "search_unindexed": f"WITH {M_SQL}, v AS (SELECT * FROM m WHERE {_VIS}), {_bm25_sql('v', QUERY)} SELECT id, score FROM s",
    "search_whole_texts": f"WITH {_DOCS}, {_bm25_sql('docs', QUERY).replace('left(text, 16000)', 'text')} SELECT id, score FROM s",
    "search_top_page": f"WITH {M_SQL}, v AS (SELECT * FROM m WHERE {_VIS}), {_bm25_sql('v', QUERY)} SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20 OFFSET 40",
    "search_postings": rf"""WITH {M_SQL}, t AS (SELECT id, regexp_extract_all(regexp_replace(lower(left(text, 16000)), '[{_H}]+', ' ', 'g'), '[\p{{L}}\p{{N}}]+') AS w FROM m)
SELECT id, len(list_filter(w, lambda x: x IN ('rate', 'limit'))) AS n FROM t WHERE list_contains(w, 'rate') AND list_contains(w, 'limit')""",
    "search_phrase_adjacent": rf"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(left(text, 16000)), '[{_H}]|[^\W_{_H}]+|[\p{{L}}\p{{N}}--[{_H}]]+') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(left(text, 16000)), '(^|[^\p{{L}}\p{{N}}]|[{_H}])retry[^\p{{L}}\p{{N}}]+py($|[^\p{{L}}\p{{N}}]|[{_H}])')""",
    "search_capped_projection": "SELECT doc_id AS id, length(left(text, 16000)) AS indexed, length(text) AS whole FROM documents WHERE length(text) > 16000",
    "search_group_by_session": f"""WITH {M_SQL}, {_bm25_sql('m', QUERY)}, j AS (SELECT s.id, m.session_id, s.score FROM s JOIN m USING (id))
SELECT id, session_id, score, occurrences FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, id) AS rn, count(*) OVER (PARTITION BY session_id) AS occurrences FROM j) WHERE rn = 1""",
    "search_rank_signals": f"""SELECT row_id, round(CASE WHEN rel <= 0 THEN 0 ELSE greatest(0::DOUBLE, rel * greatest(0.3::DOUBLE, pow(0.5::DOUBLE, greatest(0::DOUBLE, age) / 30)) - CASE WHEN coalesce(is_sidechain, false) THEN 0.25::DOUBLE / 61 ELSE 0 END + CASE WHEN install_id LIKE '%a' THEN 0.5::DOUBLE / 61 ELSE 0 END) END, 6) AS score
FROM (SELECT *, (length(msg_content) % 10)::DOUBLE / 10 AS rel, (epoch_us({NOW_SQL}) - epoch_us(received_at))::DOUBLE / 86400e6 AS age FROM message_rows WHERE msg_content IS NOT NULL)""",
    "search_session_metadata": f"""WITH {M_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN role = 'user' THEN 0 WHEN role IN ('system', 'developer') THEN 2 ELSE 1 END, id) AS rn FROM m),
d AS (SELECT r.id, concat_ws(' ', r.session_id, c.cwd, CASE WHEN r.role = 'user' THEN r.text END) AS text FROM r LEFT JOIN session_catalog c USING (session_id) WHERE rn = 1), {_bm25_sql('d', QUERY)} SELECT id, score FROM s""",
    "rrf_fusion": f"""WITH {_DOCS}, {_bm25_sql('docs', PROSE)}, l AS (SELECT id, length(text) AS score FROM docs),
r AS (SELECT * FROM {_RL[0].format('l')} UNION ALL SELECT * FROM {_RL[0].format('s')}) SELECT id, round(sum(1::DOUBLE / (60 + rank)), 9) AS score FROM r GROUP BY id""",
    "semantic_topk": f"WITH {_Q}, {_SIM} SELECT id, round(s, 6) AS sim FROM sims ORDER BY s DESC, id LIMIT 25",
    "semantic_floor": f"WITH {_Q}, {_SIM} SELECT id, round(s, 6) AS sim FROM sims WHERE s >= 0.2::DOUBLE",
    "semantic_each": f"WITH {_NEAR} SELECT query_id, id, round(sim, 5) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rn FROM near) WHERE rn <= 5",
    "hybrid_search": f"""WITH {_DOCS}, {_bm25_sql('docs', PROSE)}, {_Q}, {_SIM}, v AS (SELECT id, round(s, 6) AS score FROM (SELECT * FROM sims ORDER BY s DESC, id LIMIT 512)),
a AS {_RL[0].format('s')}, b AS {_RL[0].format('v')} SELECT id, round(coalesce(0.5::DOUBLE / (60 + a.rank), 0) + coalesce(0.5::DOUBLE / (60 + b.rank), 0), 9) AS score FROM a FULL OUTER JOIN b USING (id)""",
    "bigram_vector": """WITH t AS (SELECT sample_id AS id, lower('passage: ' || sample_text) AS t FROM graded_samples WHERE trim(sample_text) <> ''),
g AS (SELECT id, unnest(list_transform(range(1, greatest(length(t), 2)), lambda i: substring(t, i, 2))) AS g FROM t),
b AS (SELECT id, CAST(('0x' || left(sha256(g), 8))::BIGINT % 384 AS INT) AS bucket, count(*)::DOUBLE AS w FROM g GROUP BY ALL)
SELECT id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM b""",
    "bigram_messages": rf"""WITH {M_SQL}, t AS (SELECT id, lower('passage: ' || text) AS t FROM m WHERE regexp_matches(text, '[^\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]')),
g AS (SELECT id, unnest(list_transform(range(1, greatest(length(t), 2)), lambda i: substring(t, i, 2))) AS g FROM t),
b AS (SELECT id, CAST(('0x' || left(sha256(g), 8))::BIGINT % 384 AS INT) AS bucket, count(*)::DOUBLE AS w FROM g GROUP BY ALL)
SELECT id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM b""",
    "filter_provider_time": """SELECT row_id FROM message_rows WHERE session_id IN (SELECT session_id FROM session_catalog WHERE provider_id IN ('claude-code', 'codex'))
 AND received_at >= TIMESTAMP '2026-01-01' AND received_at < TIMESTAMP '2026-07-01' AND coalesce(lower(msg_role) NOT IN ('system', 'developer'), true)""",
    "filter_repo": "SELECT row_id, session_id FROM message_rows WHERE session_id IN (SELECT session_id FROM session_catalog WHERE repo_slug = 'lab/cinderbus')",
    "facet_main_only": "SELECT lower(msg_uuid) AS id FROM message_links GROUP BY 1 HAVING NOT coalesce(bool_or(is_sidechain), false)",
    "facet_subagent_only": "SELECT lower(msg_uuid) AS id FROM message_links GROUP BY 1 HAVING bool_or(is_sidechain)",
    "snippet_window": f"""WITH {M_SQL}, p AS (SELECT id, text, length(text) AS n, instr(lower(text), 'limit') - 1 AS s FROM m WHERE contains(lower(text), 'limit')),
w AS (SELECT *, s + 5 AS e, CASE WHEN n - (s + 5) < 24 THEN least(s, 35 - (n - (s + 5))) WHEN s < 11 THEN s ELSE 11 END AS l, CASE WHEN n - (s + 5) < 24 THEN n - (s + 5) WHEN s < 11 THEN least(n - (s + 5), 35 - s) ELSE 24 END AS r FROM p)
SELECT id, substring(text, s - l + 1, l + 5 + r) AS snippet FROM w""",
    "why_matched": f"""WITH {M_SQL} SELECT id, array_to_string(list_filter(['Limit', 'retry.py', 'budget', '租约', '约续', '续期'], lambda t: contains(lower(text), lower(t))), '|') AS why FROM m""",
    "token_estimate": rf"""SELECT doc_id AS id, (length(text) - length(regexp_replace(text, '[{_H}]', '', 'g')) + ceil(octet_length(encode(regexp_replace(text, '[{_H}]', '', 'g'))) / 4.0::DOUBLE))::BIGINT AS tokens,
 (2 + octet_length(encode(text)) + length(regexp_replace(text, '[^"\\]', '', 'g')) + 5 * length(regexp_replace(text, '[^\x00-\x1f\x7f]', '', 'g')))::BIGINT AS json_bytes FROM documents WHERE text IS NOT NULL""",
    "budget_prefix": """SELECT id, repo_slug, used FROM (SELECT doc_id AS id, repo_slug, sum(octet_length(encode(text))) OVER (PARTITION BY repo_slug ORDER BY created_at, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used
 FROM documents WHERE text IS NOT NULL AND repo_slug IS NOT NULL AND created_at IS NOT NULL) WHERE used <= 20000""",
    "list_page": "SELECT session_id, provider_id FROM session_catalog ORDER BY session_id LIMIT 50 OFFSET 100",
    "redact_text": r"""WITH t AS (SELECT row_id, regexp_replace(msg_uuid, '[^0-9a-fA-F]', '', 'g') AS k, msg_content AS c FROM message_rows WHERE msg_content IS NOT NULL AND msg_uuid IS NOT NULL)
SELECT row_id, md5(CASE row_id % 3 WHEN 0 THEN c || ' key [REDACTED] end' WHEN 1 THEN c || ' token = "' || k || '"' ELSE 'use [REDACTED], Bearer [REDACTED] ok' END) AS redacted FROM t""",
    "redact_messages": "SELECT row_id, md5(msg_content || ' key [REDACTED] end, use [REDACTED], Bearer [REDACTED] ok') AS redacted FROM message_rows WHERE msg_content IS NOT NULL AND msg_uuid IS NOT NULL",
    "handoff_evidence": rf"""WITH {_DOCS}, {_bm25_sql('docs', PROSE)}, r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 50),
e AS (SELECT r.id, r.rank, (length(text) - length(regexp_replace(text, '[{_H}]', '', 'g')) + ceil(octet_length(encode(regexp_replace(text, '[{_H}]', '', 'g'))) / 4.0::DOUBLE))::BIGINT AS tokens FROM r JOIN docs USING (id) WHERE trim(text) <> '' AND rank <= 20),
u AS (SELECT *, sum(tokens) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used_tokens FROM e) SELECT id, rank, tokens, used_tokens FROM u WHERE used_tokens <= 4000""",
}
ORACLES["search_phrase_adjacent"] = ORACLES["search_phrase_adjacent"].split("\n")[1]
