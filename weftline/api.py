"""The request surface: search, get, show, list, context, message, contexts, resume, status and handoff over canonical tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import aggregates, canonical, filters, graph, handoff, index, lookups, paging, ranking, semantic
from weftline.operators.redact import embedded
from weftline.session import cut


class EngineError(Exception):
    """Base of the errors of a request, with their code and the exit status of a command line."""

    code, status = "internal", 70


class InvalidRequest(EngineError):
    code, status = "invalid_request", 2


class NotFound(EngineError):
    code, status = "not_found", 4


class Ambiguous(EngineError):
    code, status = "ambiguous", 5


class StaleIndex(EngineError):
    code, status = "index_stale", 6


class StoreBusy(EngineError):
    code, status = "store_busy", 7


class SourceChanged(EngineError):
    code, status = "source_changed", 9


PARTIAL = 10


def envelope(result=None, error: EngineError | None = None, warnings: list[str] | None = None, generation: int = 0) -> str:
    """One JSON frame of a response or an error."""
    body = {"ok": error is None, "generation": generation, "warnings": warnings or []}
    body |= {"result": result} if error is None else {"error": {"code": error.code, "message": str(error)}}
    return json.dumps(body, ensure_ascii=False, sort_keys=True, default=str)


def frames(rows: DataFrame, kind: str = "response"):
    """A result as JSON lines, streamed partition by partition."""
    for r in rows.toJSON().toLocalIterator():
        yield json.dumps({"frame": kind, "data": json.loads(r)}, ensure_ascii=False, sort_keys=True)


@dataclass
class Page:
    rows: DataFrame
    warnings: list[str] = field(default_factory=list)
    cursor: str | None = None


class Engine:
    """Lazy requests over the tables of :class:`weftline.operators.canonical.Tables`; every method returns DataFrames.

    messages: message_id, role, text, timestamp, session_id, ... (``ts`` is derived). ``now`` is injected, never read.
    """

    def __init__(self, spark: SparkSession, tables: canonical.Tables, now: datetime, generation: int = 0, repo_slugs: DataFrame | None = None, vectors: DataFrame | None = None):
        self.spark, self.t, self.now, self.generation, self.repos, self.vectors = spark, tables, now.astimezone(UTC), generation, repo_slugs, vectors

    def _view(self) -> DataFrame:
        p = self.t.placements.groupBy("message_id").agg(F.min("session_id").alias("session_id"), F.min("ordinal").alias("ordinal"), F.bool_or(F.coalesce("is_sidechain", F.lit(False))).alias("is_sidechain"))
        return self.t.messages.select(F.col("message_id").alias("id"), "role", "text", F.col("timestamp").try_cast("timestamp").alias("ts"), F.col("message_id")).join(p, "message_id", "left").drop("message_id")

    def search(self, query: str, limit: int = 20, offset: int = 0, providers: list[str] | None = None, since=None, until=None, repo: str | None = None, sidechain: str = "include", tool_kind: str | None = None,
               tool_name: str | None = None, include_system: bool = False, mode: str = "lexical", group_by_session: bool = False, caller_repo: str | None = None, budget: paging.Budget | None = None, cursor: str | None = None) -> Page:
        try:
            filters.validate_search(query, limit, since, until)
        except ValueError as e:
            raise InvalidRequest(str(e)) from e
        budget, warnings, now, expires = budget or paging.Budget(), [], self.now, None
        digest = paging.query_digest(query=query, providers=providers, since=since, until=until, repo=repo, sidechain=sidechain, tool=(tool_kind, tool_name), system=include_system, mode=mode, grouped=group_by_session, caller=caller_repo)
        if cursor:
            claims = paging.read_cursor(cursor, digest, self.generation, mode, self.now)
            offset, now, expires = claims["offset"], datetime.fromisoformat(claims["clock"]), datetime.fromisoformat(claims["expires"])
        view = self._view()
        d = view
        if providers:
            d = filters.by_provider(d, self.t.sessions, providers)
        if repo is not None:
            d = filters.by_repo(d, self._repo_table(), repo)
        d = d.where(filters.in_time(F.col("ts"), since, until) & filters.visible(F.col("role"), include_system))
        d = filters.sidechain_facet(d, self.t.placements.withColumnRenamed("message_id", "id"), sidechain)
        d = filters.tool_facet(d, self.t.activities.withColumnRenamed("message_id", "id"), tool_kind, tool_name)
        if mode != "lexical" and self.vectors is None:
            warnings.append("lexical_fallback")
            mode = "lexical"
        window = paging.rank_window(mode != "semantic", group_by_session, offset, min(limit, budget.max_items))
        if mode == "lexical":
            hits = index.lexical(d, query, self.t.sessions, window)
        else:
            near = semantic.topk(self.vectors.join(d.select("id"), "id", "left_semi"), semantic.query_vector(query), window, "embedding", "id", semantic.FLOOR)
            hits = near.withColumnRenamed("sim", "score")
            if mode == "hybrid":
                hits = index.rrf([(index.rrf_rank(index.bm25(d, query), window=window), 0.5), (index.rrf_rank(hits, window=window), 0.5)], normalise=True)
        hits = hits.join(view, "id")
        if mode == "lexical":
            home = F.lit(None).cast("string")
            if self.repos is not None:
                hits = hits.join(self.repos.select("session_id", "repo_slug"), "session_id", "left")
                home = F.col("repo_slug")
            hits = hits.withColumn("score", ranking.final_score(F.col("score"), F.col("ts"), now, F.col("is_sidechain"), home == F.lit(caller_repo)))
        hits = hits.select("id", "session_id", "role", "text", "ts", "score")
        hits = ranking.best_of_session(hits) if group_by_session else hits.withColumn("occurrences", F.lit(1).cast("bigint"))
        terms = tx.literal_terms(F.lit(query))
        order, most = [F.desc("score"), F.asc("id")], min(limit, budget.max_items)
        hits = ranking.page(hits, order, most + 1, offset)  # one more tells whether a page follows
        hits = hits.join(self.t.claims.select("session_id", (F.col("id_state") == "resolved").alias("resume_available")), "session_id", "left").select(
            "id", "session_id", "score", "occurrences", F.coalesce("resume_available", F.lit(False)).alias("resume_available"), embedded(tx.snippet(F.col("text"), terms, budget.snippet_chars)).alias("text"),
            tx.why_matched(terms, F.col("text")).alias("why_matched"), handoff.suggestions(F.col("id"), F.col("session_id")).alias("suggested_next_commands"),
        )
        hits = cut(hits)
        cost = paging.hit_cost(F.col("id"), F.col("session_id"), F.col("text"), F.col("why_matched"), F.col("suggested_next_commands"), F.col("occurrences"))
        kept = ranking.within_budget(hits, cost, budget.max_bytes - paging.RESERVED, order, most).drop("used")
        # the next page starts after the rows that were kept; there is none after the last row or after a row too large for any page
        n, n_kept = hits.count(), kept.count()
        if n and not n_kept:
            warnings.append("hit_exceeds_budget")
        more = n > n_kept > 0
        return Page(kept, warnings, paging.make_cursor(offset + n_kept, digest, self.generation, mode, now, expires) if more else None)

    def _repo_table(self) -> DataFrame:
        if self.repos is None:
            raise InvalidRequest("no repository of sessions is known")
        return self.repos

    def get(self, ids: list[str]) -> DataFrame:
        return lookups.get_many(canonical.payload(self.t.messages, self.t.placements), ids, "message_id")

    show = get

    def list_sessions(self, limit: int = 50, offset: int = 0) -> DataFrame:
        v = self._view()
        s = ranking.page(self.t.sessions, [F.asc("session_id")], limit, offset)
        lines = v.join(s.select("session_id"), "session_id", "left_semi")
        out = s.join(aggregates.session_peek(lines), "session_id", "left").join(aggregates.session_title(s, lines), "session_id", "left").join(aggregates.latest_activity(lines), "session_id", "left")
        return out.orderBy("session_id")

    def list_messages(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return ranking.page(canonical.payload(self.t.messages, self.t.placements), [F.asc("message_id")], limit, offset)

    def mainline(self) -> DataFrame:
        line = graph.mainline(self.t.placements, self.t.edges)
        m = self.t.messages.select("message_id", "role", "text", "timestamp")
        return line.join(m, "message_id").withColumn("id", F.col("message_id"))

    def context(self, session_id: str, level: str = "raw", max_items: int | None = None) -> DataFrame:
        """Mainline of a session: raw messages, talks, or the session's summary; without a user message raw."""
        p = self.t.placements.where(F.col("session_id") == session_id)
        if not p.limit(1).count():
            raise NotFound(f"no session {session_id}")
        e = self.t.edges.join(p.select(F.col("placement_id").alias("child_placement_id")), "child_placement_id", "left_semi")
        line = graph.mainline(p, e).join(self.t.messages.select("message_id", "role", "text", "timestamp"), "message_id").withColumn("id", F.col("message_id"))
        if line.where("ambiguous").limit(1).count():
            raise Ambiguous("a message of the branch has several parents")
        if level != "raw" and not line.where("role = 'user'").limit(1).count():
            level = "raw"
        if level == "talks":
            return graph.talks(line).groupBy("session_id", "talk_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages")).orderBy("talk_no")
        if level == "sessions":
            return aggregates.session_summary(line.withColumnRenamed("position", "ordinal"))
        out = line.orderBy("position")
        return out.limit(max_items) if max_items else out

    def message(self, message_id: str, around: int = 2) -> DataFrame:
        """The message with its neighbours on the mainline of its only session."""
        found = [r[0] for r in self.t.placements.where(F.col("message_id") == message_id).select("session_id").distinct().limit(9).collect()]
        if not found:
            raise NotFound(f"no message {message_id}")
        if len(found) > 1:
            raise Ambiguous(f"the message is in several sessions: {sorted(found)[:8]}")
        line = self.context(found[0])
        anchor = line.where(F.col("message_id") == message_id).select("session_id", "position")
        if not anchor.limit(1).count():
            raise NotFound("the message is not on the mainline")
        return graph.window_around(line, anchor, around).orderBy("position")

    def message_contexts(self, message_id: str) -> DataFrame:
        return lookups.contexts(self.t.placements.where(F.col("message_id") == message_id), "message_id", "session_id", "placement_id")

    def session_resume(self, session_id: str) -> DataFrame:
        c = self.t.claims.where(F.col("session_id") == session_id)
        return c.select("session_id", handoff.resume_command(F.col("provider_id"), F.col("provider_session_id"), F.col("id_state"), F.col("cwd")).alias("resume"))

    def status(self) -> DataFrame:
        u = aggregates.usage_totals(self.t.usage).select(F.to_json(F.struct("*")).alias("usage"))
        n = self.t.messages.agg(F.count(F.lit(1)).alias("messages"))
        s = self.t.sessions.agg(F.count(F.lit(1)).alias("sessions"))
        p = self.t.placements.agg(F.count(F.lit(1)).alias("placements"), F.count_distinct("document_id").alias("sources"))
        return n.join(s).join(p).join(u).withColumn("generation", F.lit(self.generation))  # four single rows

    def handoff(self, query: str, **budgets) -> str:
        hits = self.search(query, limit=handoff.SEARCH_LIMIT).rows
        doc = self.t.placements.groupBy("message_id").agg(F.min("document_id").alias("document_id")).withColumnRenamed("message_id", "id")
        from pyspark.sql.window import Window

        ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id"))))  # one page
        full = ranked.select("rank", "id", "session_id").join(doc, "id", "left").join(self.t.messages.select(F.col("message_id").alias("id"), "text"), "id")
        return handoff.pack(query, handoff.evidence(full, budgets.get("max_evidence", handoff.MAX_EVIDENCE), budgets.get("max_tokens", handoff.MAX_TOKENS)).select("rank", "id", "session_id", "document_id", "text", "tokens"), self.generation, budgets.get("max_bytes", handoff.MAX_BYTES))
