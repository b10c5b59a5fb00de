"""Inverted index and lexical relevance.

:class:`Index` is a persisted index: postings in folders by hash of the term and sorted by term inside, with the length
of each text, and a table of document frequencies in the same folders. A search reads the folders, row groups and
columns of its own terms and nothing else; :func:`bm25` scores a frame that has no index by reading its texts once.
BM25 (k1 = 1.2, b = 0.75, idf = ln((N - df + 0.5) / (df + 0.5) + 1)) is this engine's own choice of relevance.
Texts are indexed up to ``cap`` characters, by default the fixed cap of the model; ``cap=None`` indexes whole texts.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.session import parts, spread

K1, B = 1.2, 0.75
RRF_K = 60
#: Folders of an index by hash of the term (choose them so that each holds a few GB), and slices of each by hash of the
#: id, so that a word in most texts is many files.
FOLDERS, SLICES = 16, 4


def _body(text: Column, cap: int | None) -> Column:
    return text if cap is None else tx.bounded_index_text(text) if cap == tx.INDEX_CHARS else F.left(text, F.lit(cap))


def _idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def _weight(tf: Column, dl: Column, adl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / adl))


class Index:
    """A persisted index in ``folder``; made by :meth:`build`, opened by its folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.postings, self.terms = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/terms")
        row = spark.read.parquet(f"{folder}/stats").first()
        self.n, self.adl, self.folders = row["n"], row["adl"], row["folders"]
        self._df: dict[str, int] = {}

    @classmethod
    def build(cls, messages: DataFrame, folder: str, id_col: str = "id", text_col: str = "text", cap: int | None = tx.INDEX_CHARS, folders: int = FOLDERS) -> Index:
        """Write the index of (id, text). One shuffle of (term, id, position); frequencies are counted from what was written."""
        spark = messages.sparkSession
        d = spread(messages.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), tx.words(tx.cjk_tokens(_body(F.col(text_col), cap))).alias("w"))).withColumn("dl", F.size("w"))
        tok = d.select("id", "dl", F.posexplode("w").alias("pos", "term")).withColumns({"folder": (F.crc32("term") % folders).cast("int"), "slice": F.pmod(F.hash("id"), F.lit(SLICES))})
        post = tok.repartition(parts(spark), "folder", "slice").groupBy("folder", "slice", "term", "id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.collect_list("pos")).alias("positions"))
        post.drop("slice").sortWithinPartitions("folder", "term", "id").write.partitionBy("folder").parquet(f"{folder}/postings")
        df = spark.read.parquet(f"{folder}/postings").groupBy("folder", "term").agg(F.count(F.lit(1)).alias("df"))
        df.repartition("folder").sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{folder}/terms")
        d.agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.avg(F.col("dl").cast("double")), F.lit(0.0)).alias("adl"), F.lit(folders).alias("folders")).coalesce(1).write.parquet(f"{folder}/stats")
        return cls(spark, folder)

    def _of(self, table: DataFrame, terms: list[str]) -> DataFrame:
        at = {zlib.crc32(t.encode()) % self.folders for t in terms}
        return table.where(F.col("folder").isin(*sorted(at)) & F.col("term").isin(*terms))

    def match(self, query: str) -> DataFrame:
        """(id, dl, tf0, tf1, ...): texts that hold every term (implicit AND) and every phrase side by side."""
        terms, phrases = phrase_terms(query)
        if not terms:
            return self.postings.where(F.lit(False)).select("id", "dl")
        own = lambda t: F.col("term") == t
        cols = [F.first("dl").alias("dl"), *[F.max(F.when(own(t), F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)]]
        wanted = list(dict.fromkeys(t for p in phrases for t in p))
        cols += [F.first(F.when(own(t), F.col("positions")), ignorenulls=True).alias(f"at{terms.index(t)}") for t in wanted]
        hit = self._of(self.postings, terms).groupBy("id").agg(*cols).where(" AND ".join(f"tf{i} IS NOT NULL" for i in range(len(terms))))
        for p in phrases:
            first, rest = F.col(f"at{terms.index(p[0])}"), [F.col(f"at{terms.index(t)}") for t in p[1:]]
            hit = hit.where(F.exists(first, _followed(rest)))
        return hit.select("id", "dl", *[f"tf{i}" for i in range(len(terms))])

    def frequencies(self, terms: list[str]) -> list[int]:
        """Texts that hold each term; at most one row a term comes to the driver."""
        new = [t for t in terms if t not in self._df]
        if new:
            if len(self._df) > 10_000:
                self._df.clear()
            self._df |= dict.fromkeys(new, 0) | {r["term"]: r["df"] for r in self._of(self.terms, new).select("term", "df").collect()}
        return [self._df[t] for t in terms]

    def bm25(self, query: str) -> DataFrame:
        """(id, score) of the texts that match all terms of the query."""
        terms, _ = phrase_terms(query)
        hit, score = self.match(query), F.lit(0.0)
        for i, df in enumerate(self.frequencies(terms) if terms else []):
            score = score + _idf(F.lit(self.n), F.lit(float(df))) * _weight(F.col(f"tf{i}").cast("double"), F.col("dl"), F.lit(self.adl))
        return hit.select("id", score.alias("score"))


def postings(messages: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, positions): Han texts are indexed by characters and pairs, all texts up to the index cap."""
    body = tx.bounded_index_text(F.col(text_col))
    tok = messages.select(F.col(id_col).alias("id"), F.posexplode(tx.words(tx.cjk_tokens(body))).alias("pos", "term"))
    return tok.groupBy("term", "id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def lengths(messages: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    return messages.select(F.col(id_col).alias("id"), F.size(tx.words(tx.cjk_tokens(tx.bounded_index_text(F.col(text_col))))).alias("dl"))


def phrase_terms(query: str) -> tuple[list[str], list[list[str]]]:
    """Distinct terms and the phrases of more than one term, from the literal query."""
    phrases = tx.word_phrases(query)
    return list(dict.fromkeys(t for p in phrases for t in p)), [p for p in phrases if len(p) > 1]


def match_all(post: DataFrame, query: str) -> DataFrame:
    """(id, tfs map<term, tf>): messages that hold every term (implicit AND) and every phrase side by side."""
    terms, phrases = phrase_terms(query)
    if not terms:
        return post.where(F.lit(False)).select("id", F.create_map().cast("map<string,int>").alias("tfs"))
    hit = post.where(F.col("term").isin(*terms)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tfs"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    hit = hit.where(F.size("tfs") == len(terms))
    for p in phrases:
        hit = hit.where(F.exists(F.col("at")[p[0]], _beside(p)))
    return hit.select("id", "tfs")


def _followed(rest: list[Column]):
    return lambda x: reduce(lambda a, b: a & b, [F.array_contains(c, x + k) for k, c in enumerate(rest, 1)])


def _beside(phrase: list[str]):
    def follows(x: Column) -> Column:
        out = F.lit(True)
        for k, t in enumerate(phrase[1:], 1):
            out = out & F.array_contains(F.col("at")[t], x + k)
        return out

    return follows


def _times(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == term))


def bm25(messages: DataFrame, query: str, id_col: str = "id", text_col: str = "text", cap: int | None = tx.INDEX_CHARS) -> DataFrame:
    """(id, score) of the messages that match all terms of the query.

    The query's terms are few, so texts are scored where they are read: term counts by array functions over the
    tokens, one aggregate of a single row for the statistics, no postings shuffle.
    """
    terms, phrases = phrase_terms(query)
    if not terms:
        return messages.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where(F.lit(False))
    d = spread(messages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    d = d.select("id", tx.words(tx.cjk_tokens(_body(F.col("text"), cap))).alias("w"))
    d = d.select("id", F.size("w").alias("dl"), *[_times(t).alias(f"tf{i}") for i, t in enumerate(terms)], *[_phrase_in(F.col("w"), p).alias(f"ph{i}") for i, p in enumerate(phrases)])
    stats = d.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("dl").cast("double")).alias("adl"), *[F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))])
    hit = d.where(" AND ".join([f"tf{i} > 0" for i in range(len(terms))] + [f"ph{i}" for i in range(len(phrases))])).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        score = score + _idf(F.col("n"), df) * _weight(tf, F.col("dl"), F.col("adl"))
    return hit.select("id", score.alias("score"))


def _phrase_in(w: Column, p: list[str]) -> Column:
    n = len(p)
    last = F.size(w) - n + 1
    return F.when(last >= 1, F.exists(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(w, i, n) == F.array(*map(F.lit, p)))).otherwise(False)


def rrf_rank(ranked: DataFrame, score: str = "score", id_col: str = "id", window: int = 512) -> DataFrame:
    """(id, rank) of the best ``window`` rows; the cut comes before the numbering, so one task numbers at most that many."""
    from pyspark.sql.window import Window

    top = ranked.orderBy(F.desc(score), F.asc(id_col)).limit(window)
    return top.select(F.col(id_col).alias("id"), F.row_number().over(Window.orderBy(F.desc(score), F.asc(id_col))).alias("rank"))


def rrf(lists: list[tuple[DataFrame, float]], k: int = RRF_K, normalise: bool = False) -> DataFrame:
    """(id, score): reciprocal-rank fusion of (id, rank) lists with weights; no weight at all gives no rows."""
    total = sum(w for _, w in lists)
    if total == 0:
        return lists[0][0].select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    out = None
    for d, w in lists:
        part = d.select("id", (F.lit(float(w / total if normalise else w)) / (F.lit(float(k)) + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def session_documents(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Searchable metadata of sessions: id, folder and first user request, with the message that stands for the session.

    ``messages``: id, session_id, role, text, ordinal. The representative is the first user message, else the first
    message that isn't system or developer, else the first.
    """
    order = F.struct(F.when(F.col("role") == "user", 0).when(F.col("role").isin("system", "developer"), 2).otherwise(1), F.col("ordinal"), F.col("id"))
    rep = messages.groupBy("session_id").agg(F.min_by("id", order).alias("id"), F.min_by("text", F.when(F.col("role") == "user", F.struct("ordinal", "id"))).alias("request"))
    s = sessions.select("session_id", "cwd").dropDuplicates(["session_id"])
    return rep.join(s, "session_id", "left").select("id", "session_id", F.concat_ws(" ", "session_id", "cwd", "request").alias("text"))


def lexical(messages: DataFrame, query: str, sessions: DataFrame | None = None, window: int = 512) -> DataFrame:
    """(id, score): message relevance fused by rank with matches in the session metadata."""
    lists = [(rrf_rank(bm25(messages, query), window=window), 1.0)]
    if sessions is not None:
        lists.append((rrf_rank(bm25(session_documents(sessions, messages), query), window=window), 1.0))
    return rrf(lists)
