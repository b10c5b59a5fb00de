"""Vector search by brute force, and the hashing vectoriser that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import spread

DIM = 384
FLOOR = 0.2


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, and which vectors are comparable: of the wanted length and not of norm zero. Others are zero rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    fits = (sizes == dim) & (dim > 0)
    x = np.zeros((len(vectors), dim))
    x[fits] = flat[np.repeat(fits, sizes)].reshape(-1, dim) if fits.any() else 0
    norm = np.linalg.norm(x, axis=1)
    if not np.isfinite(norm).all():
        raise ValueError("similarity is not finite")
    x /= np.where(norm > 0, norm, 1)[:, None]
    return x, fits & (norm > 0)


def topk(vectors: DataFrame, query: list[float], k: int | None, vec: str = "embedding", id_col: str = "vec_id", floor: float | None = None) -> DataFrame:
    """(id, sim) of the k nearest vectors, with k None of all (unordered). One matrix product a batch; of a batch only
    the k best go on, so the final top-k sees few rows. Vectors of another length, null or of norm zero have
    similarity 0; non-finite ones raise. Filters on ``vectors`` act before the cut."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.array(query, float)
        q /= np.linalg.norm(q) or 1
        for b in batches:
            x, _ = _matrix(b.column(1), len(q))
            sim = x @ q
            keep = np.arange(len(sim)) if floor is None else np.flatnonzero(sim >= floor)
            if k is not None and len(keep) > k:
                edge = -np.partition(-sim[keep], k - 1)[k - 1]
                keep = keep[sim[keep] >= edge - 1e-12]  # all ties of the last go on, the total order decides
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(sim[keep])], names=["id", "sim"])

    d = src.mapInArrow(run, f"id {kind}, sim double")
    return d if k is None else d.orderBy(F.desc("sim"), F.asc("id")).limit(k)


def topk_each(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "embedding", id_col: str = "vec_id", block: int = 256, max_queries: int = 100_000) -> DataFrame:
    """(query_id, id, rank, sim) of the k nearest of every query, itself left out; ties go to the smaller id.

    Queries are a stated set held in blocks: each task multiplies its rows with one block after another and keeps a
    running best k of each query over all its batches; the tasks' winners are merged in two steps, so a row never
    gathers more than k from each of 64 groups. The query set is refused beyond ``max_queries`` vectors.
    """
    rows = queries.select(id_col, F.col(vec).cast("array<double>").alias("v")).orderBy(id_col).limit(max_queries + 1).collect()
    if len(rows) > max_queries:
        raise ValueError(f"more than {max_queries} query vectors")
    spark = vectors.sparkSession
    if not rows:
        return spark.createDataFrame([], "query_id bigint, id bigint, rank int, sim double")
    dim = max(len(r[1] or []) for r in rows)
    qid = np.array([r[0] for r in rows])
    q, _ = _matrix(pa.array([r[1] for r in rows], pa.list_(pa.float64())), dim)
    box = spark.sparkContext.broadcast((qid, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = box.value
        best_id, best = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0))
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            x, _ = _matrix(b.column(1), q.shape[1])
            new_id, new = [], []
            for i in range(0, len(qid), block):
                s = q[i : i + block] @ x.T
                s[qid[i : i + block][:, None] == ids[None, :]] = -np.inf
                s = np.concatenate([best[i : i + block], s], 1)
                who = np.concatenate([best_id[i : i + block], np.broadcast_to(ids, (len(s), len(ids)))], 1)
                order = np.lexsort((who, -s), axis=1)[:, :k]
                new_id.append(np.take_along_axis(who, order, 1))
                new.append(np.take_along_axis(s, order, 1))
            best_id, best = np.concatenate(new_id), np.concatenate(new)
        if best.shape[1]:
            full = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, best.shape[1])[full.ravel()]), pa.array(best_id[full]), pa.array(best[full])], names=["query_id", "id", "sim"])

    near = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id IS NOT NULL").mapInArrow(run, "query_id bigint, id bigint, sim double")
    few = lambda c: F.slice(F.sort_array(c), 1, k)
    part = near.groupBy("query_id", F.pmod(F.spark_partition_id(), F.lit(64)).alias("g")).agg(few(F.collect_list(F.struct((-F.col("sim")).alias("n"), "id"))).alias("b"))
    best = part.groupBy("query_id").agg(few(F.flatten(F.collect_list("b"))).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("p", "b")).select("query_id", F.col("b.id").alias("id"), (F.col("p") + 1).alias("rank"), (-F.col("b.n")).alias("sim"))


#: Second half of the pair of a text that has one character only; no code point.
_ALONE = (1 << 21) - 1
#: Characters hashed in one numpy pass.
CHARS = 2_000_000


def _bigram_vectors(texts: DataFrame, id_col: str, text_col: str, prefix: str, dim: int, dense: bool) -> DataFrame:
    """One vector for each row with a text that isn't blank (white space of any script), made where the row lies: nothing is shuffled. Ids are those of rows."""
    t = F.lower(F.concat(F.lit(prefix), F.col(text_col)))
    rows = spread(texts.where(F.col(text_col).rlike(r"\P{IsWhite_Space}")).select(F.col(id_col).alias("id"), t.alias("t")))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, embedding array<float>" if dense else f"id {kind}, bucket int, weight double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}

        def bucket_of(pair: int) -> int:
            if pair not in known:
                g = chr(pair >> 21) + (chr(pair & _ALONE) if pair & _ALONE != _ALONE else "")
                known[pair] = int(hashlib.sha256(g.encode()).hexdigest()[:8], 16) % dim
            return known[pair]

        for batch in batches:
            size = pc.utf8_length(batch.column(1)).to_numpy().astype(np.int64)
            ends = np.flatnonzero(np.diff(np.cumsum(size) // CHARS)) + 1
            for lo, hi in zip([0, *ends], [*ends, len(size)]):
                n = size[lo:hi]
                if not len(n):
                    continue
                code = np.frombuffer("".join(batch.column(1).slice(lo, hi - lo).to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                first = np.cumsum(n) - n
                follow = np.append(code[1:], _ALONE)
                last = first + n - 1
                follow[last] = _ALONE
                pair = code << 21 | follow
                real = np.ones(len(code), bool)
                real[last[n > 1]] = False  # a text of one character is its own pair
                pairs, at = np.unique(pair[real], return_inverse=True)
                bucket = np.array([bucket_of(p) for p in pairs.tolist()], np.int64)[at]
                cell, w = np.unique(row[real] * dim + bucket, return_counts=True)
                owner, w = cell // dim, w.astype(float)
                weight = w / np.sqrt(np.bincount(owner, w * w, len(n)))[owner]
                ids = batch.column(0).slice(lo, hi - lo)
                if dense:
                    for k in range(0, len(n), 1000):
                        here = (owner >= k) & (owner < k + 1000)
                        full = np.zeros((min(1000, len(n) - k), dim), np.float32)
                        full[owner[here] - k, cell[here] % dim] = weight[here]
                        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * dim), pa.array(full.ravel()))
                        yield pa.RecordBatch.from_arrays([ids.slice(k, len(full)), vec], names=["id", "embedding"])
                else:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array((cell % dim).astype(np.int32)), pa.array(weight)], names=["id", "bucket", "weight"])

    return rows.mapInArrow(run, schema)


def bigram_buckets(texts: DataFrame, id_col: str = "id", text_col: str = "text", prefix: str = "passage: ", dim: int = DIM) -> DataFrame:
    """(id, bucket, weight): counts of hashed character pairs, L2-normalised; the sparse form of the vector."""
    return _bigram_vectors(texts, id_col, text_col, prefix, dim, False)


def dense_vectors(texts: DataFrame, id_col: str = "id", text_col: str = "text", prefix: str = "passage: ", dim: int = DIM, model_id: str = "bigram-hash-v1") -> DataFrame:
    """(model_id, id, embedding) of the same vectors: the table a vector index is built from."""
    return _bigram_vectors(texts, id_col, text_col, prefix, dim, True).select(F.lit(model_id).alias("model_id"), "id", "embedding")


def query_vector(text: str, dim: int = DIM, prefix: str = "query: ") -> list[float]:
    """The driver-side twin of :func:`bigram_buckets` for one query text."""
    t = (prefix + text).lower()
    v = np.zeros(dim)
    for i in range(max(len(t) - 1, 1)):
        v[int(hashlib.sha256(t[i : i + 2].encode()).hexdigest()[:8], 16) % dim] += 1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def dedup_hybrid(lexical: DataFrame, semantic: DataFrame, w_lex: float = 0.5, w_sem: float = 0.5, k: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of two (id, rank) lists by a full outer join; no weight gives no rows."""
    total = w_lex + w_sem
    if total == 0:
        return lexical.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    a, b = lexical.select("id", F.col("rank").alias("r1")), semantic.select("id", F.col("rank").alias("r2"))
    score = F.coalesce(F.lit(w_lex / total) / (k + F.col("r1")), F.lit(0.0)) + F.coalesce(F.lit(w_sem / total) / (k + F.col("r2")), F.lit(0.0))
    return a.join(b, "id", "full_outer").select("id", score.alias("score"))
