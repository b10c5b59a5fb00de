"""Incremental reconciliation: what changed, what survives, what is withdrawn; and versioned commits of tables."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.aggregates import content_hash

PARSER_VERSION = 1


def classify(snap: DataFrame, state: DataFrame, force: bool = False, parser_version: int = PARSER_VERSION) -> DataFrame:
    """(path, ..., action): 'unchanged', 'parse', 'reparse' (older parser), 'withdraw' (known, now empty), 'skip' (empty, unknown).

    ``state``: path, fingerprint, parser_version of the last commit.
    """
    s = state.select("path", F.col("fingerprint").alias("old"), F.col("parser_version").alias("pv"))
    d = snap.join(s, "path", "left")
    action = (
        F.when(F.col("len") == 0, F.when(F.col("old").isNull(), "skip").otherwise("withdraw"))
        .when(F.col("old").isNull() | (F.col("old") != F.col("fingerprint")) | F.lit(force), "parse")
        .when(F.col("pv") < parser_version, "reparse")
        .otherwise("unchanged")
    )
    return d.withColumn("action", action).drop("old", "pv")


def retain_truncated(events: DataFrame, state: DataFrame) -> DataFrame:
    """Leave out known sources whose tail is cut off: what is indexed stays; unknown ones keep their valid prefix."""
    cut_off = events.where("health = 'partial'").select("path").distinct().join(state.select("path"), "path", "left_semi")
    return events.join(cut_off, "path", "left_anti")


def removed_sources(state: DataFrame, seen: DataFrame, complete: bool) -> DataFrame:
    """Known sources a complete scan did not find; an incomplete scan proves nothing."""
    return state.join(seen.select("path"), "path", "left_anti").select("path") if complete else state.where(F.lit(False)).select("path")


def tombstones(old_claims: DataFrame, new_claims: DataFrame, scanned: DataFrame) -> DataFrame:
    """(message_id): messages no source claims any more.

    Claims are (path, message_id). ``scanned`` is (path, complete): only a source that was read without skips
    withdraws claims, and a message survives as long as any other source claims it.
    """
    whole = scanned.where("complete").select("path")
    gone = old_claims.join(whole, "path", "left_semi").join(new_claims, ["path", "message_id"], "left_anti")
    stay = old_claims.join(gone, ["path", "message_id"], "left_anti").unionByName(new_claims).select("message_id")
    return gone.select("message_id").distinct().join(stay, "message_id", "left_anti")


def next_claims(old_claims: DataFrame, new_claims: DataFrame, scanned: DataFrame) -> DataFrame:
    whole = scanned.where("complete").select("path")
    kept = old_claims.join(whole, "path", "left_anti")
    return kept.unionByName(new_claims).dropDuplicates(["path", "message_id"])


def report(classified: DataFrame, events: DataFrame) -> DataFrame:
    """One row of counts of a run."""
    c = classified.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("action") == "unchanged").alias("unchanged"), F.count_if(F.col("action") == "withdraw").alias("withdrawn"))
    e = events.agg(F.count_if(F.col("event") == "message").alias("emitted"), F.coalesce(F.sum("committed"), F.lit(0)).alias("committed"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return c.join(e)


class Conflict(RuntimeError):
    """Another commit came first."""


class Store:
    """Versioned tables in a folder of any Hadoop file system that driver and executors share.

    A commit writes its tables to a folder of its own and then renames its manifest to ``manifests/<generation>.json``,
    which fails if that generation exists: of two commits that start from one generation the first wins and the other
    raises, without any lock that could be stolen or left behind. Readers resolve the highest manifest once. A crash
    leaves only a folder no manifest names, which ``vacuum`` removes. A commit that changes no table makes no generation.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    @property
    def generation(self) -> int:
        return max((int(n[:-5]) for n in self._names("manifests") if n.endswith(".json")), default=0)

    def manifest(self, generation: int | None = None) -> dict:
        g = self.generation if generation is None else generation
        if not g:
            return {"generation": 0, "tables": {}, "digests": {}, "projection_version": 1}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{g}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.manifest()['tables'][name]}")

    def commit(self, tables: dict[str, DataFrame], base: int, projection_version: int = 1) -> int:
        """Write and activate all tables or none; raises if the store moved on since ``base``. Returns the generation."""
        now = self.manifest()
        if now["generation"] != base:
            raise Conflict(f"the store is at generation {now['generation']}, not {base}")
        if not tables:
            return base
        folder = f"data/{base + 1}-{uuid.uuid4().hex}"
        out, digests = dict(now["tables"]), dict(now["digests"])
        for name, d in tables.items():
            d.write.parquet(f"{self.root}/{folder}/{name}")
            digest = content_hash({name: self.spark.read.parquet(f"{self.root}/{folder}/{name}")}).first()["digest"]
            if digests.get(name) != digest:
                out[name], digests[name] = f"{folder}/{name}", digest
        if digests == now["digests"] and projection_version == now["projection_version"]:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            return base
        temp = self._path(f"{self.root}/{folder}/_manifest")
        stream = self._fs.create(temp, True)
        stream.write(bytearray(json.dumps({"generation": base + 1, "tables": out, "digests": digests, "projection_version": projection_version}).encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(temp, self._path(f"{self.root}/manifests/{base + 1}.json"), none)
        except Py4JJavaError as e:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise Conflict(f"generation {base + 1} was committed by another writer") from e
        return base + 1

    def vacuum(self) -> list[str]:
        """Remove folders that no table of the present manifest lies in, and the manifests before it. Not to be run
        beside a commit."""
        now = self.manifest()
        used = {p.split("/")[1] for p in now["tables"].values()}
        gone = sorted(d for d in self._names("data") if d not in used)
        for d in gone:
            self._fs.delete(self._path(f"{self.root}/data/{d}"), True)
        for n in self._names("manifests"):
            if n.endswith(".json") and int(n[:-5]) < now["generation"]:
                self._fs.delete(self._path(f"{self.root}/manifests/{n}"), False)
        return gone

    def fresh(self, wanted: int) -> bool:
        """Projections are current; stale ones must be rebuilt before reading."""
        return self.manifest()["projection_version"] >= wanted
