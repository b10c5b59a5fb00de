"""Point look-ups and batch joins that keep the order and the misses of their request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get_many(df: DataFrame, ids: list, id_col: str) -> DataFrame:
    """(pos, id, row columns): one row for each requested id, in order, repeated ids repeated, misses with nulls."""
    kind = dict(df.dtypes)[id_col]
    want = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos int, want {kind}")
    rest = [c for c in df.columns if c != id_col]
    # the request is a literal list of the caller; the filter prunes the scan before the join
    found = df.where(F.col(id_col).isin(list(set(ids)))) if ids else df.where(F.lit(False))
    return want.join(found, want["want"] == found[id_col], "left").select("pos", F.col("want").alias(id_col), found[id_col].isNotNull().alias("found"), *rest)


def least_of(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Least value of each key, e.g. the session a message counts for."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(name))


def first_placement(placements: DataFrame, key: str = "message_id", by: str = "source_document_id") -> DataFrame:
    """The whole placement of each message in its least document."""
    rest = [c for c in placements.columns if c != key]
    return placements.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(by, *[c for c in rest if c != by])).alias("p")).select(key, "p.*")


def contexts(placements: DataFrame, key: str, session: str, placement: str) -> DataFrame:
    """(key, session, placement ids sorted): every session a message occurs in."""
    return placements.groupBy(key, session).agg(F.sort_array(F.collect_set(placement)).alias("placements"))


def attach(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Batch left join of facts, one row for each key at most; rows without facts keep nulls."""
    return df.join(facts, key, "left")


def both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of either side without a partner: (key, side)."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    j = x.join(y, key, "full_outer").where(F.col("in_a").isNull() | F.col("in_b").isNull())
    return j.select(key, F.when(F.col("in_b").isNull(), "missing_right").otherwise("missing_left").alias("side"))
