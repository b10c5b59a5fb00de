"""Dense numbering of rows inside groups, without ever sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import parts


def numbered(df: DataFrame, groups: list[str], key: str, name: str = "rank", salts: int | None = None) -> DataFrame:
    """Add ``name``: 0-based numbers that are dense and unique inside each group, in the order of a hash salt and then ``key``.

    A group is cut into ``salts`` slices (by default twice the shuffle partitions, at least 64) by a hash of ``key``; each slice is numbered by itself and starts where the
    slices before it end. The join of the slice starts uses the partitioning of the numbering, so rows move once.
    ``key`` should be unique; rows with equal keys get different numbers in no fixed order.
    """
    salts = salts or max(64, 2 * parts(df.sparkSession))
    d = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    slices = d.groupBy(*groups, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(*groups, "_salt").orderBy(key)
    d = d.withColumn("_own", F.row_number().over(own) - 1)
    cond = F.lit(True)
    s = starts.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_salt").alias("_g_salt"), "_start")
    for g in groups:
        cond = cond & d[g].eqNullSafe(s[f"_g_{g}"])
    out = d.join(s, cond & (d["_salt"] == s["_g_salt"]), "left")
    return out.withColumn(name, F.col("_start") + F.col("_own")).drop("_salt", "_own", "_start", "_g_salt", *[f"_g_{g}" for g in groups])


def running_sum(df: DataFrame, groups: list[str], order: list[str], value: Column, slice_: Column, name: str = "running") -> DataFrame:
    """Add ``name``: the sum of ``value`` over a group's rows up to each row in ``order``, itself included.

    ``slice_`` must not fall along the order (a day of a time, a stretch of numbers): slices are summed by themselves,
    start where the slices before them end, and a group of any size is never sorted in one task. Rows equal in
    ``order`` count in no fixed order.
    """
    d = df.withColumns({"_slice": slice_, "_value": value})
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(*groups, "_slice").agg(F.sum("_value").alias("_s")).select(*groups, "_slice", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*groups, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_own", F.sum("_value").over(own))
    keys = [*groups, "_slice"]
    s = starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_start")
    cond = F.lit(True)
    for k in keys:
        cond = cond & d[k].eqNullSafe(s[f"_k_{k}"])
    return d.join(s, cond, "left").withColumn(name, F.col("_start") + F.coalesce("_own", F.lit(0))).drop("_slice", "_value", "_own", "_start", *[f"_k_{k}" for k in keys])
