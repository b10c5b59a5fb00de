"""Rank signals, total order, grouping by session and greedy budgets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.ranks import running_sum

#: Fixed values of the final lexical score.
UNIT = 1.0 / 61.0
HALF_LIFE_DAYS, FLOOR = 30.0, 0.3
SIDECHAIN_COST, REPO_GAIN = 0.25, 0.5


def recency(ts: Column, now: datetime | Column) -> Column:
    """max(0.3, 0.5 ** (age in days / 30)); the future and missing times count as age zero."""
    at = now if isinstance(now, Column) else F.lit(now)
    age = F.greatest(F.lit(0.0), (F.unix_micros(at.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))).cast("double") / 86400e6)
    return F.greatest(F.lit(FLOOR), F.pow(F.lit(0.5), F.coalesce(age, F.lit(0.0)) / HALF_LIFE_DAYS))


def final_score(rel: Column, ts: Column, now: datetime | Column, sidechain: Column, in_repo: Column) -> Column:
    s = rel * recency(ts, now)
    s = s - F.when(F.coalesce(sidechain, F.lit(False)), SIDECHAIN_COST * UNIT).otherwise(0.0) + F.when(F.coalesce(in_repo, F.lit(False)), REPO_GAIN * UNIT).otherwise(0.0)
    return F.when(rel.isNull() | F.isnan(rel) | (rel <= 0), F.lit(0.0)).otherwise(F.greatest(s, F.lit(0.0)))


def total_order(df: DataFrame, score: str = "score", id_col: str = "id") -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(id_col))


def best_of_session(hits: DataFrame, score: str = "score", session: str = "session_id", id_col: str = "id") -> DataFrame:
    """Best hit of each session with the number of hits it stands for; hits without a session stand alone."""
    group = F.coalesce(F.col(session).cast("string"), F.concat(F.lit("\u0000"), F.col(id_col).cast("string")))
    order = F.struct((-F.col(score)).alias("s"), F.col(id_col).alias("i"))  # the total order: score desc, id asc
    best = F.min_by(F.struct(*[F.col(c) for c in hits.columns]), order)
    return hits.groupBy(group.alias("_g")).agg(best.alias("h"), F.count(F.lit(1)).alias("occurrences")).select("h.*", "occurrences")


def within_budget(df: DataFrame, cost: Column, budget: int, order: list, max_items: int | None = None, groups: list[str] | None = None, slice_: Column | None = None) -> DataFrame:
    """The longest prefix, in the given order, whose costs stay within the budget; a first row beyond it gives nothing.

    Without groups the item cap is cut first (a top-k over sorted partitions), so one task sees at most ``max_items`` rows.
    With ``slice_``, a column that does not fall along the order, costs of a group are summed slice by slice and no group
    is sorted in one task.
    """
    d = df.withColumn("_cost", cost)
    if slice_ is not None:
        if max_items is not None:
            d = running_sum(d, groups or [], order, F.lit(1).cast("bigint"), slice_, "_i").where(F.col("_i") <= max_items).drop("_i")
        d = running_sum(d, groups or [], order, F.col("_cost"), slice_, "used")
        return d.where(F.col("used") <= budget).drop("_cost")
    if max_items is not None and not groups:
        d = d.orderBy(*order).limit(max_items)
    w = Window.partitionBy(*(groups or [F.lit(1)])).orderBy(*order)
    d = d.withColumn("_sum", F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if groups and max_items is not None:
        d = d.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= max_items).drop("_i")
    return d.where(F.col("_sum") <= budget).withColumnRenamed("_sum", "used").drop("_cost")


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
