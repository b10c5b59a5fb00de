"""Instants as (seconds, nanos): a lenient parser for ordering and a strict one for search bounds."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_LENIENT = r"\A(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(Z|z|[+-]\d{2}:?\d{2})?\z"
_STRICT = r"\A(\d{4})-?(\d{2})-?(\d{2})[Tt](\d{2}):?(\d{2}):?(\d{2})(?:\.(\d+))?(Z|z|[+-]\d{2}:?\d{2})\z"


def _parse(c: Column, pattern: str) -> Column:
    g = [F.regexp_extract(c, pattern, i) for i in range(1, 9)]
    date = F.concat_ws("-", g[0], g[1], g[2]).try_cast("date")
    h, m, s = g[3].try_cast("int"), g[4].try_cast("int"), F.when(g[5] == "", F.lit(0)).otherwise(g[5].try_cast("int"))
    off = F.regexp_replace(g[7], "[^0-9]", "")
    oh, om = F.substring(off, 1, 2).try_cast("int"), F.substring(off, 3, 2).try_cast("int")
    shift = F.when(off == "", F.lit(0)).when((oh <= 23) & (om <= 59), F.when(g[7].startswith("-"), -1).otherwise(1) * (oh * 3600 + om * 60))
    seconds = F.unix_date(date).cast("bigint") * 86400 + h * 3600 + m * 60 + s - shift
    nanos = F.rpad(F.substring(g[6], 1, 9), 9, "0").try_cast("int")
    ok = c.rlike(pattern) & (h <= 23) & (m <= 59) & (s <= 59) & seconds.isNotNull()
    return F.when(ok, F.struct(seconds.alias("seconds"), F.coalesce(nanos, F.lit(0)).alias("nanos")))


def lenient(c: Column) -> Column:
    """ISO 8601 instant; a missing zone means UTC, digits below a nanosecond are ignored. Null if not a time."""
    return _parse(c, _LENIENT)


def strict(c: Column) -> Column:
    """Search bound: needs a zone, allows the compact form, refuses non-zero digits below a nanosecond."""
    fine = F.regexp_extract(c, _STRICT, 7)
    return F.when(~F.substring(fine, 10, 1000).rlike("[1-9]"), _parse(c, _STRICT))


def order_class(raw: Column) -> Column:
    """0 missing, 1 not a time, 2 a time."""
    return F.when(raw.isNull(), 0).when(lenient(raw).isNull(), 1).otherwise(2)


def order_key(raw: Column) -> Column:
    """Sort key under which missing < invalid (by bytes) < valid (by instant)."""
    t = lenient(raw)
    return F.struct(order_class(raw).alias("class"), F.when(t.isNull(), raw).alias("raw"), t["seconds"].alias("seconds"), t["nanos"].alias("nanos"))


def to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def relative(text: str, now: datetime) -> datetime | None:
    """``Nh``, ``Nd`` or ``Nw`` before the injected clock; null for anything else or N of zero."""
    m = re.fullmatch(r"([1-9]\d{0,5})([hdw])", text)
    if not m:
        return None
    return now.astimezone(UTC) - timedelta(hours=int(m[1]) * {"h": 1, "d": 24, "w": 168}[m[2]])
