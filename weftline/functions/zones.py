"""Zone-offset intervals of the IANA zones, read from the compiled zone files, and their explosion by local year.

A zone file lists every change of offset it knows and ends with a rule for all later years. Both are read as they
are, so no change is missed however close it lies to the next. The table needs no limit of years: everything before
``FIRST_YEAR`` is one row a zone, and as the rule of a zone depends only on the calendar, a year after ``LAST_YEAR`` is
looked up under a year of the same calendar (:func:`table_year`).
"""

from __future__ import annotations

import os
import re
import struct
import zoneinfo
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Years with rows of their own. The last 28 hold each calendar (leap or not, first day of the week) twice or more and
#: lie behind all changes that zone files list one by one (2087). They set the size: about 600 zones x 160 years.
FIRST_YEAR, LAST_YEAR = 1970, 2128
EARLY, LATE = -(1 << 40), 1 << 40
_DAY = 86400
_YEAR0 = np.datetime64("1970-01-01")


def zone_file(name: str) -> bytes:
    for root in zoneinfo.TZPATH:
        path = os.path.join(root, name)
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    try:
        from importlib import resources

        return resources.files("tzdata.zoneinfo").joinpath(*name.split("/")).read_bytes()
    except (ImportError, OSError, ValueError) as e:
        raise KeyError(f"no zone {name}") from e


def _listed(data: bytes) -> tuple[list[int], list[tuple[int, str]], tuple[int, str], str]:
    """Listed changes (UTC seconds), the (offset, abbreviation) each brings, the one before them, and the rule."""
    if data[:4] != b"TZif":
        raise KeyError("no zone file")
    wide = data[4:5] >= b"2"
    at = 0
    for step in (4, 8)[: 1 + wide]:
        n_ut, n_std, n_leap, n_time, n_type, n_char = struct.unpack(">6l", data[at + 20 : at + 44])
        at += 44
        if step == 4 and wide:
            at += n_time * 5 + n_type * 6 + n_char + n_leap * 8 + n_std + n_ut
            continue
        times = list(struct.unpack(f">{n_time}{'q' if step == 8 else 'l'}", data[at : at + n_time * step]))
        at += n_time * step
        index = data[at : at + n_time]
        at += n_time
        kinds = [struct.unpack(">lBB", data[at + 6 * i : at + 6 * i + 6]) for i in range(n_type)]
        at += n_type * 6
        chars = data[at : at + n_char]
        at += n_char + n_leap * (step + 4) + n_std + n_ut
    named = [(off, chars[i : chars.index(b"\0", i)].decode()) for off, _, i in kinds]
    return times, [named[i] for i in index], named[0], data[at:].strip(b"\n").decode() if wide else ""


_RULE = re.compile(r"(<[^>]+>|[A-Za-z]+)([+-]?[\d:]+)(?:(<[^>]+>|[A-Za-z]+)([+-]?[\d:]+)?,([^,]+),([^,]+))?$")


def _seconds(text: str) -> int:
    h, m, s = ([int(x) for x in text.lstrip("+-").split(":")] + [0, 0])[:3]
    return (-1 if text.startswith("-") else 1) * (h * 3600 + m * 60 + s)


def _on(rule: str, year: int) -> int:
    """Local seconds since 1970 at which a rule such as ``M3.5.0/2`` falls in a year."""
    day, _, time = rule.partition("/")
    first = date(year, 1, 1).toordinal()
    if day[0] == "M":
        month, week, weekday = map(int, day[1:].split("."))
        begin = date(year, month, 1).toordinal()
        end = date(year + month // 12, month % 12 + 1, 1).toordinal()
        got = begin + (weekday - begin % 7) % 7 + 7 * (week - 1)
        while got >= end:
            got -= 7
    elif day[0] == "J":
        n, leap = int(day[1:]), date(year, 12, 31).toordinal() - first == 365
        got = first + n - 1 + (leap and n >= 60)
    else:
        got = first + int(day)
    return (got - date(1970, 1, 1).toordinal()) * _DAY + (_seconds(time) if time else 7200)


@lru_cache(maxsize=1024)
def intervals(name: str, last: int = LAST_YEAR) -> tuple[tuple[int, int, int, str], ...]:
    """(UTC start, UTC end, offset, abbreviation) in seconds; half open, without gaps, from EARLY to LATE.
    Changes by rule are written out up to the year after ``last``."""
    times, after, before, rule = _listed(zone_file(name))
    starts, kinds = [EARLY, *times], [before, *after]
    m = _RULE.match(rule)
    if m:
        std = (-_seconds(m[2]), m[1].strip("<>"))
        if not m[3]:
            if not times:
                kinds[0] = std
        else:
            dst = (-_seconds(m[4]) if m[4] else std[0] + 3600, m[3].strip("<>"))
            since = int(str(_YEAR0 + np.timedelta64(times[-1] // _DAY, "D"))[:4]) if times else FIRST_YEAR - 1
            ruled = sorted(x for y in range(since, last + 2) for x in ((_on(m[5], y) - std[0], dst), (_on(m[6], y) - dst[0], std)))
            for t, kind in ruled:
                if not times or t > times[-1]:
                    starts.append(t)
                    kinds.append(kind)
    out: list[tuple[int, int, int, str]] = []
    for t, e, kind in zip(starts, [*starts[1:], LATE], kinds):
        if out and out[-1][2:] == kind:
            out[-1] = (out[-1][0], e, *kind)
        elif e > t:
            out.append((t, e, *kind))
    return tuple(out)


def _calendars() -> dict[int, int]:
    """Calendar (2 x weekday of the first of January + leap) -> a year of it between LAST_YEAR - 27 and LAST_YEAR."""
    out = {}
    for y in range(LAST_YEAR - 27, LAST_YEAR + 1):
        d = date(y, 1, 1)
        out[2 * d.weekday() + (date(y, 12, 31) - d).days - 364] = y
    return out


def table_year(local_us: Column) -> tuple[Column, Column]:
    """The year under which a local time is looked up, and the microseconds to add to it there."""
    year = F.year(F.timestamp_micros(local_us))
    first = F.make_date(year, F.lit(1), F.lit(1))
    leap = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) - 365
    like = F.try_element_at(F.create_map(*[F.lit(x) for kv in _calendars().items() for x in kv]), 2 * F.weekday(first) + leap)
    far = year > LAST_YEAR
    shift = F.when(far, F.datediff(F.make_date(like, F.lit(1), F.lit(1)), first).cast("bigint") * (_DAY * 1_000_000)).otherwise(F.lit(0))
    return F.when(far, like).otherwise(F.greatest(year, F.lit(FIRST_YEAR - 1))), shift


def interval_table(spark: SparkSession, zones: DataFrame | None = None) -> DataFrame:
    """One row for each zone and local year: (tz, local_year, spans) with spans an array of
    (begin, end, offset_s, abbr), local wall-clock microseconds of the intervals that touch the year. The year before
    FIRST_YEAR stands for all earlier ones.

    ``zones`` has a column ``tz``; by default all IANA zones. The rows are made in tasks, not on the driver.
    """
    if zones is None:
        zones = spark.createDataFrame(pd.DataFrame({"tz": sorted(zoneinfo.available_timezones())}))
        zones = zones.repartition(max(2, spark.sparkContext.defaultParallelism))
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("offset_s", pa.int32()), ("abbr", pa.string())])
    years = np.arange(FIRST_YEAR - 1, LAST_YEAR + 1)
    new_year = (np.array([f"{y}-01-01" for y in [*years, LAST_YEAR + 1]], "datetime64[s]") - _YEAR0.astype("datetime64[s]")).astype(np.int64)
    opens, shuts = new_year[:-1].copy(), new_year[1:]
    opens[0] = EARLY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in dict.fromkeys(b.column(0).drop_null().to_pylist()):
                try:
                    begin, end, off, abbr = map(list, zip(*intervals(name)))
                except (KeyError, ValueError, OSError, IndexError, struct.error):
                    continue
                begin, end, off = (np.array(x, np.int64) for x in (begin, end, off))
                lo = np.searchsorted(end, opens - 2 * _DAY, "right")
                hi = np.maximum(np.searchsorted(begin, shuts + 2 * _DAY, "left"), lo)
                edges = np.concatenate([[0], np.cumsum(hi - lo)])
                pick = np.arange(edges[-1]) + np.repeat(lo - edges[:-1], hi - lo)
                cols = [pa.array(((begin + off) * 1_000_000)[pick]), pa.array(((end + off) * 1_000_000)[pick]), pa.array(off[pick].astype(np.int32)), pa.array(abbr, pa.string()).take(pa.array(pick))]
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays(cols, fields=list(span)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(years), pa.string()), pa.array(years.astype(np.int32)), lists], names=["tz", "local_year", "spans"])

    return zones.select("tz").mapInArrow(run, "tz string, local_year int, spans array<struct<begin:bigint,end:bigint,offset_s:int,abbr:string>>")
