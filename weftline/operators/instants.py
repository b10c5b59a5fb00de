"""Problem 2: one UTC moment from many ways of writing a time.

Texts are parsed by JVM regular expressions into wall-clock parts and, where written, an offset, a zone
abbreviation or a zone name. Texts that need a zone are joined as of their local time to the zone-offset
intervals, exploded by (zone, local year): two intervals that hold the local time mean it is ambiguous, none
that it does not exist, one gives the offset. The interval table is read from the zone files, has no limit of years
and is bounded by the IANA list (see :mod:`weftline.functions.zones`), so it is broadcast and the big table is never shuffled or sorted.

Defined results: null and blank texts, texts without a date or a time of day, dates and times that do not
exist (hour 24 and second 60 included), and texts that need an installation which is null or unknown give null.
A written offset or epoch number holds whatever the zone; of a zone name beside an offset the offset holds. An
abbreviation takes the offset it has in the installation's zone in that year, UTC and GMT are zero everywhere.
Fractions below a microsecond are cut. Repeated rows give their rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.zones import interval_table, table_year
from weftline.session import spread

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
#: Locales that write the month before the day; all others write the day first.
MONTH_FIRST = ("en-US", "en-PH", "fil-PH", "es-US", "en-PR", "es-PR")
#: Month names by their first three letters (English, German, French where unambiguous).
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "mär": 3, "mai": 5, "okt": 10, "dez": 12}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"([Zz]|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5}|[+-]\d{4})?"
#: (pattern, template). A template gives order|a|b|c|h|m|s|fraction|half of day|zone|zone name, where order names a, b and c.
_SHAPES = [
    (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:[Tt]|\s+){_TIME}\s*{_ZONE}(?:\[([A-Za-z_+\-0-9/]+)\])?$", "ymd|$1|$3|$4|$5|$6|$7|$8||$9|$10"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt]?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?([Zz]|[+-]\d{2}:?\d{2})?$", "ymd|$1|$2|$3|$4|$5|$6|$7||$8|"),
    (rf"^(?:[A-Za-z]{{3,9}}\.?,?\s+)?(\d{{1,2}})\.?[\s-]+(\p{{L}}{{3,9}})\.?[\s-]+(\d{{4}}),?\s+{_TIME}\s*([AaPp]\.?[Mm]\.?)?\s*{_ZONE}$", "dMy|$1|$2|$3|$4|$5|$6|$7|$8|$9|"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\p{{L}}{{3,9}})\.?\s+(\d{{1,2}})\s+{_TIME}\s+{_ZONE}\s*(\d{{4}})$", "Mdy|$1|$2|$8|$3|$4|$5|$6||$7|"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\p{{L}}{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+(?:at\s+)?{_TIME}\s*([AaPp]\.?[Mm]\.?)?\s*{_ZONE}$", "Mdy|$1|$2|$3|$4|$5|$6|$7|$8|$9|"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{_TIME}\s*([AaPp]\.?[Mm]\.?)?\s*{_ZONE}$", "??y|$1|$2|$3|$4|$5|$6|$7|$8|$9|"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_TIME}\s*{_ZONE}$", "dmy|$1|$2|$3|$4|$5|$6|$7||$8|"),
    (rf"^(\d{{1,2}})-(\d{{1,2}})-(\d{{4}}),?\s+{_TIME}\s*([AaPp]\.?[Mm]\.?)?\s*{_ZONE}$", "??y|$1|$2|$3|$4|$5|$6|$7|$8|$9|"),
    (rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})[日号]\s*(上午|下午|凌晨|早上|中午|晚上)?\s*{_TIME}\s*{_ZONE}$", "ymd|$1|$2|$3|$5|$6|$7|$8|$4|$9|"),
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})[日号]\s*(上午|下午|凌晨|早上|中午|晚上)?\s*(\d{1,2})[时点](\d{1,2})分(?:(\d{1,2})秒)?$", "ymd|$1|$2|$3|$5|$6|$7||$4||"),
]
_NUMBER = r"^[+-]?\d{9,11}(?:[.,]\d+)?$|^\d{13}(?:\.\d+)?$|^\d{16}$|^\d{19}$"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def parse(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``p``: struct(local_us, utc_us, offset_s, abbr, zone, a, b, need_order, ...) of the text; null if no time."""
    t = F.regexp_replace(F.btrim(F.col(text_col), F.lit(" \t\r\n ﻿​　\"'`")), r"\s+", " ")
    d = df.withColumn("_t", t)
    shape = F.lit(None).cast("string")
    for pattern, template in reversed(_SHAPES):
        shape = F.when(F.col("_t").rlike(pattern), F.regexp_replace("_t", pattern, template)).otherwise(shape)
    d = d.withColumn("_f", F.when(~F.col("_t").rlike(_NUMBER), F.split(shape, r"\|", -1)))
    # epoch numbers: seconds, milli-, micro- or nanoseconds by their number of digits
    whole = F.regexp_extract("_t", r"^([+-]?\d+)", 1)
    part = F.rpad(F.regexp_extract("_t", r"[.,](\d+)$", 1), 6, "0")
    digits = F.length(F.regexp_replace(whole, r"^[+-]", ""))
    w = whole.try_cast("bigint")
    epoch = F.when(
        F.col("_t").rlike(_NUMBER),
        F.when(digits <= 11, w * 1000000 + F.when(whole.startswith("-"), -1).otherwise(1) * F.coalesce(part.try_cast("bigint"), F.lit(0)))
        .when(digits == 13, w * 1000 + F.coalesce(F.rpad(F.regexp_extract("_t", r"[.,](\d+)$", 1), 3, "0").try_cast("bigint"), F.lit(0)))
        .when(digits == 16, w)
        .otherwise(F.expr("try_cast(substring(_t, 1, length(_t) - 3) as bigint)")),
    )
    return d.withColumn("_epoch", epoch)


def normalise(
    df: DataFrame,
    installations: DataFrame,
    text_col: str = "timestamp_raw",
    install_col: str = "install_id",
    keep: tuple[str, ...] = ("row_id",),
    zones: DataFrame | None = None,
) -> DataFrame:
    """Columns ``keep`` plus utc_micros (null where the text settles no moment) and status:
    'utc', 'offset', 'zone', 'abbreviation', 'ambiguous', 'nonexistent', 'unplaced' (needs an installation) or 'unreadable'.

    ``installations`` (install_id, tz_name, locale_tag) is a dimension of fixed size; its join keeps every row.
    """
    spark = df.sparkSession
    own = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)], F.col(text_col).alias("_text"), F.col(install_col).alias("_install"))
    own = spread(own)
    inst = installations.select(F.col("install_id").alias("_install"), "tz_name", "locale_tag").dropDuplicates(["_install"])
    d = parse(own, "_text").join(F.broadcast(inst), "_install", "left")
    f = [F.get("_f", F.lit(i)) for i in range(11)]
    order = f[0]
    n1, n2 = _int(f[1]), _int(f[2])
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month_first = F.when((n1 > 12) & (n2 <= 12), F.lit(False)).when((n2 > 12) & (n1 <= 12), F.lit(True)).otherwise(F.col("locale_tag").isin(*MONTH_FIRST))
    year = F.when(order == "ymd", n1).otherwise(_int(f[3]))
    month = (
        F.when(order == "ymd", n2).when(order == "dmy", n2).when(order == "dMy", F.try_element_at(months, F.lower(F.substring(f[2], 1, 3))))
        .when(order == "Mdy", F.try_element_at(months, F.lower(F.substring(f[1], 1, 3)))).otherwise(F.when(month_first, n1).otherwise(n2))
    )
    day = F.when(order == "ymd", _int(f[3])).when(order.isin("dmy", "dMy"), n1).when(order == "Mdy", n2).otherwise(F.when(month_first, n2).otherwise(n1))
    half = F.lower(F.regexp_replace(f[8], r"\.", ""))
    h0 = _int(f[4])
    latin = half.isin("am", "pm")
    hour = (
        F.when(latin & ((h0 < 1) | (h0 > 12)), F.lit(None).cast("int"))
        .when(half == "am", h0 % 12).when(half == "pm", h0 % 12 + 12)
        .when(half.isin("下午", "晚上") & (h0 < 12), h0 + 12)
        .when(half.isin("上午", "凌晨", "早上") & (h0 == 12), F.lit(0))
        .when((half == "中午") & (h0 < 11), h0 + 12)
        .otherwise(h0)
    )
    minute = _int(f[5])
    second = F.when(F.coalesce(f[6], F.lit("")) == "", F.lit(0)).otherwise(_int(f[6]))
    frac = F.rpad(F.substring(F.coalesce(f[7], F.lit("")), 1, 6), 6, "0").try_cast("bigint")
    date = F.when(order.isNotNull(), F.format_string("%04d-%02d-%02d", year, month, day)).try_cast("date")
    local = F.when(
        (hour <= 23) & (minute <= 59) & (second <= 59),
        F.unix_date(date).cast("bigint") * 86400000000 + (hour * 3600 + minute * 60 + second).cast("bigint") * 1000000 + frac,
    )
    z = f[9]
    sign = F.when(z.startswith("-"), -1).otherwise(1)
    zd = F.regexp_replace(z, r"[^0-9]", "")
    oh, om = _int(F.substring(zd, 1, 2)), F.coalesce(_int(F.substring(zd, 3, 2)), F.lit(0))
    offset = F.when(z.rlike("^[Zz]$") | z.isin("UTC", "GMT", "UT"), F.lit(0)).when(z.rlike(r"^[+-]"), F.when((oh <= 18) & (om <= 59), sign * (oh * 3600 + om * 60)))
    abbr = F.when(z.rlike("^[A-Z]{2,5}$") & ~z.isin("UTC", "GMT", "UT"), z)
    d = d.withColumns({"_local": local, "_offset": offset, "_abbr": abbr, "_zone": F.coalesce(F.when(f[10] != "", f[10]), F.col("tz_name")), "_badoff": z.rlike(r"^[+-]") & offset.isNull()})
    fixed = F.coalesce(F.col("_epoch"), F.col("_local") - F.col("_offset").cast("bigint") * 1000000)
    need = F.col("_epoch").isNull() & F.col("_local").isNotNull() & F.col("_offset").isNull() & ~F.coalesce(F.col("_badoff"), F.lit(False))
    # as-of join on (zone, local year); rows that need no zone carry a null key and match nothing
    year, shift = table_year(F.col("_local"))
    d = d.withColumns({"_fixed": fixed, "_need": need, "tz": F.when(need, F.col("_zone")), "local_year": F.when(need, year), "_at": F.col("_local") + shift})
    table = interval_table(spark, zones)
    d = d.join(F.broadcast(table), ["tz", "local_year"], "left")
    hits = F.filter("spans", lambda s: (s["begin"] <= F.col("_at")) & (F.col("_at") < s["end"]) & (F.col("_abbr").isNull() | (s["abbr"] == F.col("_abbr"))))
    named = F.array_distinct(F.transform(F.filter("spans", lambda s: s["abbr"] == F.col("_abbr")), lambda s: s["offset_s"]))
    d = d.withColumns({"_hits": hits, "_named": named})
    zoned = (
        F.when(F.size("_hits") == 1, F.get(F.transform("_hits", lambda s: s["offset_s"]), F.lit(0)))
        .when(F.col("_abbr").isNotNull() & (F.size("_named") == 1), F.get("_named", F.lit(0)))
    )
    utc = F.coalesce(F.col("_fixed"), F.col("_local") - zoned.cast("bigint") * 1000000)
    status = (
        F.when(F.col("_epoch").isNotNull(), "utc")
        .when(F.col("_fixed").isNotNull(), "offset")
        .when(~F.col("_need"), "unreadable")
        .when(F.col("spans").isNull(), "unplaced")
        .when(utc.isNotNull(), F.when(F.col("_abbr").isNotNull(), "abbreviation").otherwise("zone"))
        .when(F.size("_hits") > 1, "ambiguous")
        .otherwise("nonexistent")
    )
    return d.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], utc.alias("utc_micros"), F.coalesce(status, F.lit("unreadable")).alias("status"))


def restated(df: DataFrame, installations: DataFrame, text_col: str = "timestamp_raw", id_col: str = "row_id", install_col: str = "install_id", zones: DataFrame | None = None) -> DataFrame:
    """(row_id, utc_micros) of every row whose text is not already canonical and denotes one moment."""
    odd = df.where(F.col(text_col).isNotNull() & ~F.col(text_col).rlike(CANONICAL[:-1] + r"\z"))
    return normalise(odd, installations, text_col, install_col, (id_col,), zones).where(F.col("utc_micros").isNotNull()).select(F.col(id_col).cast("bigint").alias("row_id"), F.col("utc_micros").cast("bigint").alias("utc_micros"))
