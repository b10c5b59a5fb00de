"""The interval table against zoneinfo, at both sides of every change of every zone."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import functions as F

from weftline.functions import zones
from weftline.operators import instants

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
FIRST, LAST = datetime(1, 1, 3, tzinfo=UTC), datetime(9999, 12, 29, tzinfo=UTC)


def test_every_change_of_every_zone():
    low, high = (int((x - EPOCH).total_seconds()) for x in (FIRST, LAST))
    n = 0
    for name in sorted(available_timezones()):
        tz, spans = ZoneInfo(name), zones.intervals(name)
        assert spans[0][0] == zones.EARLY and spans[-1][1] == zones.LATE and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        for begin, end, off, abbr in spans:
            for second in (begin, min(end, begin + 86400) - 1, end - 1):
                if low < second < high and not (end == zones.LATE and second == end - 1):
                    t = (EPOCH + timedelta(seconds=second)).astimezone(tz)
                    assert t.utcoffset() == timedelta(seconds=off), (name, second)
                    assert t.tzname() == abbr, (name, second)
                    n += 1
    assert n > 50_000


def test_close_changes_and_far_years(spark):
    inst = spark.createDataFrame([(z, z, "en-GB") for z in ("America/Recife", "Asia/Gaza", "America/Noronha", "Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "Pacific/Apia")], "install_id string, tz_name string, locale_tag string")
    texts = [f"{y:04d}-{m:02d}-{d:02d} {h:02d}:30:00" for y in (3, 1883, 1911, 1945, 1969, 1970, 2000, 2011, 2026, 2037, 2040, 2087, 2099, 2100, 2128, 2129, 2130, 2400, 4715, 9998) for m, d, h in ((1, 1, 0), (3, 28, 2), (4, 2, 1), (6, 30, 12), (10, 8, 3), (10, 15, 0), (10, 29, 2), (11, 1, 1), (12, 31, 23))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n bigint, timestamp_raw string").crossJoin(inst.select("install_id")).withColumn("row_id", F.col("n"))
    got = instants.normalise(df, inst, keep=("n", "install_id")).collect()
    assert len(got) == len(texts) * 8
    for r in got:
        naive, tz = datetime.fromisoformat(texts[r.n]), ZoneInfo(r.install_id)
        sides = {naive.replace(tzinfo=tz, fold=f).utcoffset() for f in (0, 1)}
        back = {o for o in sides if (naive.replace(tzinfo=UTC) - o).astimezone(tz).replace(tzinfo=None) == naive}
        want = int((naive.replace(tzinfo=UTC) - EPOCH - next(iter(back))) / timedelta(microseconds=1)) if len(back) == 1 else None
        assert r.utc_micros == want, (texts[r.n], r.install_id, r.utc_micros, want)
