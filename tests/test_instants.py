from datetime import UTC, datetime

import pytest

from weftline.operators import instants


@pytest.fixture(scope="module")
def installations(spark):
    rows = [("b", "Europe/Berlin", "de-DE"), ("n", "America/New_York", "en-US"), ("k", "Asia/Kathmandu", "en-GB"), ("s", "Asia/Shanghai", "zh-CN"), ("u", "Etc/UTC", "en-US"), ("x", None, None)]
    return spark.createDataFrame(rows, "install_id string, tz_name string, locale_tag string")


def us(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp() * 1_000_000)


CASES = [
    ("2026-01-02T03:04:05Z", None, us(2026, 1, 2, 3, 4, 5)), (" 2026-01-02T03:04:05.123Z", None, us(2026, 1, 2, 3, 4, 5) + 123000), ("2026-01-02T03:04:05.123456789Z", None, us(2026, 1, 2, 3, 4, 5) + 123456),
    ("2026-01-02 03:04:05+05:30", None, us(2026, 1, 1, 21, 34, 5)), ("2026-01-02T03:04:05-0700", "b", us(2026, 1, 2, 10, 4, 5)), ("2026-07-02 12:00", "b", us(2026, 7, 2, 10)), ("2026-07-02 12:00", None, None), ("2026-07-02 12:00", "x", None),
    ("2026-03-29 02:30:00", "b", None), ("2026-10-25 02:30:00", "b", None), ("2026-10-25 02:30:00 CEST", "b", us(2026, 10, 25, 0, 30)), ("2026-10-25 02:30:00 CET", "b", us(2026, 10, 25, 1, 30)), ("2026-01-05 10:00:00 CST", "s", us(2026, 1, 5, 2)),
    ("07/10/2026 00:36:29", "n", us(2026, 7, 10, 4, 36, 29)), ("07/10/2026 00:36:29", "k", us(2026, 10, 6, 18, 51, 29)), ("25/12/2026 10:00:00", "n", us(2026, 12, 25, 15)), ("31.12.2026 23:59:59", "b", us(2026, 12, 31, 22, 59, 59)),
    ("1757986315", None, 1757986315_000000), ("1757986315.5", None, 1757986315_500000), ("1757986315123", None, 1757986315_123000), ("1757986315123456", None, 1757986315_123456), ("1757986315123456789", None, 1757986315_123456),
    ("20260516120513", "u", us(2026, 5, 16, 12, 5, 13)), ("20260910T213435Z", None, us(2026, 9, 10, 21, 34, 35)), ("Sat, 23 May 2026 02:33:51 +0200", None, us(2026, 5, 23, 0, 33, 51)), ("Tue Sep 29 00:35:21 EDT 2026", "n", us(2026, 9, 29, 4, 35, 21)),
    ("Jun 22, 2026 12:31:14 AM", "u", us(2026, 6, 22, 0, 31, 14)), ("Jun 22, 2026 13:31:14 PM", "u", None), ("2026年4月4日 下午6:53:55", "s", us(2026, 4, 4, 10, 53, 55)), ("2026-07-17T23:11:04[America/New_York]", None, us(2026, 7, 18, 3, 11, 4)),
    ("2026-07-17T23:11:04+02:00[Europe/Berlin]", None, us(2026, 7, 17, 21, 11, 4)), ("2026-02-30 10:00:00", "b", None), ("2026-01-01T24:00:00Z", None, None), ("2026-01-01T10:60:00Z", None, None), ("2026-07", "b", None), ("T10:22:31Z", "b", None),
    ("yesterday 14:05", "b", None), ("", "b", None), (None, "b", None), ("n/a", "b", None), ("2026-01-02T03:04:05+99:00", "b", None), ("x" * 100000, "b", None),
]


def test_moments(spark, installations):
    df = spark.createDataFrame([(i, t, k, "clash") for i, (t, k, _) in enumerate(CASES)], "row_id bigint, timestamp_raw string, install_id string, tz_name string")
    got = {r.row_id: r.utc_micros for r in instants.normalise(df, installations).collect()}
    assert len(got) == len(CASES)
    for i, (t, k, want) in enumerate(CASES):
        assert got[i] == want, (t, k, got[i], want)


def test_canonical_rows_are_no_cases(spark, installations):
    df = spark.createDataFrame([(1, "2026-01-02T03:04:05.123Z", None), (2, "2026-01-02T03:04:05.123Z\n", None), (2, "2026-01-02T03:04:05.123Z\n", None)], "row_id bigint, timestamp_raw string, install_id string")
    assert sorted(r.row_id for r in instants.restated(df, installations).collect()) == [2, 2]


def test_empty(spark, installations):
    assert instants.restated(spark.createDataFrame([], "row_id bigint, timestamp_raw string, install_id string"), installations).count() == 0
    none = installations.where("false")
    df = spark.createDataFrame([(1, "2026-07-02 12:00", "b"), (2, "1757986315", "b")], "row_id bigint, timestamp_raw string, install_id string")
    assert [r.row_id for r in instants.restated(df, none).collect()] == [2]
