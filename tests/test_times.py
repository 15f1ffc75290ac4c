import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedloom.functions.times import comment_time, duration_string, parse_duration, parse_feed_time, published_time


def _utc(*a):
    return dt.datetime(*a)


@pytest.mark.parametrize("raw,want", [
    ("2026-05-20T10:00:00Z", _utc(2026, 5, 20, 10)),
    ("2026-05-20T10:00:00.123456789+09:00", _utc(2026, 5, 20, 1, 0, 0, 123456)),
    ("Wed, 20 May 2026 10:00:00 +0900", _utc(2026, 5, 20, 1)),
    ("Wed, 20 May 2026 10:00:00 GMT", _utc(2026, 5, 20, 10)),
    ("20 May 26 10:00 -0100", _utc(2026, 5, 20, 11)),
    ("20 May 99 10:00 UTC", _utc(1999, 5, 20, 10)),
    ("2026-05-20 10:00:00", _utc(2026, 5, 20, 10)),
    ("2026-05-20", _utc(2026, 5, 20)),
    ("T12:00", None),
    ("2026", None),
    ("yesterday", None),
])
def test_parse_feed_time(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "s string").select(parse_feed_time(F.col("s")).alias("t")).first().t
    assert got == want


def test_published_order_fallbacks(spark, make_items):
    t = dt.datetime(2026, 5, 20, 10)
    df = make_items(dict(published_at=t), dict(updated_at=t), dict(published_raw="2026-05-20T10:00:00Z"),
                    dict(updated_raw="Wed, 20 May 2026 10:00:00 +0000"), dict(published_raw="invalid"), dict())
    got = [r.p for r in df.select(published_time(df).alias("p")).orderBy("pos").collect()]
    assert got == [t, t, t, t, None, None]


def test_comment_time(spark):
    df = spark.createDataFrame([("2026/05/20 12:01",), ("not a timestamp",), ("",)], "s string")
    got = [r.t for r in df.select(comment_time(F.col("s")).alias("t")).collect()]
    assert got == [dt.datetime(2026, 5, 20, 12, 1), None, None]


def test_durations():
    assert parse_duration("24h") == 24 * 3600 * 10**9
    assert parse_duration("1h30m") == 5400 * 10**9
    assert parse_duration("1.5s") == 1_500_000_000
    with pytest.raises(ValueError):
        parse_duration("")
    with pytest.raises(ValueError):
        parse_duration("10 parsecs")
    assert duration_string(parse_duration("24h")) == "24h0m0s"
    assert duration_string(parse_duration("90m")) == "1h30m0s"
    assert duration_string(parse_duration("10s")) == "10s"
    assert duration_string(parse_duration("1.5s")) == "1.5s"
    assert duration_string(parse_duration("500ms")) == "500ms"
    assert duration_string(0) == "0s"
