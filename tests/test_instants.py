import random

import numpy as np
import pyarrow as pa
import pytest
from plain_instants import micros

from tallyforge.operators import instants

FEEDS = [(1, "America/New_York", "en_US"), (2, "Europe/Berlin", "de_DE"), (3, None, None), (4, "Asia/Kolkata", "en_IN"), (5, "Nowhere/Atall", "en_US"), (6, "Australia/Lord_Howe", "en_AU")]
ZONES = {f: (z if z != "Nowhere/Atall" else None, loc) for f, z, loc in FEEDS}
TEXTS = [
    None, "", " ", "-", "n/a", "not set", "2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-03-31T02:30:00", "2024-10-27 02:30:00.1234567", "2024-02-30", "2023-02-29 00:00:00", "2024-02-29",
    "20240229", "99999999", "1700000000", "1700000000123", "1700000000123456", "1700000000123456789", "999999999", "1100000000", "1767225599", "1767225600", "0000-00-00 00:00:00", "0001-01-01T00:00:00Z",
    "01/02/2024 03:04", "13/02/2024 03:04", "02/13/2024 03:04:05 PM", "1.2.2024 03:04", "12:00", "Jan 5, 2020 12:01 AM", "Jan 5, 2020 13:01 AM", "5 Feb 2020 01:02:03", "Tue, 05 Feb 2020 01:02:03 -0430",
    "2020-01-01 10:00:00 EST", "2020-01-01 10:00:00 America/Denver", "2020-01-01T10:00:00[Asia/Tokyo]", "2020-01-01 10:00:00 Not/Azone", "2020-01-01T25:00:00Z", "2020-01-01T24:00:00Z", "2020-01-01T10:60:00Z",
    "2020-01-01T10:00:00.999999999Z", "2020-01-01T10:00:00.9999995+05:30", "2020-01-01T10:00:00,5Z", "20200101T101112Z", "2013年9月12日 03:50:54", "2013年19月12日 03:50:54", "  2020-01-01 10:00:00Z  ", "1890-01-01 00:00:00",
    "x" * 5000, "9" * 400, "2020-01-01X10:00:00", "2024-06-01 00:00", "1833-10-10T01:09:57.211Z", "2020/5/6 07:08", "2020-5-06 7:08:09 +0100", "1969-12-31T23:59:59.9999Z",
    "2020-01-01 00:00:00." + "0" * 70, "2020-01-01 00:00:00" + " " * 90 + "EST", "2020-11-01 01:53:46 EST", "2020-11-01 01:53:46 EDT", "2020-11-01 01:53:46", "2020-11-01 01:53:46 CET", "2020-10-25 02:30:00 CET", "2020-10-25 02:30:00 CEST",
    "2150-07-01 12:00:00", "2150-01-01 12:00:00", "2499-12-31 23:00:00", "2500-01-01 00:00:00", "2777-11-02 01:30:00", "9999-07-01 12:00:00", "9998-12-31 23:59:59",
]


def run(spark, rows, unit=1):
    df = spark.createDataFrame(rows, "row_id bigint, feed_id int, t string, tz_name string, locale string")
    feeds = spark.createDataFrame(FEEDS, "feed_id int, tz_name string, locale string")
    out = instants.normalise_instants(df, feeds, row_id="row_id", feed_id="feed_id", fields={"t": unit}, source="s").collect()
    assert all((r.source_table, r.field_name) == ("s", "t") for r in out)
    return sorted((r.row_id, r.utc_micros) for r in out)


@pytest.mark.parametrize("unit", [1, 1000])
def test_against_plain_reading(spark, unit):
    rows, want = [], []
    for i, (text, feed) in enumerate((t, f) for t in TEXTS for f in [1, 2, 3, 4, 5, 6, 77, None]):
        rows.append((i, feed, text, "clash", "clash"))
        us = micros(text, *ZONES.get(feed, (None, None)), unit)
        want += [(i, us)] if us is not None else []
    assert run(spark, rows, unit) == sorted(want)


def test_random_local_times_near_changes(spark):
    r = random.Random(5)
    rows, want = [], []
    for i in range(1500):
        feed = r.choice([1, 2, 4, 6])
        month, day = r.choice([(3, 10), (3, 31), (10, 27), (11, 3), (4, 7), (10, 6), r.choice([(1, 1), (7, 15)])])
        text = f"{r.choice([1995, 2007, 2024, 2031])}-{month:02}-{day:02} {r.randrange(4):02}:{r.randrange(60):02}:{r.randrange(60):02}"
        rows.append((i, feed, text, None, None))
        want.append((i, micros(text, *ZONES[feed])))
    assert run(spark, rows) == want


def test_abbreviations_tell_the_side_of_a_repeated_hour(spark):
    rows, want = [], []
    for feed, day, sides in ((1, "2020-11-01 01", ("EST", "EDT", "")), (2, "2020-10-25 02", ("CET", "CEST", "GMT", "")), (6, "2020-04-05 01", ("LHST", "AEST", "")), (1, "2020-11-01 02", ("EST", "EDT")), (1, "2020-03-08 02", ("EST", "EDT"))):
        for minute in (0, 29, 30, 59):
            for side in sides:
                text = f"{day}:{minute:02}:46 {side}".strip()
                rows.append((len(rows), feed, text, None, None))
                want.append((len(want), micros(text, *ZONES[feed])))
    assert run(spark, rows) == want
    # 01:53:46 EST is an hour after 01:53:46 EDT
    assert run(spark, [(1, 1, "2020-11-01 01:53:46 EST", "", "")]) == [(1, 1604213626000000)]


def test_long_values(spark):
    """However long, a value is read or comes out as unreadable; none vanishes."""
    rows = [(1, 1, "2020-01-01 00:00:00." + "0" * 70_000 + "Z", "", ""), (2, 1, "x" * 200_000, "", ""), (3, 1, "2020-01-01" + " " * 500 + "00:00", "", ""), (4, 1, None, "", ""), (5, 1, " ", "", ""), (6, None, "2020-01-01", "", ""), (6, 1, "12:00", "", ""), (6, 1, "12:00", "", "")]
    assert run(spark, rows) == [(1, 1577836800000000), (3, 1577854800000000)]
    df = spark.createDataFrame(rows, "row_id bigint, feed_id int, t string, tz_name string, locale string")
    feeds = spark.createDataFrame(FEEDS, "feed_id int, tz_name string, locale string")
    out = instants.unreadable_instants(df, feeds, row_id="row_id", feed_id="feed_id", fields={"t": 1}, source="s").collect()
    assert sorted((r.source_table, r.row_id, r.field_name, r.value) for r in out) == [("s", 2, "t", "x" * 200_000), ("s", 6, "t", "12:00"), ("s", 6, "t", "12:00"), ("s", 6, "t", "2020-01-01")]


def test_repeated_feeds(spark):
    """Of several rows of a feed the least zone counts, in any order."""
    df = spark.createDataFrame([(1, 1, "2020-01-01 00:00:00")], "row_id bigint, feed_id int, t string")
    for rows in ([(1, "Europe/Berlin", "x"), (1, "America/New_York", "en_US")], [(1, "America/New_York", "en_US"), (1, "Europe/Berlin", "x")]):
        feeds = spark.createDataFrame(rows, "feed_id int, tz_name string, locale string")
        out = instants.normalise_instants(df, feeds, row_id="row_id", feed_id="feed_id", fields={"t": 1}).collect()
        assert [r.utc_micros for r in out] == [1577854800000000]


def test_empty_and_repeated(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, "2024-01-01", "", "")] * 2) == [(1, 1704085200000000)] * 2


def test_masks_are_compiled_once_each():
    instants.parsers_of.cache_clear()
    texts = pa.array([f"2024-01-{d:02} 00:00:00Z" for d in range(1, 29)] * 50)
    instants.Converter([])(texts, np.full(1400, -1), np.zeros(1400, bool))
    assert instants.parsers_of.cache_info().misses == 1
    assert instants.zone_version() != "unknown"
