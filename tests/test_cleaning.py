import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signetry.functions.times import to_utc, usable_seconds, utc_instant, with_utc, zone_tables
from signetry.operators.hotkeys import endpoint_states, hot_nodes
from signetry.sources.structural import _parsed, ratings, rejects

CASES = [
    ('"a ""q""", b ,+3,"1500000000.5"\r', None), ("a,b,1,1500000000", None), ("a,b,-10,946684800", None), ("a,b,10,1893455999.999", None), ("x y , , 010 , 01500000000 ", None), ('"a,b",c,0,1500000000', None),
    ('a"b,c,1,1500000000', "quoting"), ('"a,b,1,1500000000', "quoting"), ('"a"b,c,1,1500000000', "quoting"), ('"a" ,b,1,1500000000', "quoting"), (' "a",b,1,1500000000', "quoting"), ('"a"""b"",c,1,1', "quoting"), ('"', "quoting"),
    ("a,b,1", "column_count"), ("a,b,1,1500000000,", "column_count"), ("a;b;1;2", "column_count"), ('"",b', "column_count"),
    ('"",b,1,1500000000', "bad_source"), (" NaN ,b,1,1500000000", "bad_source"), ("null,b,99,1", "bad_source"), ("a\tb,b,1,1500000000", "bad_source"), ("a�,b,1,1500000000", "bad_source"), ("a\x85,b,1,1500000000", "bad_source"), ('"a\nb",b,1,1500000000', "bad_source"),
    ("a,b,11,1500000000", "bad_weight"), ("a,b,,1500000000", "bad_weight"), ("a,b,1.0,1", "bad_weight"), ("a,b,١,1500000000", "bad_weight"), ("a,b,--1,1", "bad_weight"),
    ("a,b,1,1500000000.", "bad_timestamp"), ("a,b,1,", "bad_timestamp"), ("a,b,1,1e9", "bad_timestamp"), ("a,b,1,1893456000", "bad_timestamp"), ("a,b,1,-1500000000", "bad_timestamp"), ("a,b,1,99999999999999999999", "bad_timestamp"),
    (None, "not_a_record"), ("", "not_a_record"), ("\r", "not_a_record"), ("   ", "not_a_record"), ("# c,d,1,1500000000", "not_a_record"),
]


def test_reasons():
    out = _parsed(pa.array([c for c, _ in CASES], pa.string())).to_pylist()
    assert [(c, r["reason"]) for (c, _), r in zip(CASES, out)] == CASES
    assert out[0] == {"reason": None, "source": 'a "q"', "target": "b", "weight": 3, "timestamp": 1500000000.5}
    assert out[5]["source"] == "a,b"


def test_batches_of_any_cut_agree():
    lines = [c for c, _ in CASES] * 3
    random.Random(1).shuffle(lines)
    whole = _parsed(pa.array(lines, pa.string())).to_pylist()
    single = [_parsed(pa.array([x], pa.string())).to_pylist()[0] for x in lines]
    sliced = _parsed(pa.array(["zz", *lines], pa.string()).slice(1)).to_pylist()
    assert whole == single == sliced
    assert _parsed(pa.array([], pa.string())).to_pylist() == []


def test_lines_in_a_table(spark, rows):
    long = "s" * 300_000 + ",t,1,1500000000"
    df = spark.createDataFrame([(1, "a,b,1,1500000000", "x"), (2, "a,b", "y"), (2, "a,b", "y"), (None, None, "z"), (3, long, "w")], "line_id bigint, raw_line string, source string")
    assert rows(rejects(df).select("line_id", "reason", "source")) == [(2, "column_count", "y")] * 2
    good = ratings(df, keep=("line_id", "source"))
    assert good.columns == ["line_id", "line_source", "source", "target", "weight", "timestamp"]
    assert good.where("line_id = 3").first()["source"] == "s" * 300_000
    assert rejects(df.limit(0)).count() == 0 and ratings(df.limit(0)).count() == 0


def _utc(text, zone=None, first=-1):
    micros, code = to_utc(pa.array([text], pa.string()), [zone], np.array([first]), zone_tables())
    return None if code[0] >= 0 else int(micros[0])


def _at(*parts, micro=0):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 + micro


@pytest.mark.parametrize(
    ("text", "zone", "first", "want"),
    [
        ("1500000000", None, -1, 1_500_000_000_000_000), (" 1500000000123\t", None, -1, 1_500_000_000_123_000), ("1500000000123456", None, -1, 1_500_000_000_123_456), ("1500000000.1234567", None, -1, 1_500_000_000_123_456),
        ("2015", "UTC", 1, None), ("20150819", "UTC", 1, None), ("0", "UTC", 1, None), ("-1", "UTC", 1, None), ("0" * 30 + "1500000000", None, -1, 1_500_000_000_000_000), ("9" * 50, None, -1, None),
        ("2015-08-19T22:40:17Z", None, -1, _at(2015, 8, 19, 22, 40, 17)), ("20150819T224017Z", None, -1, _at(2015, 8, 19, 22, 40, 17)), ("2015-08-19 22:40:17.1234567+05:30", "UTC", 1, _at(2015, 8, 19, 17, 10, 17, micro=123456)),
        ("2015-08-19T22:40:17-0330", None, -1, _at(2015, 8, 20, 2, 10, 17)), ("2015-08-19T22:40-08", None, -1, _at(2015, 8, 20, 6, 40)), ("2015-08-19 22:40:17,5", "UTC", 1, _at(2015, 8, 19, 22, 40, 17, micro=500000)),
        ("19/08/2015 10:40 PM", "UTC", 1, _at(2015, 8, 19, 22, 40)), ("08/19/2015 12:05 AM", "UTC", 0, _at(2015, 8, 19, 0, 5)), ("19/08/2015 10:40", "UTC", 0, None), ("3/4/2015 10:40", "UTC", -1, None), ("4/4/2015 10:40", "UTC", -1, _at(2015, 4, 4, 10, 40)), ("13/4/2015 10:40", "UTC", -1, _at(2015, 4, 13, 10, 40)),
        ("Wed, 19 Aug 2015 22:40:17 +0200", None, -1, _at(2015, 8, 19, 20, 40, 17)), ("Thu, 19 Aug 2015 22:40:17 +0200", None, -1, None), ("22:40, 9 August 2015", "Europe/Berlin", 1, _at(2015, 8, 9, 20, 40)), ("9 August 2015 22:40 (CEST)", "Europe/Berlin", 1, _at(2015, 8, 9, 20, 40)),
        ("2015-08-19T22:40:17[Asia/Tokyo]", None, -1, _at(2015, 8, 19, 13, 40, 17)), ("2015-08-19T22:40:17[Mars/Base]", "UTC", 1, None), ("2015-08-19 22:40", None, -1, None), ("2015-08-19", "UTC", 1, None), ("22:40:17", "UTC", 1, None),
        ("2015-02-30 10:00Z", "UTC", 1, None), ("2015-02-28 24:00Z", "UTC", 1, None), ("2015-02-28 10:61Z", "UTC", 1, None), ("13:00 PM, 1 May 2015", "UTC", 1, None), ("1999-12-31T23:59:59Z", None, -1, None), ("2029-12-31T23:59:59Z", None, -1, _at(2029, 12, 31, 23, 59, 59)), ("2030-01-01T00:00:00Z", None, -1, None),
        ("2016-11-06 01:30:00", "America/New_York", 0, None), ("2016-11-06 01:30:00 EDT", "America/New_York", 0, _at(2016, 11, 6, 5, 30)), ("2016-11-06 01:30:00 EST", "America/New_York", 0, _at(2016, 11, 6, 6, 30)), ("2016-11-06 01:30:00-05:00", "America/New_York", 0, _at(2016, 11, 6, 6, 30)),
        ("2016-03-13 02:30:00", "America/New_York", 0, None), ("2016-03-13 03:00:00", "America/New_York", 0, _at(2016, 3, 13, 7)), ("2014-03-13 10:49:33 UTC", "Asia/Tokyo", 1, _at(2014, 3, 13, 10, 49, 33)), (None, "UTC", 1, None), ("", "UTC", 1, None), ("x" * 10_000, "UTC", 1, None),
    ],
)
def test_instants(text, zone, first, want):
    assert _utc(text, zone, first) == want


def test_zone_tables_equal_the_database():
    import zoneinfo

    tables = zone_tables()
    r = random.Random(3)
    for name in ("America/New_York", "Europe/London", "Australia/Lord_Howe", "Africa/Casablanca", "Asia/Kolkata", "Pacific/Apia"):
        zone, info = tables.get(name), zoneinfo.ZoneInfo(name)
        for _ in range(300):
            t = r.randrange(946_684_800, 1_893_456_000)
            assert zone.offset[zone.at(np.array([t]))][0] == dt.datetime.fromtimestamp(t, info).utcoffset().total_seconds()
    assert tables.version and tables.get("europe/BERLIN") is not None and tables.get("Nowhere") is None


def test_votes_in_a_table(spark, rows):
    feeds = spark.createDataFrame([(1, "n", 1, "Europe/Berlin", True), (1, "n", 1, None, None), (9, "n", 1, None, None), (None, "n", 1, "UTC", True)], "feed_id int, feed_name string, trust_level int, clock_zone string, day_first boolean")
    votes = spark.createDataFrame([(1, 1, "2015-08-19 10:00", "c"), (2, 9, "2015-08-19 10:00", "c"), (3, None, "1500000000", "c"), (4, 7, None, "c")], "record_id bigint, feed_id int, timestamp string, clock_zone string")
    out = with_utc(votes, feeds)
    assert rows(out.select("record_id", "utc_micros", "utc_reason")) == [(1, _at(2015, 8, 19, 8), None), (2, None, "no_zone"), (3, 1_500_000_000_000_000, None), (4, None, "no_date_and_time")]
    assert "clock_zone" in out.columns and with_utc(votes.limit(0), feeds).count() == 0 and with_utc(votes, feeds.limit(0)).count() == 4


def test_usable_seconds(spark):
    df = spark.createDataFrame([(1_400_000_000,), (1_400_000_000_999,), (1_400_000_000_999_999,), (1_400_000_000_999_999_999,), (0,), (-5,), (None,)], "t bigint")
    assert [r[0] for r in df.select(usable_seconds(F.col("t"))).collect()] == [1_400_000_000] * 4 + [None] * 3
    assert utc_instant is not None


def test_node_states(spark, rows):
    df = spark.createDataFrame([(1, 2, 1, "x"), (1, 2, 1, "x"), (2, 1, -1, "x"), (3, 3, None, "x"), (None, 1, 0, "x"), (None, None, 1, "x")], "source bigint, target bigint, sign int, node_id string")
    assert rows(endpoint_states(df)) == [(1, 4, 2, 1), (2, 3, 2, 1), (3, 1, 0, 0)]
    assert rows(hot_nodes(df, 0.5).select("node_id")) == [(1,), (2,)]
    assert rows(hot_nodes(df, 3 / 6).select("node_id")) == [(1,), (2,)]
    assert endpoint_states(df.limit(0)).count() == 0 and hot_nodes(df.limit(0)).count() == 0
