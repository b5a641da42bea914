import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from jurisgrid.operators.timestamps import normalise_timestamps

SCHEMA = "value string, zone string, ord string, ts string"


def run(spark, rows):
    out = normalise_timestamps(spark.createDataFrame(rows, SCHEMA).drop("ts"), "value", "zone", "ord")
    return {(r["value"], r["zone"], r["ord"]): (r["ts"]["kind"], r["ts"]["utc_value"]) for r in out.collect()}


def test_formats(spark):
    cases = {
        ("13/02/2014", "Europe/Paris", "MDY"): ("date", "2014-02-13"), ("03/02/2014", "Europe/Paris", "MDY"): ("date", "2014-03-02"), ("03.02.2014", None, "DMY"): ("date", "2014-02-03"),
        ("30/02/2014", None, "DMY"): ("invalid", None), ("mars 2015", None, "DMY"): ("invalid", None), ("2013", None, "DMY"): ("invalid", None), ("pending", None, None): ("invalid", None),
        ("1er novembre 2004", None, "DMY"): ("date", "2004-11-01"), ("September 13th, 2000", None, "DMY"): ("date", "2000-09-13"), ("a 10 de enero de 2026", None, "DMY"): ("date", "2026-01-10"),
        ("11.XI.1995", None, "MDY"): ("date", "1995-11-11"), ("den 16. Juli 2025", None, "DMY"): ("date", "2025-07-16"), ("  ", None, None): ("empty", None), (None, None, None): ("empty", None),
        ("20240229", None, None): ("date", "2024-02-29"), ("20230229", None, None): ("invalid", None), ("1668063148", "Asia/Kolkata", None): ("instant", "2022-11-10T06:52:28.000000Z"), ("1258037311000", None, None): ("instant", "2009-11-12T14:48:31.000000Z"),
        ("20131027022408", "Europe/Madrid", None): ("instant", "2013-10-27T00:24:08.000000Z"),  # the hour occurs twice
        ("2014-03-30 02:30:00", "Europe/Paris", None): ("instant", "2014-03-30T01:30:00.000000Z"),  # the hour is skipped
        ("2017-05-01 12:00:00 Nowhere/City", None, None): ("invalid", None), ("2017-05-01 12:00:00 CEST", None, None): ("instant", "2017-05-01T10:00:00.000000Z"), ("2017-05-01 25:00", None, None): ("invalid", None),
        ("2015-11-30T18:13:33.266972+05:30", None, None): ("instant", "2015-11-30T12:43:33.266972Z"), ("June 1, 2022 12:05 am", "UTC", None): ("instant", "2022-06-01T00:05:00.000000Z"), ("1950-01-02 03:04:05.5", "UTC", None): ("instant", "1950-01-02T03:04:05.500000Z"),
        ("x" * 100_000, None, None): ("invalid", None),
    }
    assert run(spark, [(*k, None) for k in cases]) == cases


def test_against_zoneinfo(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for _ in range(400):
        z = rng.choice(["Europe/London", "America/New_York", "Asia/Kolkata", "Europe/Berlin", "America/Bogota"])
        local = datetime(1990, 1, 1) + timedelta(seconds=rng.randrange(35 * 365 * 86400))
        first = local.replace(tzinfo=ZoneInfo(z), fold=0)
        utc = first.astimezone(timezone.utc)
        if utc.astimezone(ZoneInfo(z)).replace(tzinfo=None) != local:  # skipped: forward by the gap
            utc = (first.replace(fold=0)).astimezone(timezone.utc)
        key = (local.strftime("%Y-%m-%d %H:%M:%S"), z, "DMY")
        rows.append((*key, None))
        want[key] = ("instant", utc.strftime("%Y-%m-%dT%H:%M:%S.000000Z"))
    assert run(spark, rows) == want


def test_empty_repeated_and_clashing(spark):
    df = spark.createDataFrame([("2020-01-01", "old", 1), ("2020-01-01", "old", 1)], "value string, ts string, `a.b` int")
    out = normalise_timestamps(df, "value")
    assert [r["ts"]["utc_value"] for r in out.collect()] == ["2020-01-01"] * 2 and set(out.columns) == {"value", "ts", "a.b"}
    assert normalise_timestamps(df.limit(0), "value").count() == 0


def test_zones_of_the_session(spark):
    """Every zone of the JVM is known; an unknown clock is taken as UTC and flagged."""
    rows = [("2020-07-01 12:00", "US/Eastern", None, None), ("2020-07-01 12:00", "Japan", None, None), ("2020-07-01 12:00", "EST5EDT", None, None), ("2020-07-01 12:00", "Mars/Base", None, None), ("2020-07-01 12:00", None, None, None), ("01.07.20", "Japan", None, None)]
    out = normalise_timestamps(spark.createDataFrame(rows, SCHEMA).drop("ts"), "value", "zone", "ord").collect()
    got = {(r["value"], r["zone"]): (r["ts"]["utc_value"], r["ts"]["zone_source"], r["ts"]["kind"]) for r in out}
    assert [got[("2020-07-01 12:00", z)][:2] for z in ("US/Eastern", "Japan", "EST5EDT", "Mars/Base", None)] == [
        ("2020-07-01T16:00:00.000000Z", "feed"), ("2020-07-01T03:00:00.000000Z", "feed"), ("2020-07-01T16:00:00.000000Z", "feed"), ("2020-07-01T12:00:00.000000Z", "assumed-utc"), ("2020-07-01T12:00:00.000000Z", "assumed-utc")]
    assert got[("01.07.20", "Japan")][2] == "invalid"
