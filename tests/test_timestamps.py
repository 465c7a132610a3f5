"""The normalisation against a slow reading of each value by the standard library."""

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamline.functions import zones
from loamline.operators import timestamps as N


def one(value, home="UTC", order="dmy"):
    return N.normalise_values(pa.array([value], pa.string()), pa.array([home]), pa.array([order]))[0].as_py()


@pytest.mark.parametrize(
    ("value", "home", "order", "utc"),
    [
        ("2023-01-17T02:35:55z", "UTC", "dmy", "2023-01-17T02:35:55.000Z"),
        ("2024-08-19T04:09:56.862999265Z", "UTC", "dmy", "2024-08-19T04:09:56.862Z"),
        ("2025-03-09T10:33:50.5Z", "UTC", "dmy", "2025-03-09T10:33:50.500Z"),
        ("2023-09-29 20:48:49.273268 +01:00", "UTC", "dmy", "2023-09-29T19:48:49.273Z"),
        ("2023-08-17T23:55:20.482-0330", "UTC", "dmy", "2023-08-18T03:25:20.482Z"),
        ("Fri, 01 Jul 2022 07:03:02 +1245", "UTC", "dmy", "2022-06-30T18:18:02.000Z"),
        ("2024-07-17T22:11:32 Europe/Berlin", "UTC", "dmy", "2024-07-17T20:11:32.000Z"),
        ("2021-08-14T03:33:08[America/New_York]", "UTC", "dmy", "2021-08-14T07:33:08.000Z"),
        ("15 Sep 2024 16:10:25 JST", "UTC", "dmy", "2024-09-15T07:10:25.000Z"),
        ("2025-06-01 17:37:37 CEST", "America/Chicago", "dmy", "2025-06-01T15:37:37.000Z"),
        ("10/3/2022 7:05 AM", "UTC", "mdy", "2022-10-03T07:05:00.000Z"),
        ("10/3/2022 7:05 AM", "UTC", "dmy", "2022-03-10T07:05:00.000Z"),
        ("26/3/2022", "UTC", "mdy", None),
        ("1/2/2022 12:30 AM", "UTC", "dmy", "2022-02-01T00:30:00.000Z"),
        ("1/2/2022 12:30 PM", "UTC", "dmy", "2022-02-01T12:30:00.000Z"),
        ("1/2/2022 13:30 PM", "UTC", "dmy", None),
        ("08.02.2023 08:09", "Asia/Tokyo", "mdy", "2023-02-07T23:09:00.000Z"),
        ("4. März 2024, 07:33 Uhr", "UTC", "dmy", "2024-03-04T07:33:00.000Z"),
        ("30 November 2021 at 1:47am", "UTC", "dmy", "2021-11-30T01:47:00.000Z"),
        ("December 10, 2024", "Asia/Tokyo", "dmy", "2024-12-10T00:00:00.000Z"),
        ("20250512T074720", "Europe/London", "dmy", "2025-05-12T06:47:20.000Z"),
        ("20210206", "Asia/Tokyo", "dmy", "2021-02-06T00:00:00.000Z"),
        ("2025-11", "Asia/Tokyo", "dmy", "2025-11-01T00:00:00.000Z"),
        ("1611478553", "Asia/Tokyo", "dmy", "2021-01-24T08:55:53.000Z"),
        ("1611749785523", "UTC", "dmy", "2021-01-27T12:16:25.523Z"),
        ("1621765410991939", "UTC", "dmy", "2021-05-23T10:23:30.991Z"),
        ("1621765410991939123", "UTC", "dmy", "2021-05-23T10:23:30.991Z"),
        ("\t2022-03-20 ", "UTC", "dmy", "2022-03-20T00:00:00.000Z"),
        # twice: the first; skipped: the offset before
        ("2023-10-29 02:30", "Europe/Berlin", "dmy", "2023-10-29T00:30:00.000Z"),
        ("2023-03-26 02:30", "Europe/Berlin", "dmy", "2023-03-26T01:30:00.000Z"),
        ("2023-04-02 01:45", "Australia/Lord_Howe", "dmy", "2023-04-01T14:45:00.000Z"),
        # no cases
        ("2023-01-17T02:35:55.000Z", "UTC", "dmy", None),
        ("2023-02-30", "UTC", "dmy", None),
        ("2024-13-05T10:00:00Z", "UTC", "dmy", None),
        ("2022-06-31 09:15", "UTC", "dmy", None),
        ("0000-00-00", "UTC", "dmy", None),
        ("25:61", "UTC", "dmy", None),
        ("sometime in 2023?", "UTC", "dmy", None),
        ("2023-01-01 25:00", "UTC", "dmy", None),
        ("2023-01-01 10:00", "Nowhere/At_All", "dmy", None),
        ("", "UTC", "dmy", None),
        (" ", "UTC", "dmy", None),
        (None, "UTC", "dmy", None),
        ("1" * 5000, "UTC", "dmy", None),
        ("{{date}}", "UTC", "dmy", None),
    ],
)
def test_values(value, home, order, utc):
    assert one(value, home, order) == utc


ZONES = ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata", "America/Sao_Paulo", "Europe/London"]


def brute(local: datetime, home: str) -> datetime:
    """The first of two instants with that local time; of none, that by the offset before."""
    zone = ZoneInfo(home)
    found = sorted(local.replace(tzinfo=zone, fold=f).astimezone(UTC) for f in (0, 1))
    real = [t for t in found if t.astimezone(zone).replace(tzinfo=None) == local]
    return real[0] if real else local.replace(tzinfo=zone, fold=0).astimezone(UTC)


@settings(max_examples=400, deadline=None)
@given(st.datetimes(datetime(1995, 1, 1), datetime(2037, 1, 1)), st.sampled_from(ZONES))
def test_local_times(local, home):
    local = local.replace(microsecond=local.microsecond // 1000 * 1000)
    want = brute(local, home).strftime("%Y-%m-%dT%H:%M:%S.") + f"{local.microsecond // 1000:03d}Z"
    assert one(local.strftime("%Y-%m-%d %H:%M:%S.") + f"{local.microsecond // 1000:03d}", home) == want


@pytest.mark.parametrize("home", ZONES)
def test_around_changes(home):
    z = zones.Zone(home)
    for change in z.changes[-60:].tolist():
        for minutes in range(-150, 151, 15):
            local = datetime(1970, 1, 1) + timedelta(seconds=change + int(z.offsets[-1]) + minutes * 60)
            assert one(local.strftime("%Y-%m-%d %H:%M:%S"), home) == brute(local, home).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def test_version():
    assert re.fullmatch(r"\d{4}[a-z]+|unknown", zones.version())


def test_documents(spark):
    fm = "map<string,struct<is_list:boolean,values:array<string>>>"
    rows = [(1, 7, "2024-01-02 03:04", None, {"date": (False, ["5/6/2024"]), "due": (False, ["2024-01-01"]), "updated": (True, ["2024-01-01"])}), (2, None, "2024-01-02 03:04", "x", None), (3, 99, "", "2024-01-02T00:00:00.000Z", {}), (None, 7, "2024-01-02", None, None)]
    docs = spark.createDataFrame(rows + rows[:1], f"doc_no bigint, vault_id int, created_at string, modified_at string, frontmatter {fm}").withColumn("utc", F.lit("clash")).withColumn("value", F.lit(1))
    configs = spark.createDataFrame([(0, "Asia/Tokyo", "dmy"), (7, None, "mdy"), (None, "UTC", "dmy")], "vault_id int, home_zone string, date_order string")
    got = sorted(tuple(r) for r in N.document_dates(docs, configs).collect())
    assert got == [(1, "created_at", "2024-01-01T18:04:00.000Z"), (1, "frontmatter.date", "2024-05-06T00:00:00.000Z"), (2, "created_at", "2024-01-01T18:04:00.000Z")]
    assert N.document_dates(docs.limit(0), configs).count() == 0
    assert N.document_dates(docs, configs.limit(0)).count() == 3


@pytest.mark.parametrize(
    ("value", "home", "utc"),
    [
        ("2024-08-19T04:09:56." + "1234567890" * 50 + "Z", "UTC", "2024-08-19T04:09:56.123Z"),
        (" " * 300 + "2024-08-19", "UTC", "2024-08-19T00:00:00.000Z"),
        ("x" * 100_000 + " 2024-08-19", "UTC", None),
        ("2500-07-01 12:00:00", "Europe/Berlin", "2500-07-01T10:00:00.000Z"),
        ("2937-01-01 12:00:00", "America/New_York", "2937-01-01T17:00:00.000Z"),
        ("1850-01-01 12:00:00", "Asia/Tokyo", "1850-01-01T02:41:01.000Z"),
        ("-1700000000", "UTC", "1916-02-18T01:46:40.000Z"),
        ("-1700000000.5", "UTC", "1916-02-18T01:46:39.500Z"),
        ("1700000000.98765", "UTC", "2023-11-14T22:13:20.987Z"),
        ("1700000000123", "UTC", "2023-11-14T22:13:20.123Z"),
        ("1700000000123456", "UTC", "2023-11-14T22:13:20.123Z"),
        ("-1700000000123456789", "UTC", "1916-02-18T01:46:39.877Z"),
        ("99999999999999999999", "UTC", "5138-11-16T09:46:39.999Z"),
    ],
)
def test_values_of_any_length_and_year(value, home, utc):
    assert one(value, home) == utc


@given(st.integers(-60_000_000_000, 250_000_000_000), st.sampled_from(["Europe/Berlin", "America/New_York", "Asia/Tokyo", "Australia/Lord_Howe"]))
def test_zones_agree_with_the_library_in_any_year(seconds, name):
    local = datetime(1970, 1, 1) + timedelta(seconds=seconds)
    want = local.replace(tzinfo=ZoneInfo(name), fold=0)
    got = int(zones.zone(name).to_utc(np.array([seconds]))[0])
    assert got == seconds - int(want.utcoffset().total_seconds())


def test_another_release_of_the_zones_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(zones, "version", lambda: "1999a")
    df = spark.createDataFrame([("2024-01-01", "UTC", "dmy")], "v string, z string, o string")
    with pytest.raises(Exception, match="zone database"):
        N.normalised(df, ["v"], "v", "z", "o").collect()
