"""Problem 6 against Python's own calendar and zones."""

import datetime as dt
import random
import zoneinfo

import pytest

from newsloom.operators.timestamps import to_utc

SCHEMA = "id long, v string, tz string, o string, tz_name string, year int, epoch_us string"


def run(spark, rows):
    df = spark.createDataFrame([(i, *r, "x", 1, "y") for i, r in enumerate(rows)], SCHEMA)
    return [r["epoch_us"] for r in to_utc(df, "v", "tz", "o").orderBy("id").collect()]


def us(*a):
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1_000_000)


CASES = [
    ("2022-01-02T05:51:01Z", "Europe/Paris", "dmy", us(2022, 1, 2, 5, 51, 1)),
    ("1641109781804", None, None, 1641109781804000),
    (" 1641316470 ", None, None, 1641316470000000),
    ("20220105T180415Z", None, None, us(2022, 1, 5, 18, 4, 15)),
    ("20220207", "UTC", None, us(2022, 2, 7)),
    ("01/02/2022 00:51", "America/New_York", "mdy", us(2022, 1, 2, 5, 51)),
    ("01/02/2022 00:51", "Europe/London", "dmy", us(2022, 2, 1, 0, 51)),
    ("02/13/2025 11:10 PM", "America/Chicago", "mdy", us(2025, 2, 14, 5, 10)),
    ("2022-02-23 03:26:28,426+01:00", None, None, us(2022, 2, 23, 2, 26, 28) + 426000),
    ("2022-01-08T00:19:45 Europe/Madrid", "Asia/Tokyo", None, us(2022, 1, 7, 23, 19, 45)),
    ("2022-01-08T00:19:45[America/New_York]", None, None, us(2022, 1, 8, 5, 19, 45)),
    ("2022-01-08T00:19:45 Mars/Base", None, None, None),
    ("Sun, 02 Jan 2022 21:42:42 GMT", "Asia/Tokyo", None, us(2022, 1, 2, 21, 42, 42)),
    ("16 janvier 2022 à 22h57", "Europe/Paris", None, us(2022, 1, 16, 21, 57)),
    ("12 de enero de 2022, 08:53", "Europe/Madrid", None, us(2022, 1, 12, 7, 53)),
    ("25. Januar 2022, 02:31 Uhr", "Europe/Berlin", None, us(2022, 1, 25, 1, 31)),
    ("1er avril 2024 à 9h00", "Europe/Paris", None, us(2024, 4, 1, 7)),
    ("Apr 16, 2022 8:12 PM CDT", "America/Chicago", None, us(2022, 4, 17, 1, 12)),
    ("2023-03-26 02:30:00", "Europe/Berlin", None, us(2023, 3, 26, 1, 30)),  # skipped
    ("2023-10-29 02:30", "Europe/Berlin", None, us(2023, 10, 29, 0, 30)),  # twice
    ("29 Oct 2023 02:30 CET", "Europe/Berlin", None, us(2023, 10, 29, 1, 30)),
    *[(v, "Europe/Paris", "dmy", None) for v in (None, "", " ", "31/02/2024 10:00", "2024-13-45T09:00:00Z", "0000-00-00 00:00:00", "2023-02-29", "yesterday", "2 hours ago", "{{ date }}", "n/a", "-", "12:30", "x" * 100_000)],
]


@pytest.fixture(scope="module")
def found(spark):
    return run(spark, [c[:3] for c in CASES])


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(found, i):
    assert found[i] == CASES[i][3], CASES[i][0]


def test_random_local_times(spark):
    rng, rows, want = random.Random(3), [], []
    for _ in range(400):
        tz = rng.choice(["Europe/London", "America/Los_Angeles", "Australia/Sydney", "Asia/Kolkata", "America/Bogota"])
        t = dt.datetime(2022, 1, 1) + dt.timedelta(minutes=rng.randrange(4 * 366 * 1440))
        if rng.random() < 0.5:  # near a change
            t = t.replace(month=rng.choice([3, 4, 10, 11]), day=rng.randrange(1, 15), hour=rng.randrange(4))
        local = t.replace(tzinfo=zoneinfo.ZoneInfo(tz), fold=0)
        rows.append((t.strftime("%Y-%m-%d %H:%M"), tz, "dmy"))
        want.append(int((local - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds() * 1_000_000))
    assert run(spark, rows) == want


def test_empty_and_repeated(spark):
    assert run(spark, [("2022-01-01", "UTC", "dmy")] * 3) == [us(2022, 1, 1)] * 3
    assert to_utc(spark.createDataFrame([], SCHEMA), "v", "tz", "o").count() == 0
