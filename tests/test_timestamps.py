import datetime as dt
import random
import zoneinfo

import pytest

from factweave.operators.timestamps import CANDIDATES, estimated_instants, instants, read_stamp, zone_estimates

UTC = dt.timezone.utc


def us(*a, tz=UTC, fold=0):
    return (dt.datetime(*a, tzinfo=tz, fold=fold).astimezone(UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1)


def test_dates_and_periods_are_no_points():
    for s in (None, "", " ", "2024", "2024-03-31", "20240331", "31.12.2020", "March 14, 2013", "Q2/2018", "H1 2019", "2019 - 2021", "soon", "n/a", "99:99 1 May 2020", "25:00 2020-01-01"):
        assert read_stamp(s) is None, s


@pytest.mark.parametrize("text, zone, order, want", [
    ("2021-07-27 21:38:57", None, None, us(2021, 7, 27, 21, 38, 57)), ("09/10/13 01:08", None, "MDY", us(2013, 9, 10, 1, 8)), ("09/10/13 01:08", None, None, us(2013, 10, 9, 1, 8)), ("26/03/2022 18:21", None, "MDY", us(2022, 3, 26, 18, 21)),
    ("1426981386613", "Asia/Tokyo", None, 1426981386613000), ("1642394406", None, None, 1642394406000000), ("1335797991969192", None, None, 1335797991969192), ("20240201T110520Z", "Asia/Tokyo", None, us(2024, 2, 1, 11, 5, 20)),
    ("20200926175228", "Europe/Berlin", None, us(2020, 9, 26, 15, 52, 28)), ("2023-09-11T20:25:40.821905999Z", None, None, us(2023, 9, 11, 20, 25, 40, 821905)), ("14-Feb-15 12:26:41 AM", None, None, us(2015, 2, 14, 0, 26, 41)),
    ("2024-05-27 17:56 GMT+5:45", "Asia/Tokyo", None, us(2024, 5, 27, 12, 11)), ("2023-09-16 14:49 UTC-5", None, None, us(2023, 9, 16, 19, 49)), ("2014-03-09T02:07:20-06:00[America/Chicago]", None, None, us(2014, 3, 9, 8, 7, 20)),
    ("00:14:07 Asia/Tokyo, March 30, 2012", None, None, us(2012, 3, 29, 15, 14, 7)), ("12 août 2024 à 04h28", "Europe/Paris", None, us(2024, 8, 12, 2, 28)), ("12. Januar 2012, 07:06 Uhr", "Europe/Berlin", None, us(2012, 1, 12, 6, 6)),
    ("as of 12:53 a.m. AEDT on March 16, 2012", None, None, us(2012, 3, 15, 13, 53)), ("Wed, 25 Jan 2023 23:18:30 +0100", None, None, us(2023, 1, 25, 22, 18, 30)),
    # skipped and repeated local times take the offset before the change
    ("2016-03-27 02:30", "Europe/Berlin", None, us(2016, 3, 27, 1, 30)), ("2021-10-31 02:30", "Europe/Berlin", None, us(2021, 10, 31, 0, 30)), ("2016-03-13 02:30", "America/New_York", None, us(2016, 3, 13, 7, 30)),
    ("2021-10-31 02:30 CET", "Europe/Berlin", None, us(2021, 10, 31, 1, 30)), ("2021-07-27 21:38:57", "Nowhere/Land", None, us(2021, 7, 27, 21, 38, 57)),
])
def test_points(spark, text, zone, order, want):
    meta = "{" + ", ".join(f'"{k}": "{v}"' for k, v in (("timezone", zone), ("date_order", order)) if v) + "}"
    files = spark.createDataFrame([("d", meta)], "id string, metadata_json string")
    f = spark.createDataFrame([("f", "d", text, None, "2020", None)], "id string, document_id string, time_text string, time_start string, time_end string, created_at timestamp")
    assert [tuple(r) for r in instants(f, files).collect()] == [("f", "time_text", want)]


def test_nulls_repeats_and_long_texts(spark):
    files = spark.createDataFrame([("d", "{broken"), ("d", None), (None, None)], "id string, metadata_json string")
    rows = [("f", "d", "2020-01-01 00:00", "x" * 500000, None, None, 1), ("f", "d", "2020-01-01 00:00", None, None, None, 2), ("g", None, "2020-01-01 00:00", None, None, None, 3), ("h", "gone", None, "2020-01-01 00:00", None, None, 4), (None, "d", "2020-01-01 00:00", None, None, None, 5)]
    schema = "id string, document_id string, time_text string, time_start string, time_end string, created_at timestamp, zone int"
    got = {tuple(r) for r in instants(spark.createDataFrame(rows, schema), files).collect()}
    x = us(2020, 1, 1)
    assert got == {("f", "time_text", x), ("g", "time_text", x), ("h", "time_start", x)}
    assert instants(spark.createDataFrame([], schema), files).count() == 0


def test_zones_are_estimated(spark):
    """Accuracy on documents whose zone is known but not told: stamps of a year, some minutes to
    an hour before their ingestion, east and west of Greenwich, over clock changes."""
    rnd, rows = random.Random(2), []
    for z in CANDIDATES:
        for k in range(40):
            t = dt.datetime(2023, 1, 1, 12, tzinfo=UTC) + dt.timedelta(days=9 * k, hours=rnd.randrange(24))
            rows.append((f"{z}{k}", z, (t - dt.timedelta(minutes=rnd.randint(1, 59))).astimezone(zoneinfo.ZoneInfo(z)).strftime("%Y-%m-%d %H:%M"), None, None, t))
    rows.append(("none", None, "2023-01-01 12:00", None, None, None))
    schema = "id string, document_id string, time_text string, time_start string, time_end string, created_at timestamp"
    f = spark.createDataFrame(rows, schema)
    files = spark.createDataFrame([(z, None) for z in CANDIDATES] + [("other", '{"timezone": "Asia/Calcutta"}')], "id string, metadata_json string")
    got = {r.document_id: r for r in zone_estimates(f, files).collect()}
    right = sum(got[z].zone == z for z in CANDIDATES)
    assert right >= 0.9 * len(CANDIDATES) and all(got[z].zone == z for z in ("America/New_York", "America/Los_Angeles", "Asia/Tokyo", "Europe/Berlin"))
    assert got["Asia/Kolkata"].ties == 2 and got["Asia/Tokyo"].ties == 1 and got["Asia/Tokyo"].n == 40  # Asia/Calcutta does as well
    assert zone_estimates(f.limit(0), files).count() == 0


def test_usual_lag_is_taken_from_stamps_with_offset(spark):
    t = [dt.datetime(2023, 5, 1 + k, 20, tzinfo=UTC) for k in range(20)]
    rows = [(f"a{k}", "told", (x - dt.timedelta(hours=3)).strftime("%Y-%m-%dT%H:%M:00Z"), None, None, x) for k, x in enumerate(t)]
    rows += [(f"b{k}", "ny", (x - dt.timedelta(hours=3)).astimezone(zoneinfo.ZoneInfo("America/New_York")).strftime("%Y-%m-%d %H:%M"), None, None, x) for k, x in enumerate(t)]
    f = spark.createDataFrame(rows, "id string, document_id string, time_text string, time_start string, time_end string, created_at timestamp")
    got = {r.document_id: (r.zone, r.violations, r.away) for r in zone_estimates(f, spark.createDataFrame([("ny", None)], "id string, metadata_json string")).collect()}
    assert got == {"ny": ("America/New_York", 0, 0)}


def test_all_notations_reach_the_reader(spark):
    rows = [("a", "d", "March 5, 2024 3 PM", "5.3.2024 14H30", "5.3.2024 14 h 30", None)]
    f = spark.createDataFrame(rows, "id string, document_id string, time_text string, time_start string, time_end string, created_at timestamp")
    got = {r.field: r.epoch_us for r in instants(f, spark.createDataFrame([("d", "{bad")], "id string, metadata_json string")).collect()}
    assert got == {"time_text": us(2024, 3, 5, 15), "time_start": us(2024, 3, 5, 14, 30), "time_end": us(2024, 3, 5, 14, 30)}


FACTS = "id string, document_id string, time_text string, time_start string, time_end string, created_at timestamp"


def local(t, zone):
    return t.astimezone(zoneinfo.ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M")


def test_zones_of_all_offset_histories_are_estimated(spark):
    """Zones that no document states and that aren't among ``CANDIDATES``; a zone with the same offsets is as good."""
    zones, rnd, rows, true = ("America/St_Johns", "America/Bogota", "America/Santiago", "Africa/Johannesburg", "Africa/Cairo", "Asia/Tehran", "Asia/Yangon", "Australia/Adelaide", "Pacific/Auckland", "Pacific/Chatham", "Pacific/Pago_Pago"), random.Random(3), [], {}
    for z in zones:
        for k in range(40):
            at = dt.datetime(2023, 1, 1, 12, tzinfo=UTC) + dt.timedelta(days=9 * k, hours=rnd.randrange(24))
            true[z, k] = at - dt.timedelta(minutes=rnd.randint(1, 59))
            rows.append((f"{z}{k}", z, local(true[z, k], z), None, None, at))
    f, files = spark.createDataFrame(rows, FACTS), spark.createDataFrame([(z, None) for z in zones], "id string, metadata_json string")
    got = {r.document_id: r.zone for r in zone_estimates(f, files).collect()}
    assert [z for z in zones if any(local(true[z, k], z) != local(true[z, k], got[z]) for k in range(40))] == []
    assert {r.document_id: r.zone for r in zone_estimates(f, files, candidates=("UTC", "Asia/Tokyo")).collect()}["Pacific/Auckland"] == "Asia/Tokyo"


def test_long_lags_of_western_zones_are_kept(spark):
    """Lags of up to 12 hours, as of stamps with an offset: from Los Angeles the longer ones lie over 14 hours back."""
    rows = []
    for k in range(120):
        at = dt.datetime(2023, 5, 1, tzinfo=UTC) + dt.timedelta(hours=7 * k)
        t = at - dt.timedelta(minutes=6 * k)
        rows += [(f"a{k}", "told", t.strftime("%Y-%m-%dT%H:%M:00Z"), None, None, at), (f"b{k}", "la", local(t, "America/Los_Angeles"), None, None, at), (f"c{k}", "tokyo", local(t, "Asia/Tokyo"), None, None, at)]
    got = {r.document_id: (r.zone, r.n) for r in zone_estimates(spark.createDataFrame(rows, FACTS), spark.createDataFrame([("la", None)], "id string, metadata_json string")).collect()}
    assert got == {"la": ("America/Los_Angeles", 120), "tokyo": ("Asia/Tokyo", 120)}


def test_instants_by_estimated_zone(spark, scratch):
    at = [dt.datetime(2023, 1, 1, 18, tzinfo=UTC) + dt.timedelta(days=9 * k) for k in range(40)]
    rows = [(f"e{k}", "ny", local(t - dt.timedelta(minutes=5), "America/New_York"), None, None, t) for k, t in enumerate(at)]
    rows += [("old", "ny", "2010-07-01 12:00", "2010-07-01 12:00 JST", "2010", at[0]), ("old", "ny", "2010-07-01 12:00", None, None, at[1]), ("told", "berlin", "2010-07-01 12:00", None, None, at[0]), ("far", "lone", "2010-07-01 12:00", None, None, at[0]), ("null", None, None, "2010-07-01 12:00", None, None)]
    f, files = spark.createDataFrame(rows, FACTS), spark.createDataFrame([("ny", None), ("berlin", '{"timezone": "Europe/Berlin"}'), ("lone", "{bad")], "id string, metadata_json string")
    got = {(r.fact_id, r.field): (r.epoch_us, r.zone, r.told_by, r.n) for r in estimated_instants(f, files, scratch).collect()}
    assert len(got) == 45 and all(got[f"e{k}", "time_text"][0] == us(2023, 1, 1, 17, 55) + 9 * k * 86_400_000_000 for k in range(40))
    assert got["old", "time_text"] == (us(2010, 7, 1, 16), "America/New_York", "estimate", 40) and got["old", "time_start"] == (us(2010, 7, 1, 3), None, "stamp", None)
    assert got["told", "time_text"] == (us(2010, 7, 1, 10), "Europe/Berlin", "document", None)
    assert got["far", "time_text"] == got["null", "time_start"] == (us(2010, 7, 1, 12), "UTC", "none", None)
    # the required result goes by what is stated
    plain = {(r.fact_id, r.field): r.epoch_us for r in instants(f, files).collect()}
    assert plain.keys() == got.keys() and plain["old", "time_text"] == us(2010, 7, 1, 12)
    assert estimated_instants(f.limit(0), files, scratch).count() == 0
