"""Problem 7: points in time in many notations as one instant in UTC.

A stamp is read by an Arrow function into a local time, an offset and a zone id;
strings that can't be a stamp never leave the JVM.  The conversion runs in the
JVM, with the rule that a local time which a clock change skips or repeats takes
the offset in force before the change.  A stamp without offset or zone takes the
zone of its document, which the documents' metadata state; where they don't, the
input's definition says UTC, so estimated zones (``zone_estimates``) and the instants
they give (``estimated_instants``) stand beside the result and never change it.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
import zoneinfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.session import Scratch

# Zone abbreviations (European, North American, Japanese, eastern Australian), hours from UTC.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "IST": 1, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "NST": -3.5, "NDT": -2.5, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
    "JST": 9, "AEST": 10, "AEDT": 11,
}
# Month names, English, German, French, Spanish, Italian.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene gennaio gen", 2: "february feb februar février févr fevrier febrero febbraio", 3: "march mar märz mrz mars marzo", 4: "april apr avril avr abril abr aprile",
    5: "may mai mayo maggio mag", 6: "june jun juni juin junio giugno giu", 7: "july jul juli juillet juil julio luglio lug", 8: "august aug août aout agosto ago", 9: "september sep sept septembre septiembre settembre set",
    10: "october oct oktober okt octobre octubre ottobre ott", 11: "november nov novembre noviembre", 12: "december dec dezember dez décembre déc decembre diciembre dic dicembre",
}
_MONTH = {w: m for m, ws in MONTHS.items() for w in ws.split()}

#: What a string must hold to be worth reading (no less than the patterns below ask for).
MAYBE = r"(?iU)\d\s?[:h]\s?\d\d|\d\s*[ap]\.?\s?m\b|^\s*-?\d{9,19}\s*$|\d{8}T?\d{4}"

_TIME = re.compile(r"(?<!\d)(\d{1,2})\s?[:h]\s?(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([ap])\.?\s?m\b\.?)?|(?<!\d)(\d{1,2})\s*([ap])\.?\s?m\b\.?", re.I)
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?\s*(Z|[+-]\d{2}:?\d{2})?")
_OFFSET = re.compile(r"(?:\b(?:UTC|GMT)\s*([+\-−])\s*(\d{1,2})(?::?(\d{2}))?)(?!\d)")
_NUMERIC = re.compile(r"^\s*([+\-−])(\d{2}):?(\d{2})?(?!\d)")
_REGION = re.compile(r"\b[A-Z][A-Za-z]+(?:/[A-Za-z_]+(?:[+-]\d+)?)+\b")
_ABBR = re.compile(r"(?<![A-Za-z/])(" + "|".join(sorted(ZONES, key=len, reverse=True)) + r")(?![A-Za-z/])")
_YMD = re.compile(r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)")
_NUM = re.compile(r"(?<!\d)(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})(?!\d)")
_DMONY = re.compile(r"(?<!\d)(\d{1,2})(?:st|nd|rd|th)?\.?[\s-]*(?:de\s+)?([^\W\d_]{3,})\.?,?[\s-]*(?:de\s+)?(\d{4}|\d{2})(?!\d)")
_MONDY = re.compile(r"([^\W\d_]{3,})\.?\s*(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)")

STAMP = T.StructType([T.StructField("local_us", T.LongType()), T.StructField("offset_s", T.IntegerType()), T.StructField("zone", T.StringType())])
_EPOCH = dt.datetime(1970, 1, 1)


@functools.lru_cache(maxsize=1)
def regions() -> frozenset[str]:
    return frozenset(zoneinfo.available_timezones())


def _micros(y, mo, d, h, mi, s=0, frac="") -> int | None:
    extra = 0
    if h == 24 and mi == 0 and not s:
        h, extra = 0, 86_400_000_000
    if s == 60:
        s, extra = 59, 1_000_000
    try:
        t = dt.datetime(y, mo, d, h, mi, s)
    except ValueError:
        return None
    return (t - _EPOCH) // dt.timedelta(microseconds=1) + int((frac or "")[:6].ljust(6, "0") or 0) + extra


def _date(s: str, month_first: bool) -> tuple[int, int, int] | None:
    if m := _YMD.search(s):
        return int(m[1]), int(m[2]), int(m[3])
    if m := _NUM.search(s):
        a, b, y = int(m[1]), int(m[3]), int(m[4]) + (2000 if len(m[4]) == 2 else 0)
        first = month_first if m[2] == "/" else False
        if (a if first else b) > 12 >= (b if first else a):
            first = not first
        return (y, a, b) if first else (y, b, a)
    for m in _DMONY.finditer(s):
        if mo := _MONTH.get(m[2].lower()):
            return int(m[3]) + (2000 if len(m[3]) == 2 else 0), mo, int(m[1])
    for m in _MONDY.finditer(s):
        if mo := _MONTH.get(m[1].lower()):
            return int(m[3]), mo, int(m[2])
    return None


def read_stamp(text: str | None, date_order: str | None = None) -> tuple[int, int | None, str | None] | None:
    """(local microseconds, offset in seconds or None, zone id or None) of a point in
    time; None for null, for dates, periods and anything else."""
    s = (text or "").strip()
    if not s:
        return None
    if re.fullmatch(r"-?\d{9,11}|-?\d{13}|-?\d{16}|-?\d{19}", s):
        n, k = int(s), len(s.lstrip("-"))
        return (n * 1_000_000 if k <= 11 else n * 1000 if k == 13 else n if k == 16 else n // 1000), 0, None
    if m := _COMPACT.fullmatch(s):
        us = _micros(*(int(m[i]) for i in range(1, 6)), int(m[6] or 0), m[7])
        if us is None:
            return None
        z = m[8]
        off = None if z is None else 0 if z == "Z" else (1 if z[0] == "+" else -1) * (int(z[1:3]) * 3600 + int(z[-2:]) * 60)
        return us, off, None
    m = _TIME.search(s)
    if not m:
        return None
    if m[6]:
        h, mi, sec, frac, half = int(m[6]), 0, 0, "", m[7]
    else:
        h, mi, sec, frac, half = int(m[1]), int(m[2]), int(m[3] or 0), m[4], m[5]
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half.lower() == "p" else 0)
    head, tail = s[: m.start()], s[m.end() :]
    date = _date(head, date_order == "MDY") or _date(tail, date_order == "MDY") or _date(head + " " + tail, date_order == "MDY")
    if not date:
        return None
    us = _micros(*date, h, mi, sec, frac)
    if us is None:
        return None
    off = zone = None
    if o := _NUMERIC.match(tail):
        off = (1 if o[1] == "+" else -1) * (int(o[2]) * 3600 + int(o[3] or 0) * 60)
    elif re.match(r"\s*Z\b", tail):
        off = 0
    elif o := _OFFSET.search(s):
        off = (1 if o[1] == "+" else -1) * (int(o[2]) * 3600 + int(o[3] or 0) * 60)
    elif (o := _REGION.search(s)) and o[0] in regions():
        zone = o[0]
    elif o := _ABBR.search(tail) or _ABBR.search(head):
        off = int(ZONES[o[1]] * 3600)
    return us, off, zone


@F.pandas_udf(STAMP)
def _read(text: pd.Series, order: pd.Series) -> pd.DataFrame:
    memo: dict = {}
    out = []
    for k in zip(text, order):
        if k not in memo:
            memo[k] = read_stamp(*k) or (None, None, None)
        out.append(memo[k])
    f = pd.DataFrame(out, columns=["local_us", "offset_s", "zone"])
    return f.astype({"local_us": "Int64", "offset_s": "Int32"})


def instant(text: Column, order: Column, zone: Column) -> Column:
    """Microseconds since 1970 UTC of a stamp; ``zone`` holds where it states none."""
    r = _read(text, order)
    return _instant(r, zone)


def _instant(r: Column, zone: Column) -> Column:
    local = F.timestamp_micros(r["local_us"])
    shifted = F.unix_micros(F.to_utc_timestamp(local, F.coalesce(r["zone"], zone, F.lit("UTC"))))
    return F.when(r["offset_s"].isNotNull(), r["local_us"] - r["offset_s"].cast("long") * 1_000_000).otherwise(shifted)


def document_context(files: DataFrame) -> DataFrame:
    """(document_id, zone, date_order) from the files' metadata; malformed metadata,
    unknown zones and unknown orders give null.  A file listed twice gives one row."""
    meta = F.col("metadata_json")
    zone, order = F.get_json_object(meta, "$.timezone"), F.upper(F.get_json_object(meta, "$.date_order"))
    # the zones of the machine's database, some 600 rows
    known = F.broadcast(files.sparkSession.createDataFrame([(z,) for z in sorted(regions())], "known string"))
    f = files.where("id is not null").select(F.col("id").alias("document_id"), zone.alias("zone"), F.when(order.isin("DMY", "MDY"), order).alias("date_order"))
    f = f.join(known, F.col("zone") == F.col("known"), "left")
    return f.groupBy("document_id").agg(F.max("known").alias("zone"), F.max("date_order").alias("date_order"))


FIELDS = ("time_text", "time_start", "time_end")


def stamps(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(fact_id, document_id, field, text, created_at, zone, stamp) of all points in
    time; ``stamp`` is what ``read_stamp`` gives, ``zone`` the document's."""
    each = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS)), lambda x: x["text"].rlike(MAYBE))
    t = facts.where("id is not null").select(F.col("id").alias("fact_id"), "document_id", "created_at", F.explode(each).alias("x")).select("fact_id", "document_id", "created_at", "x.field", "x.text")
    t = t.join(document_context(files), "document_id", "left")
    return t.withColumn("stamp", _read("text", "date_order")).where("stamp.local_us is not null").drop("date_order")


def instants(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(fact_id, field, epoch_us) of every point in time that ``facts`` hold.

    Null, empty and unreadable fields, mere dates and periods have no row; a fact
    delivered twice has one; a document without ``files`` row counts as UTC.
    """
    s = stamps(facts, files)
    return s.select("fact_id", "field", _instant(F.col("stamp"), F.col("zone")).alias("epoch_us")).distinct()


#: Of zones that fit equally well these come first, one for each offset history that matters commercially.
CANDIDATES = ("UTC", "Europe/London", "Europe/Berlin", "Europe/Helsinki", "Europe/Moscow", "Asia/Dubai", "Asia/Kolkata", "Asia/Kathmandu", "Asia/Shanghai", "Asia/Tokyo", "Australia/Sydney", "America/Sao_Paulo", "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "Pacific/Honolulu")
MINUTE = 60_000_000
HALF_HOUR = 30 * MINUTE
DAY = 48 * HALF_HOUR


def offset_histories(spark: SparkSession, days: list[int], named: tuple[str, ...]) -> tuple[str, ...]:
    """``named`` and one zone for every other offset history that the JVM's zones have on ``days``
    (microseconds of their starts in UTC): the offset of each day and, where it changes, of each half hour."""
    ids = spark._jvm.java.lang.String.join(",", spark._jvm.java.time.ZoneId.getAvailableZoneIds()).split(",")
    # the zones of both databases, some 600 rows
    zones = spark.createDataFrame([(z,) for z in sorted({*regions()} & {*ids} | {*named})], "zone string")
    at, day = F.col("at"), F.col("day")
    offset = lambda t: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(t), F.col("zone"))) - t
    points = F.when(offset(day) == offset(day + DAY), F.array("day")).otherwise(F.sequence(day, day + DAY - HALF_HOUR, F.lit(HALF_HOUR)))
    of = spark.createDataFrame([(d,) for d in days], "day long").crossJoin(F.broadcast(zones)).select("zone", F.explode(points).alias("at"))
    history = dict(of.groupBy("zone").agg(F.bit_xor(F.xxhash64(at, offset(at)))).collect())  # a row a zone
    known, more = {history[z] for z in named}, []
    # names of places before those of mere offsets
    for z in sorted({*history} - {*named}, key=lambda z: ("/" not in z or z.startswith("Etc/"), z)):
        if history[z] not in known:
            known.add(history[z])
            more.append(z)
    return (*named, *more)


def zone_estimates(facts: DataFrame, files: DataFrame, slack_hours: float = 14.0, candidates: tuple[str, ...] | None = None) -> DataFrame:
    """(document_id, stated_zone, zone, ties, n, violations, away): the zone whose offset
    history puts the local stamps of a document best before their ingestion.

    A stamp that comes out later than it was ingested is a violation; of zones with the
    fewest, the one comes first under which the time between stamp and ingestion, in minutes
    on average, is nearest to what is usual (``away``): the median of the stamps that state
    an offset or zone, else none. So an offset too far east and one too far west both cost.
    ``ties`` counts the zones that do as well, the chosen one included: one is an answer.

    Only stamps that some zone puts less than ``slack_hours``, the range of offsets, before
    ``created_at`` can tell zones apart; they are counted per document and zone with partial
    aggregates. ``candidates`` are ``CANDIDATES``, all zones that documents state and one zone
    for every other offset history there is on the days of these stamps (``offset_histories``),
    unless given. Among equally good zones UTC comes first, then the order of the candidates.
    """
    return _estimates(stamps(facts, files), files, slack_hours, candidates)


def _estimates(s: DataFrame, files: DataFrame, slack_hours: float = 14.0, candidates: tuple[str, ...] | None = None) -> DataFrame:
    slack = int(slack_hours * 3.6e9)
    s = s.where("created_at is not null").withColumn("at", F.unix_micros("created_at"))
    undated = F.col("stamp.offset_s").isNull() & F.col("stamp.zone").isNull()
    # offset less time to ingestion: either may take up the slack
    near = undated & (F.col("stamp.local_us") - F.col("at")).between(-2 * slack, slack)
    lag = F.when(~undated, F.col("at") - _instant(F.col("stamp"), F.col("zone")))
    seen = s.agg(F.percentile_approx(F.when(lag.between(0, slack), lag), 0.5).alias("usual"), F.collect_set(F.when(near, F.floor(F.col("at") / DAY))).alias("days")).first()  # as many days as there are
    usual = seen.usual or 0
    if candidates is None:
        stated = [r.zone for r in document_context(files).where("zone is not null").select("zone").distinct().collect()]  # at most the zones there are
        candidates = (*CANDIDATES, *sorted({*stated} - {*CANDIDATES}))
        if seen.days:
            reach = 3 * slack // DAY + 1
            candidates = offset_histories(s.sparkSession, sorted({(d + k) * DAY for d in seen.days for k in range(-reach, reach + 1)}), candidates)
    tried = s.where(near).select("document_id", "zone", "at", "stamp", F.posexplode(F.array(*map(F.lit, candidates))).alias("rank", "candidate"))
    lag = F.col("at") - F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col("stamp.local_us")), F.col("candidate")))
    c = tried.withColumn("lag", lag).groupBy("document_id", "zone", "rank", "candidate").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lag") < 0).alias("violations"), F.round(F.avg(F.abs(F.col("lag") - usual)) / MINUTE).cast("long").alias("away"))
    cost = F.struct("violations", "away")
    # one row a candidate
    best = c.groupBy("document_id", F.col("zone").alias("stated_zone")).agg(F.min_by("candidate", F.struct(cost, "rank")).alias("zone"), F.collect_list(cost).alias("all"), F.min(cost).alias("low"), F.max("n").alias("n"))
    return best.select("document_id", "stated_zone", "zone", F.size(F.filter("all", lambda x: x == F.col("low"))).alias("ties"), "n", F.col("low.violations").alias("violations"), F.col("low.away").alias("away"))


def estimated_instants(facts: DataFrame, files: DataFrame, scratch: Scratch) -> DataFrame:
    """(fact_id, field, epoch_us, zone, told_by, ties, n) of every point in time, as ``instants``,
    save that the zone that neither the stamp nor its document tells is the estimated one.

    ``told_by`` is ``stamp``, ``document``, ``estimate`` or, where no stamp of the document
    can tell, ``none`` (UTC); ``ties`` and ``n`` are those of an estimate.
    """
    s = scratch.write(stamps(facts, files))
    e = _estimates(s, files).where("stated_zone is null").select("document_id", F.col("zone").alias("estimate"), "ties", "n")
    s = s.join(e, "document_id", "left")
    own = F.col("stamp.offset_s").isNotNull() | F.col("stamp.zone").isNotNull()
    told = F.when(own, "stamp").when(F.col("zone").isNotNull(), "document").when(F.col("estimate").isNotNull(), "estimate").otherwise("none")
    zone = F.coalesce("zone", "estimate", F.lit("UTC"))
    s = s.select("fact_id", "field", _instant(F.col("stamp"), zone).alias("epoch_us"), F.when(own, F.col("stamp.zone")).otherwise(zone).alias("zone"), told.alias("told_by"), "ties", "n")
    return s.select(*s.columns[:5], *(F.when(F.col("told_by") == "estimate", F.col(c)).alias(c) for c in ("ties", "n"))).distinct()
