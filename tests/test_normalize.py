import pytest
from pyspark.sql import functions as F

from factweave.functions import normalize as N
from factweave.functions import text as X

NUMBERS = [
    ("1.2 billion", None, None, None, 1.2e9, None, "number"), ("1,200 million", None, None, None, 1.2e9, None, "number"), ("1,200,000 thousand", None, None, None, 1.2e9, None, "number"), ("1,200,000,000", None, None, None, 1.2e9, None, "number"),
    ("$1.2B", None, None, None, 1.2e9, "USD", "currency"), ("USD 1,200M", None, None, None, 1.2e9, "USD", "currency"), ("2.5%", None, None, None, 0.025, None, "percentage"), ("2.5 percent", None, None, None, 0.025, None, "percentage"), ("22%", None, None, None, 0.22, None, "percentage"),
    ("1,200,500.50", None, None, None, 1200500.5, None, "number"), ("€45M", None, None, None, 45e6, "EUR", "currency"), ("£10.5 billion", None, None, None, 10.5e9, "GBP", "currency"), ("¥500,000", None, None, None, 5e5, "JPY", "currency"), ("1:2", None, None, None, 0.5, None, "range"),
    ("1:0", None, None, None, None, None, "range"), ("$120 million", None, None, None, 120e6, "USD", "currency"), ("120,000 thousand USD", None, None, None, 120e6, "USD", "currency"), ("1%", None, None, None, 1.0, None, "percentage"), ("0.5%", None, None, None, 0.5, None, "percentage"),
    ("-5%", None, None, None, -5.0, None, "percentage"), ("c$5", None, None, None, 5.0, "USD", "currency"), ("45bn", None, None, None, 45.0, None, "number"), ("abc", None, None, "quantity", None, None, "quantity"), ("", "kg", "EUR", None, None, "EUR", "text"), (None, None, None, None, None, None, "text"),
    ("5 thousand million", None, None, None, 5e9, None, "number"), ("12", "%", None, None, 0.12, None, "percentage"), ("3", None, "SEK", "number", 3.0, "SEK", "currency"), ("usd 5 eur", None, None, None, 5.0, "USD", "currency"),
]


def test_numbers(spark):
    df = spark.createDataFrame([x[:4] for x in NUMBERS], "v string, u string, c string, k string")
    for r, x in zip(df.select(N.numeric(F.col("v"), F.col("u"), F.col("c"), F.col("k")).alias("n")).collect(), NUMBERS):
        assert (r.n.normalized, r.n.currency, r.n.value_type) == (pytest.approx(x[4]) if x[4] is not None else None, *x[5:]), x


PERIODS = [
    ("FY2025", None, "FY2025", None, None, "fiscal_year"), ("Fiscal Year 2025", None, "FY2025", None, None, "fiscal_year"), ("FY25", None, "FY2025", None, None, "fiscal_year"), ("FY2025", "03-31", "FY2025", "2024-04-01", "2025-03-31", "fiscal_year"), ("FY2025", "06-30", "FY2025", None, None, "fiscal_year"),
    ("Q1 2024", None, "Q1 2024", "2024-01-01", "2024-03-31", "quarter"), ("4Q 2024", None, "Q4 2024", "2024-10-01", "2024-12-31", "quarter"), ("March 2024", None, "March 2024", "2024-03-01", "2024-03-31", "month"), ("Feb 2024", None, "February 2024", "2024-02-01", "2024-02-29", "month"),
    ("2023 - 2025", None, "2023-2025", "2023-01-01", "2025-12-31", "year"), ("Q1 FY2025", None, "Q1 FY2025", None, None, "quarter"), ("2024-03-31", None, "2024", "2024-01-01", "2024-12-31", "year"), ("  so   on ", None, "so on", None, None, "unknown"), (" ", None, None, None, None, None), (None, None, None, None, None, None),
    ("FY2023-24", None, "FY2023", None, None, "fiscal_year"),
]


def test_periods(spark):
    df = spark.createDataFrame([x[:2] for x in PERIODS], "t string, e string")
    for r, x in zip(df.select(N.period(F.col("t"), F.col("e")).alias("p")).collect(), PERIODS):
        assert tuple(r.p) == x[2:], x


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_predicates_and_names(spark):
    p = lambda s: one(spark, N.predicate(F.lit(s)))
    assert p("total_revenue").predicate == p("Gross Revenue").predicate == "revenue"
    assert p("net_sales").predicate == p("Product Sales").predicate == "sales"
    assert p(" - ").predicate == p("").predicate == "unknown_predicate"
    assert one(spark, N.legal_stem(F.lit("Acme Corp."))) == one(spark, N.legal_stem(F.lit("  Acme   Corporation "))) == "Acme"
    assert one(spark, N.clean_name(F.lit(None).cast("string"))) == "Unknown Entity"
    assert one(spark, N.is_generic(F.lit("The Company")))


def test_text(spark):
    q = lambda w, n="": one(spark, X.page_quality(F.lit(w), F.lit(600.0), F.lit(800.0)))
    assert q("Scan").quality == 0.08 and q("Scan").is_scanned and q("").quality == 0.0 and q("x" * 300).quality == 1.0
    assert one(spark, X.equivalent(F.lit("San Francisco, CA"), F.lit("San Francisco, California")))
    assert one(spark, X.equivalent(F.lit("1515 3rd St, San Francisco, CA"), F.lit("1515 3rd Street San Francisco California, USA")))
    assert not one(spark, X.equivalent(F.lit("San Francisco"), F.lit("Austin")))
    assert not one(spark, X.equivalent(F.lit(None).cast("string"), F.lit("Austin")))
    assert 44 < one(spark, X.retry_delay(F.lit("Please retry in 43.505708463s"))) < 46
    assert 36 < one(spark, X.retry_delay(F.lit("'retryDelay': '35s'"))) < 37
    assert one(spark, X.retry_delay(F.lit("no"))) == 45.0
    t = lambda s: F.lit(s).cast("timestamp")
    assert [one(spark, X.duration(t("2024-01-01 00:00:00"), t(e))) for e in ("2024-01-01 00:00:48", "2024-01-01 00:14:19", "2024-01-01 00:02:00", "2023-01-01 00:00:00")] == ["48s", "14m 19s", "2m", "0s"]
    assert one(spark, X.duration(t("2024-01-01 00:00:00"), F.lit(None).cast("timestamp"))) == "-"
    assert one(spark, X.local_time(F.lit("2024-07-01T10:00:00Z"), "Europe/Berlin")) == "2024-07-01 12:00:00"
    assert one(spark, X.local_time(F.lit("nonsense"), "UTC")) == "nonsense"
    assert one(spark, X.short_title(F.lit("a" * 70))) == "a" * 62 + "..."
