import random

import pytest
from pyspark.sql import functions as F

from factweave.operators.units import KNOWN, amounts, common_amounts, learn_sources, number, phrase_table, read_amount, source_units
from tests.oracle import DATA


def test_numbers():
    for s, v in [("1,234.5", 1234.5), ("1.234,5", 1234.5), ("1 234", 1234), ("1'234'567", 1234567), ("3,16", 3.16), ("3,1", 3.1), ("3,160", 3160), ("1.234", 1.234), ("1.234.567", 1234567), ("12,345,678", 12345678)]:
        assert number(s) == v, s


@pytest.mark.parametrize("args, want", [
    (("€(88.04) mio", None, "EUR", ""), (-88.04, 1e6, None, "EUR")), (("-12.62 ths.", None, "CHF", ""), (-12.62, 1e3, None, "CHF")), (("6.70", None, None, "x stated sales of 6.70 ths. GBP in total."), (6.7, 1e3, None, "GBP")),
    (("109.3", "k", "EUR", ""), (109.3, 1e3, None, "EUR")), (("14.98", "USD K", None, ""), (14.98, 1e3, None, "USD")), (("6.61", "crore", "INR", ""), (6.61, 1e7, None, "INR")), (("$5", None, None, ""), (5.0, 1.0, None, "USD")),
    (("43.8", "m", None, ""), (43.8, 1.0, "m", None)), (("441 thousand US gal", None, None, ""), (441.0, 1e3, "us gal", None)), (("131", "in.", None, ""), (131.0, 1.0, "in", None)), (("0.0820 ratio of 1", None, None, ""), (0.082, 1.0, "ratio of 1", None)),
    (("2.67", None, None, "x recorded mass of 2.67 in total."), None), (("", None, None, None), None), ((None, "kg", "USD", None), None), (("Brackwater", None, None, "x"), None), (("CAD 16.4k", None, None, ""), (16.4, 1e3, None, "CAD")),
    (("−57.2", None, None, "x recorded income of US$−57.2 million in total."), (-57.2, 1e6, None, "USD")),
])
def test_reading(args, want):
    assert read_amount(*args) == want


def facts(spark, rows):
    return spark.createDataFrame(rows, "id string, entity_id string, predicate string, value_text string, unit string, currency string, source_quote string, extra string").withColumn("time_text", F.lit("FY2020"))


def test_amounts(spark, scratch):
    u = spark.read.parquet(f"{DATA}/unit_factors.parquet")
    rows = [("a", "e", "p", "2 kt", None, None, None, "x"), ("a", "e", "p", "2 kt", None, None, None, "y"), ("b", None, None, "99 °F", None, None, None, None), ("c", "e", "p", "7 employees", None, None, None, None), (None, "e", "p", "2 kg", None, None, None, None), ("d", "e", "p", None, None, None, None, None), ("e", "e", "p", "5 bps" + " " * 100000, None, None, None, None)]
    got = {tuple(r) for r in common_amounts(facts(spark, rows), u, scratch).collect()}
    assert got == {("a", "kg", 2_000_000_000), ("b", "degC", 37222), ("e", "percent", 50)}
    assert common_amounts(facts(spark, []), u, scratch).count() == 0


def stated_twice(u, hidden, n, wrong=0.0, rounding=6):
    """Facts that state quantities once in a hidden spelling and once in another unit."""
    f = {r.unit_code: (r.factor, r["shift"]) for r in u.collect()}
    rows = []
    for k in range(n):
        for phrase, code in hidden.items():
            base = {"lb": "kg", "mi": "km", "gal_us": "l", "bp": "percent", "degF": "degC", "ha": "m2", "wk": "h", "MB": "kB"}[code]
            x = random.uniform(10, 5000)
            y = (x * f[code][0] + f[code][1] - f[base][1]) / f[base][0]
            if random.random() < wrong:
                y *= random.uniform(0.2, 5)
            rows += [(f"{k}{phrase}", f"e{k}", phrase, f"{x:.{rounding}f} {phrase}", None, None, None, None), (f"{k}{base}", f"e{k}", phrase, f"{y:.{rounding}f} {base}", None, None, None, None)]
    return rows


HIDDEN = {"pounds": "lb", "miles": "mi", "us gal": "gal_us", "bps": "bp", "°f": "degF", "hectares": "ha", "weeks": "wk", "megabytes": "MB"}


@pytest.mark.parametrize("wrong, rounding", [(0.0, 6), (0.5, 1)])
def test_unknown_sources_are_learned(spark, scratch, wrong, rounding):
    """Held-out accuracy: spellings taken out of the table come back from the graph, also where
    half the statements are of other quantities."""
    random.seed(3)
    u = spark.read.parquet(f"{DATA}/unit_factors.parquet")
    read = scratch.write(amounts(facts(spark, stated_twice(u, HIDDEN, 100, wrong, rounding))))
    seeds = phrase_table(spark, {p: c for p, c in KNOWN.items() if p not in HIDDEN})
    got = {r.phrase: r for r in learn_sources(read, u, seeds, scratch).collect()}
    assert {p: got[p].unit_code if p in got else None for p in HIDDEN} == HIDDEN
    exact = {r.unit_code: r for r in u.collect()}
    for p, c in HIDDEN.items():
        assert got[p].scale == pytest.approx(exact[c].factor, rel=0.005) and abs(got[p].offset - exact[c]["shift"]) < 1 and got[p].votes >= 30


def test_sources_of_sources_are_learned(spark, scratch):
    """A chain: each spelling meets only the one before, the first a seed."""
    random.seed(4)
    u = spark.read.parquet(f"{DATA}/unit_factors.parquet")
    rows, names = [], ["kg", *(f"unit{c}x" for c in "abcdef")]
    for j, (a, b) in enumerate(zip(names, names[1:])):
        for k in range(6):
            x = random.uniform(1, 900)
            rows += [(f"{j}-{k}a", f"e{k}", f"p{j}", f"{x:.5f} {a}", None, None, None, None), (f"{j}-{k}b", f"e{k}", f"p{j}", f"{x:.5f} {b}", None, None, None, None)]
    read = scratch.write(amounts(facts(spark, rows)))
    got = {r.phrase: (r.unit_code, r.way) for r in source_units(read, u, scratch, {"unitfx": "g", "only": "t"}).collect()}
    assert all(got[n] == ("kg", "graph") for n in names[1:6]) and got["unitfx"] == ("g", "table") and got["only"] == ("t", "table") and got["kg"] == ("kg", "seed")
