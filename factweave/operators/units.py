"""Problem 4: amounts of facts in one common unit per dimension.

1. An Arrow function reads each fact into a number, a scale, a unit phrase (or a
   currency); what ``value_text`` leaves open is taken from ``unit`` and
   ``currency``, else from the words beside the number in ``source_quote``.
2. The sources of the graph are the ways in which amounts are recorded: unit phrases.
   Its seeds are the codes of ``unit_factors``. Facts of one entity, metric and time
   state one quantity; what the resolved sources say of it, in the common unit, is put
   together as a median. A source that isn't resolved yet is compared with these
   quantities over all entities: its scale is the densest place of the ratios, for
   dimensions with an offset the offset that belongs to each known scale is the densest
   place of the differences. The estimate is snapped to the known conversion if one is
   that near and enough quantities agree. Newly resolved sources resolve further
   quantities, until no source is new.
3. The fixed spellings below check the result: a phrase that the graph can't resolve,
   because too few quantities hold it, or resolves otherwise, is read by the table.
4. Amounts are converted with exact factors of ``unit_factors`` in the JVM.

Only one row per (entity, metric, time, phrase) enters step 2, pre-aggregated with a
median of bounded memory; sources meet quantities, never each other in pairs.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of the unit codes of unit_factors. Lower case unless case tells units apart.
PHRASES = {
    "kg": "kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes", "g": "g gram grams gramme grammes gm", "t": "t tonne tonnes mt|metric ton|metric tons|metric tonne|metric tonnes", "kt": "kt kilotonne kilotonnes kiloton kilotons",
    "lb": "lb lbs pound pounds", "oz": "oz ounce ounces", "short_ton": "short ton|short tons|us ton|us tons", "long_ton": "long ton|long tons|imperial ton|imperial tons|uk tons",
    "m": "m metre metres meter meters", "km": "km kilometre kilometres kilometer kilometers", "mi": "mi mile miles|statute mile|statute miles", "ft": "ft foot feet", "in": "in inch inches", "nmi": "nmi nm|nautical mile|nautical miles", "yd": "yd yds yard yards",
    "m2": "m2 m² sqm|sq m|square metre|square metres|square meter|square meters", "ha": "ha hectare hectares", "km2": "km2 km²|sq km|square kilometre|square kilometres|square kilometer|square kilometers", "acre": "acre acres ac", "sqft": "sqft ft2 ft²|sq ft|square foot|square feet",
    "l": "l litre litres liter liters ltr", "m3": "m3 m³ cbm|cubic metre|cubic metres|cubic meter|cubic meters|cu m", "gal_us": "gal_us gallon gallons|us gal|us gallon|us gallons", "gal_uk": "gal_uk|imp gal|imperial gallon|imperial gallons|uk gal|uk gallons", "bbl": "bbl bbls barrel barrels", "hl": "hl hectolitre hectolitres hectoliter hectoliters",
    "MJ": "mj megajoule megajoules", "GJ": "gj gigajoule gigajoules", "kWh": "kwh kilowatt-hour kilowatt-hours|kilowatt hour|kilowatt hours", "MWh": "mwh megawatt-hour megawatt-hours|megawatt hour|megawatt hours", "GWh": "gwh gigawatt-hour gigawatt-hours|gigawatt hour|gigawatt hours", "MMBtu": "mmbtu|million btu",
    "s": "s sec secs second seconds", "min": "min mins minute minutes", "h": "h hr hrs hour hours", "d": "d day days", "wk": "wk wks week weeks",
    "byte": "b byte bytes", "kB": "kb kilobyte kilobytes", "MB": "mb megabyte megabytes", "GB": "gb gigabyte gigabytes", "KiB": "kib kibibyte kibibytes", "MiB": "mib mebibyte mebibytes", "GiB": "gib gibibyte gibibytes",
    "degC": "degc °c celsius|deg c|degree celsius|degrees celsius|° c", "degF": "degf °f fahrenheit|deg f|degree fahrenheit|degrees fahrenheit|° f", "K": "k kelvin kelvins",
    "percent": "percent % pct|per cent", "bp": "bp bps|basis point|basis points", "permille": "permille ‰|per mille|per mil|per thousand", "fraction": "fraction|ratio of 1",
}
KNOWN = {p: code for code, ps in PHRASES.items() for part in ps.split("|") for p in ([part] if " " in part and any(part == q for q in ps.split("|")[1:]) else part.split())}
# Scale words; single letters count in amounts of money only.
SCALES = {"thousand": 1e3, "thousands": 1e3, "ths": 1e3, "tsd": 1e3, "million": 1e6, "millions": 1e6, "mio": 1e6, "mn": 1e6, "mln": 1e6, "billion": 1e9, "billions": 1e9, "bn": 1e9, "bln": 1e9, "trillion": 1e12, "tn": 1e12, "trn": 1e12, "lakh": 1e5, "lakhs": 1e5, "crore": 1e7, "crores": 1e7, "hundred": 1e2}
LETTERS = {"k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}
# Currency signs, longest first, and ISO codes.
SIGNS = {"US$": "USD", "AU$": "AUD", "CA$": "CAD", "NZ$": "NZD", "HK$": "HKD", "A$": "AUD", "C$": "CAD", "S$": "SGD", "R$": "BRL", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW", "₽": "RUB", "₺": "TRY", "฿": "THB", "₪": "ILS", "₴": "UAH"}
CODES = "USD EUR GBP JPY CHF SEK NOK DKK AUD CAD NZD INR CNY HKD SGD KRW BRL MXN ZAR RUB TRY PLN CZK HUF ILS THB AED SAR IDR MYR PHP TWD".split()

_CODE = re.compile(r"(?<![A-Za-z])(" + "|".join(CODES) + r")(?![A-Za-z])", re.I)
_SIGN = re.compile("|".join(map(re.escape, SIGNS)))
_SPACE = "     "
_NUMBER = re.compile(rf"\d(?:[\d.,'’]|[{_SPACE}](?=\d{{3}}(?!\d)))*")
_VAGUE = re.compile(r"^(?:about|approx(?:imately)?\.?|some|around|circa|ca\.?|roughly|nearly|almost|over|under|~|≈)(?=[\s\d(~+\-−$€£¥₹]|$)\s*", re.I)
_DIGITLIKE = tuple("0123456789.,")
_TAIL = re.compile(r"\s+(?:in total|at [A-Z][^.]*)?\.?\s*$")

READ = T.StructType([T.StructField("number", T.DoubleType()), T.StructField("scale", T.DoubleType()), T.StructField("phrase", T.StringType()), T.StructField("currency", T.StringType())])


@functools.lru_cache(maxsize=1 << 14)
def number(s: str) -> float | None:
    """The value of a written number: grouping by comma, point, apostrophe or a
    space; a comma before one or two final digits only is a decimal comma."""
    s = re.sub(rf"[{_SPACE}'’]", "", s).rstrip(".,")
    if "," in s and "." in s:
        s = s.replace(".", "").replace(",", ".") if s.rfind(",") > s.rfind(".") else s.replace(",", "")
    elif "," in s:
        s = s.replace(",", ".") if re.fullmatch(r"\d+,\d{1,2}", s) else s.replace(",", "")
    elif s.count(".") > 1:
        s = s.replace(".", "")
    try:
        return float(s)
    except ValueError:
        return None


@functools.lru_cache(maxsize=1 << 14)
def currency(s: str | None) -> tuple[str | None, str]:
    """The currency a text states, and the text without it."""
    if not s:
        return None, ""
    if m := _SIGN.search(s):
        return SIGNS[m[0]], s[: m.start()] + " " + s[m.end() :]
    if m := _CODE.search(s):
        return m[1].upper(), s[: m.start()] + " " + s[m.end() :]
    return None, s


def words(s: str) -> list[str]:
    return [w for w in (x.strip(".,;:()-−–") for x in re.split(r"\s+", s)) if w]


@functools.lru_cache(maxsize=1 << 14)
def scale_and_phrase(s: str, money: bool) -> tuple[float | None, str]:
    """The scale words of a text and what is left, the unit phrase."""
    scale, rest = None, []
    for w in words(s):
        f = SCALES.get(w.lower()) or (LETTERS.get(w.lower()) if money else None)
        if f and rest != ["per"]:
            scale = (scale or 1.0) * f
        else:
            rest.append(w)
    return scale, " ".join(rest)


def split_value(v: str) -> tuple[str, float, str] | None:
    """(text before, signed number, text after) of the first number."""
    v = _VAGUE.sub("", unicodedata.normalize("NFC", v).strip())
    m = _NUMBER.search(v)
    if not m:
        return None
    n = number(m[0])
    if n is None:
        return None
    head, tail = v[: m.start()], v[m.end() :]
    if head.rstrip().endswith("(") and tail.lstrip().startswith(")"):
        return head.rstrip()[:-1], -n, tail.lstrip()[1:]
    if re.search(r"[-−–]\s*$", head):
        return re.sub(r"[-−–]\s*$", "", head), -n, tail
    return head, n, tail


@functools.lru_cache(maxsize=1 << 14)
def norm(phrase: str) -> str:
    """A unit phrase in the form of the table; letter case is dropped where it doesn't tell units apart."""
    return re.sub(r"\s+", " ", phrase).strip().lower()


def beside(quote: str | None, value: str) -> str:
    """The words of a quote around the number of ``value``: before it back to the last
    word that is no currency, after it up to the place or the end of the quote."""
    if not quote:
        return ""
    m = _NUMBER.search(value)
    if not m:
        return ""
    q = unicodedata.normalize("NFC", quote)
    at = q.rfind(m[0])
    while at >= 0 and (q[at - 1 : at] in _DIGITLIKE and at > 0 or q[at + len(m[0]) : at + len(m[0]) + 1].isdigit()):
        at = q.rfind(m[0], 0, at)
    if at < 0:
        return ""
    q = _TAIL.sub("", q)
    head, tail = q[:at], q[at + len(m[0]) :]
    h = re.search(r"(\S*)[\s(−-]*$", head)
    return (h[1] if h and currency(h[1])[0] else "") + " " + tail.lstrip(" )")


def read_amount(value: str | None, unit: str | None, cur: str | None, quote: str | None) -> tuple | None:
    """(number, scale, phrase, currency) of a fact's amount; ``phrase`` is None for
    money. None if no amount of a unit or currency is stated."""
    if not value:
        return None
    v = split_value(value)
    if not v:
        return None
    head, n, tail = v
    money, own = currency(head + " " + tail)
    from_unit, unit_rest = currency(unit)
    if not money and not head.strip() and norm(own) in KNOWN and norm(own) not in LETTERS:
        return n, 1.0, norm(own), None
    if not money:
        s, phrase = scale_and_phrase(own, False)
        if phrase and norm(phrase) not in LETTERS and not re.fullmatch(r"[\W_]*", phrase):
            return n, s or 1.0, norm(phrase), None
    stated = money or currency(cur)[0] or from_unit
    if not stated:
        # a phrase of the unit column, or of the quote, that isn't money
        s, phrase = scale_and_phrase(own, False)
        if unit and unit.strip() and not phrase:
            us, up = scale_and_phrase(unit, False)
            if up and norm(up) in KNOWN and not (norm(up) in LETTERS and currency(beside(quote, value))[0]):
                return n, s or us or 1.0, norm(up), None
            if up and norm(up) not in LETTERS:
                return n, s or us or 1.0, norm(up), None
        near = beside(quote, value)
        quoted = currency(near)[0]
        if quoted:
            stated = quoted
        else:
            if phrase:  # a single letter of value_text that no currency explains
                return n, s or 1.0, norm(phrase), None
            if unit and unit.strip():
                return None
            ns, np_ = scale_and_phrase(near, False)
            return (n, s or ns or 1.0, norm(np_), None) if np_ else None
    s, _ = scale_and_phrase(own, True)
    if s is None:
        if unit_rest.strip():
            s, _ = scale_and_phrase(unit_rest, True)
        elif not (unit and unit.strip()):
            s, _ = scale_and_phrase(currency(beside(quote, value))[1], True)
    return n, s or 1.0, None, stated


@F.pandas_udf(READ)
def _read(value: pd.Series, unit: pd.Series, cur: pd.Series, quote: pd.Series) -> pd.DataFrame:
    out = [read_amount(*x) or (None, None, None, None) for x in zip(value, unit, cur, quote)]
    return pd.DataFrame(out, columns=["number", "scale", "phrase", "currency"])


def amounts(facts: DataFrame) -> DataFrame:
    """(fact_id, entity_id, predicate, time, number, scale, phrase, currency) of facts whose
    ``value_text`` holds a number beside a unit or currency."""
    f = facts.where("id is not null").where(F.col("value_text").rlike(r"\d"))
    f = f.select(F.col("id").alias("fact_id"), "entity_id", F.lower(F.regexp_replace("predicate", r"[\s_-]+", "_")).alias("predicate"), F.col("time_text").alias("time"), _read("value_text", "unit", "currency", "source_quote").alias("a"))
    return f.where("a.number is not null").select("fact_id", "entity_id", "predicate", "time", "a.*")


def phrase_table(spark, known: dict[str, str] | None = None) -> DataFrame:
    """(phrase, unit_code) of the fixed spellings."""
    return spark.createDataFrame(sorted((known or KNOWN).items()), "phrase string, unit_code string")


#: Ratios fall together within about so much of their logarithm, differences within so much of the common unit.
STEP, OFFSET_STEP = 0.004, 0.5
#: A conversion is snapped to if the estimate is within so many steps of it, and so many
#: quantities agree with it, this share of those that the source meets.
NEAR, MIN_VOTES, MIN_SHARE = 2, 3, 0.25
GROUP = ["entity_id", "predicate", "time"]


def quantities(read: DataFrame) -> DataFrame:
    """(entity_id, predicate, time, phrase, x): what each source says of a quantity that
    several sources state; null keys and zeros say nothing."""
    n = read.where("phrase is not null and entity_id is not null and predicate is not null and time is not null and number <> 0")
    n = n.groupBy(*GROUP, "phrase").agg(F.percentile_approx(F.col("number") * F.col("scale"), 0.5, 1000).alias("x"))
    several = n.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*GROUP)
    return n.join(several, GROUP, "left_semi")


def _densest(df: DataFrame, by: list[str], value: str, step: float) -> DataFrame:
    """(by, votes, estimate): how many values lie in the densest three neighbouring steps of
    each group, and their mean."""
    h = df.groupBy(*by, F.floor(F.col(value) / step).alias("b")).agg(F.count(F.lit(1)).alias("c"), F.sum(value).alias("s"))
    wide = h.select(*by, "c", "s", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b")).groupBy(*by, "b").agg(F.sum("c").alias("votes"), F.sum("s").alias("s"))
    return wide.groupBy(*by).agg(F.max(F.struct("votes", F.col("s") / F.col("votes"), "b")).alias("m")).select(*by, F.col("m.votes").alias("votes"), F.col("m.col2").alias("estimate"))


def learn_sources(read: DataFrame, factors: DataFrame, seeds: DataFrame, scratch) -> DataFrame:
    """(phrase, unit_code, n, votes, scale, offset) of the phrases of ``read``, which holds
    amounts(), that the graph resolves from ``seeds`` (phrase, unit_code): how many quantities
    the phrase meets, how many agree, and the estimate before it was snapped."""
    conv = factors.select("unit_code", "dimension", "factor", "shift").distinct()
    shifted = conv.where("shift <> 0").select("dimension").distinct()
    linked = scratch.write(quantities(read))
    solved = seeds.join(conv.select("unit_code"), "unit_code", "left_semi").select("phrase", "unit_code", *(F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("votes", "long"), ("scale", "double"), ("offset", "double"))))
    while True:
        # the unit codes are a fixed table of a few dozen rows
        known = linked.join(solved.select("phrase", "unit_code"), "phrase").join(F.broadcast(conv), "unit_code")
        said = known.groupBy(*GROUP, "dimension").agg(F.percentile_approx(F.col("x") * F.col("factor") + F.col("shift"), 0.5, 1000).alias("y"))
        met = scratch.write(linked.join(solved, "phrase", "left_anti").join(said, GROUP).select("phrase", "dimension", "x", "y"))
        total = met.groupBy("phrase", "dimension").agg(F.count(F.lit(1)).alias("n"))
        ratio = met.join(F.broadcast(shifted), "dimension", "left_anti").where("y / x > 0").withColumn("r", F.log(F.col("y") / F.col("x")))
        scale = _densest(ratio, ["phrase", "dimension"], "r", STEP).join(F.broadcast(conv.where("factor > 0")), "dimension")
        scale = scale.withColumn("away", F.abs(F.log("factor") - F.col("estimate"))).where(F.col("away") <= NEAR * STEP).select("phrase", "dimension", "unit_code", "votes", "away", F.exp("estimate").alias("scale"), F.lit(0.0).alias("offset"))
        each = met.join(F.broadcast(shifted), "dimension", "left_semi").join(F.broadcast(conv), "dimension").withColumn("r", F.col("y") - F.col("x") * F.col("factor"))
        offset = _densest(each, ["phrase", "dimension", "unit_code", "factor", "shift"], "r", OFFSET_STEP)
        offset = offset.withColumn("away", F.abs(F.col("shift") - F.col("estimate"))).where(F.col("away") <= NEAR * OFFSET_STEP).select("phrase", "dimension", "unit_code", "votes", "away", F.col("factor").alias("scale"), F.col("estimate").alias("offset"))
        found = scale.unionByName(offset).join(total, ["phrase", "dimension"]).where((F.col("votes") >= MIN_VOTES) & (F.col("votes") >= MIN_SHARE * F.col("n")))
        best = found.groupBy("phrase").agg(F.max_by(F.struct("unit_code", "n", "votes", "scale", "offset"), F.struct("votes", -F.col("away"), "unit_code")).alias("f"))
        new = scratch.write(best.select("phrase", "f.*"))
        scratch.drop(met)
        if new.isEmpty():
            return solved
        solved = solved.unionByName(new)


def source_units(read: DataFrame, factors: DataFrame, scratch, known: dict[str, str] | None = None) -> DataFrame:
    """(phrase, unit_code, way, n, votes, scale, offset) of every phrase that is resolved;
    ``way`` is seed, graph or table, the last for phrases that only the fixed spellings
    ``known`` explain or that these explain otherwise."""
    table = phrase_table(read.sparkSession, known)
    codes = factors.where("unit_code is not null").groupBy(F.lower("unit_code").alias("phrase")).agg(F.min("unit_code").alias("unit_code"), F.max("unit_code").alias("z")).where("unit_code = z").select("phrase", "unit_code")
    learnt = scratch.write(learn_sources(read, factors, codes, scratch))
    both = learnt.join(table.withColumnRenamed("unit_code", "stated"), "phrase", "full")
    other = F.col("unit_code").isNull() | (F.col("stated") != F.col("unit_code"))
    way = F.when(F.coalesce(other, F.lit(False)), "table").when(F.col("votes").isNull(), "seed").otherwise("graph")
    return both.select("phrase", F.coalesce("stated", "unit_code").alias("unit_code"), way.alias("way"), "n", "votes", "scale", "offset")


def common_amounts(facts: DataFrame, factors: DataFrame, scratch, known: dict[str, str] | None = None) -> DataFrame:
    """(fact_id, common_unit, common_milli) of every fact that states money, a share or
    a physical quantity.

    ``common_milli`` is 1000 times the amount in the common unit, rounded.  Facts
    without a number, counts, plain texts and phrases that nothing resolves have no
    row; a fact delivered twice has one row.
    """
    read = scratch.write(amounts(facts))
    phrases = scratch.write(source_units(read, factors, scratch, known)).select("phrase", "unit_code")
    # the unit codes are a fixed table of a few dozen rows
    units = phrases.join(F.broadcast(factors.select("unit_code", "common_unit", "factor", "shift").distinct()), "unit_code")
    value = F.col("number") * F.col("scale")
    quantity = read.where("phrase is not null").join(units, "phrase").select("fact_id", "common_unit", (value * F.col("factor") + F.col("shift")).alias("v"))
    money = read.where("currency is not null").select("fact_id", F.col("currency").alias("common_unit"), value.alias("v"))
    return quantity.unionByName(money).select("fact_id", "common_unit", F.round(F.col("v") * 1000).cast("long").alias("common_milli")).distinct()
