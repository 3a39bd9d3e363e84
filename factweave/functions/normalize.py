"""Normalisers of numbers, periods, predicates and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import collapse, filled, literal_map, strip
from factweave.session import once

# Words and letters of magnitude.
MAGNITUDES = {
    "k": 1e3, "thousand": 1e3, "thousands": 1e3, "m": 1e6, "mn": 1e6, "mio": 1e6, "million": 1e6, "millions": 1e6,
    "b": 1e9, "bn": 1e9, "billion": 1e9, "billions": 1e9, "t": 1e12, "tn": 1e12, "trillion": 1e12, "trillions": 1e12,
}
# Currency signs in the order they are tried, and codes.
SIGNS = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), ("₩", "KRW"), ("chf", "CHF")]
CODES = ["aud", "cad", "chf", "cny", "eur", "gbp", "inr", "jpy", "krw", "nok", "sek", "usd"]


_WORD = r"(?U)\b(" + "|".join(CODES) + r")\b"
_NUMBER = r"(\d+(?:\.\d+)?)"
_RATIO = rf"^\s*{_NUMBER}\s*:\s*{_NUMBER}\s*$"


def _marks(value: Column, unit: Column, currency: Column, kind: Column) -> dict[str, Column]:
    """Currency, percentage and the text without either."""
    text = strip(F.coalesce(value, F.lit("")))
    t = F.lower(text)
    sign = F.coalesce(*(F.when(F.contains(t, F.lit(s)), c) for s, c in reversed(SIGNS)))
    t = F.regexp_replace(t, r"[$€£¥₹₩]|chf", " ")
    code = F.upper(F.array_max(F.regexp_extract_all(t, F.lit(_WORD), 1)))
    t = F.regexp_replace(t, _WORD, " ")
    pct = F.coalesce(t.rlike("%|percent|pct"), F.lit(False)) | F.coalesce(kind == "percentage", F.lit(False)) | F.coalesce(F.contains(unit, F.lit("%")), F.lit(False))
    return {"blank": text == "", "cur": F.coalesce(code, sign, currency), "pct": pct, "t": F.regexp_replace(t, "%|percentage|percent|pct", " ")}


def _magnitude(word: Column) -> Column:
    return F.try_element_at(literal_map(MAGNITUDES), F.regexp_replace(word, r"^[.,;:()]+|[.,;:()]+$", ""))


def _words(t: Column) -> dict[str, Column]:
    """Words with their magnitudes."""
    return {"ws": F.transform(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""), lambda w: F.struct(w.alias("w"), _magnitude(w).alias("m")))}


def _parts(ws: Column) -> dict[str, Column]:
    """The product of the magnitudes, and the words that are none."""
    return {"times": F.aggregate(ws, F.lit(1.0), lambda a, x: a * F.coalesce(x["m"], F.lit(1.0))), "rest": F.array_join(F.transform(F.filter(ws, lambda x: x["m"].isNull()), lambda x: x["w"]), " ")}


def _value(times: Column, rest: Column) -> dict[str, Column]:
    suffix = F.try_element_at(literal_map(MAGNITUDES), filled(F.regexp_extract(rest, r"\d+(?:\.\d+)?\s*([kmbt])\b", 1)))
    base = filled(F.regexp_extract(F.regexp_replace(rest, r"(?<=\d),(?=\d)", ""), r"[-+]?\d*\.?\d+", 0)).try_cast("double")
    return {"base": base, "by": F.when(times == 1.0, F.coalesce(suffix, F.lit(1.0))).otherwise(times)}


def _result(m: dict, v: dict, unit: Column, currency: Column, kind: Column) -> Column:
    blank, cur, pct, t, base = m["blank"], m["cur"], m["pct"], m["t"], v["base"]
    is_ratio = t.rlike(_RATIO)
    quotient = F.try_divide(F.regexp_extract(t, _RATIO, 1).try_cast("double"), F.regexp_extract(t, _RATIO, 2).try_cast("double"))
    has, money = base.isNotNull(), filled(cur).isNotNull()
    scaled = base * v["by"]
    named = F.when(blank, unit).when(is_ratio, "ratio").when(has & pct, "%").when(has & money, cur).otherwise(unit)
    plain = F.coalesce(kind, F.lit("text"))
    return F.struct(
        F.when(blank, None).when(is_ratio, quotient).otherwise(base).alias("raw"),
        F.when(blank, None).when(is_ratio, quotient).when(pct, F.round(F.when(base > 1, base / 100).otherwise(base), 6)).when(money, F.round(scaled, 2)).otherwise(scaled).alias("normalized"),
        named.alias("unit"), named.alias("normalized_unit"), F.when(blank, currency).otherwise(cur).alias("currency"),
        F.when(blank, plain).when(is_ratio, "range").when(~has, plain).when(pct, "percentage").when(money, "currency").otherwise(F.coalesce(kind, F.lit("number"))).alias("value_type"),
    )


def numeric(value: Column, unit: Column, currency: Column, kind: Column) -> Column:
    """struct(raw, normalized, unit, normalized_unit, currency, value_type) (N-1).

    The last currency sign found wins over the declared currency, and the last
    code, in order of the alphabet, over both. A percentage is divided by 100 only
    if it is over 1. Magnitude words multiply; an attached letter counts only
    without them. Null and blank texts keep what was declared.

    As one expression the parts are computed several times; ``with_numeric`` computes
    each once.
    """
    m = _marks(value, unit, currency, kind)
    p = _parts(_words(m["t"])["ws"])
    return _result(m, _value(p["times"], p["rest"]), unit, currency, kind)


def with_numeric(df: DataFrame, out: str, value: Column, unit: Column, currency: Column, kind: Column) -> DataFrame:
    """``df`` with ``out``, what ``numeric`` gives, in steps that are computed once each."""
    names = []

    def step(df: DataFrame, cols: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
        name = f"__{out}_{len(names)}"
        names.append(name)
        return once(df, name, F.struct(*(c.alias(k) for k, c in cols.items()))), {k: F.col(f"{name}.{k}") for k in cols}

    df, m = step(df, _marks(value, unit, currency, kind))
    df, w = step(df, _words(m["t"]))
    df, p = step(df, _parts(w["ws"]))
    df, v = step(df, _value(p["times"], p["rest"]))
    return once(df, out, _result(m, v, unit, currency, kind)).drop(*names)


# Month names and abbreviations.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTH_NUMBER = {m.lower(): k for k, m in enumerate(MONTHS, 1)} | {m[:3].lower(): k for k, m in enumerate(MONTHS, 1)} | {"sept": 9}


def period(text: Column, fiscal_year_end: Column) -> Column:
    """struct(time_text, time_start, time_end, time_granularity) of a period (N-2).

    Fiscal years come first, then ranges of years, calendar quarters, a month with
    a year (the first word before a year only) and bare years. A fiscal year has
    bounds only where the document states a year end of 03-31 or 12-31. Anything
    else keeps its text; null and blank give nulls.
    """
    c = collapse(strip(text))
    year = r"(19\d\d|20\d\d)"
    fy_re = r"(?i)\b(?:FY|Fiscal(?:\s+Year)?)\s*['’]?(\d{2,4})\b"
    fy = filled(F.regexp_extract(c, fy_re, 1))
    fy_year = F.when(F.length(fy) == 4, fy.cast("int")).otherwise(fy.cast("int") + 2000)
    fy_text = F.concat(F.lit("FY"), fy_year)
    fq = filled(F.regexp_extract(c, r"(?i)\bQ([1-4])\b", 1))
    range_re = rf"\b{year}\s*(?:-|–|—|to)\s*{year}\b"
    r1, r2 = filled(F.regexp_extract(c, range_re, 1)), filled(F.regexp_extract(c, range_re, 2))
    q_re = rf"(?i)\b(?:Q([1-4])\s*{year}|([1-4])Q\s*{year})\b"
    g = lambda n: filled(F.regexp_extract(c, q_re, n))
    q, qy = F.coalesce(g(1), g(3)), F.coalesce(g(2), g(4))
    m_re = rf"\b([a-zA-Z]+)\s+{year}\b"
    month = F.try_element_at(literal_map(MONTH_NUMBER), F.lower(F.regexp_extract(c, m_re, 1)))
    my = filled(F.regexp_extract(c, m_re, 2))
    first = F.make_date(my.cast("int"), month, F.lit(1))
    y = filled(F.regexp_extract(c, rf"\b{year}\b", 1))
    q_start, q_end = literal_map({"1": "-01-01", "2": "-04-01", "3": "-07-01", "4": "-10-01"}), literal_map({"1": "-03-31", "2": "-06-30", "3": "-09-30", "4": "-12-31"})
    none = F.lit(None).cast("string")
    make = lambda a, b, d, e: F.struct(a.alias("time_text"), b.alias("time_start"), d.alias("time_end"), F.lit(e).alias("time_granularity"))
    fy_start = F.when(fiscal_year_end == "03-31", F.concat(fy_year - 1, F.lit("-04-01"))).when(fiscal_year_end == "12-31", F.concat(fy_year, F.lit("-01-01")))
    fy_end = F.when(fiscal_year_end == "03-31", F.concat(fy_year, F.lit("-03-31"))).when(fiscal_year_end == "12-31", F.concat(fy_year, F.lit("-12-31")))
    return (
        F.when(c.isNull() | (c == ""), make(none, none, none, None))
        .when(fy.isNotNull() & fq.isNotNull(), make(F.concat(F.lit("Q"), fq, F.lit(" "), fy_text), none, none, "quarter"))
        .when(fy.isNotNull(), make(fy_text, fy_start, fy_end, "fiscal_year"))
        .when(r1.isNotNull(), make(F.concat(r1, F.lit("-"), r2), F.concat(r1, F.lit("-01-01")), F.concat(r2, F.lit("-12-31")), "year"))
        .when(q.isNotNull(), make(F.concat(F.lit("Q"), q, F.lit(" "), qy), F.concat(qy, F.element_at(q_start, q)), F.concat(qy, F.element_at(q_end, q)), "quarter"))
        .when(month.isNotNull(), make(F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), month), F.lit(" "), my), F.date_format(first, "yyyy-MM-dd"), F.date_format(F.last_day(first), "yyyy-MM-dd"), "month"))
        .when(y.isNotNull(), make(y, F.concat(y, F.lit("-01-01")), F.concat(y, F.lit("-12-31")), "year"))
        .otherwise(make(c, none, none, "unknown"))
    )


# Metrics and their other names; every metric also stands for itself.
PREDICATES = {
    "revenue": ["revenue", "revenues", "total_revenue", "total_revenues", "gross_revenue", "annual_revenue"],
    "sales": ["sales", "total_sales", "gross_sales", "net_sales", "product_sales"],
    "operating_income": ["operating_income", "operating_profit", "operating_earnings", "ebit"],
    "operating_margin": ["operating_margin", "operating_profit_margin"],
    "gross_margin": ["gross_margin"],
    "net_margin": ["net_margin"],
    "net_income": ["net_income", "net_profit", "net_earnings"],
    "employee_count": ["employee_count", "headcount", "total_employees", "number_of_employees", "workforce"],
    "eps": ["eps", "earnings_per_share", "diluted_eps", "basic_eps"],
    "chief_executive_officer": ["ceo", "chief_executive_officer"],
    "chief_financial_officer": ["cfo", "chief_financial_officer"],
    "founder": ["founder"],
    "chairman": ["chairman"],
}
SYNONYMS = {s: p for p, ss in PREDICATES.items() for s in ss}
# Families of comparable metrics.
FAMILIES = {
    "top_line": ["revenue", "sales"],
    "profitability": ["operating_income", "net_income", "operating_margin", "gross_margin", "net_margin"],
    "headcount": ["employee_count"],
    "leadership": ["chief_executive_officer", "chief_financial_officer", "founder", "chairman"],
    "market": ["market_cap", "valuation", "share_price"],
}
FAMILY_OF = {p: f for f, ps in FAMILIES.items() for p in ps}


def predicate(c: Column) -> Column:
    """struct(predicate, confidence, known) of a metric's name (N-3); a null or empty
    name is `unknown_predicate`."""
    k = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)[\s\-/]+", "_")
    k = F.regexp_replace(F.regexp_replace(k, r"(?U)[^\w]", ""), "^_+|_+$", "")
    known = F.try_element_at(literal_map(SYNONYMS), k)
    make = lambda a, b, d: F.struct(a.alias("predicate"), F.lit(b).alias("confidence"), F.lit(d).alias("known"))
    return F.when(k == "", make(F.lit("unknown_predicate"), 0.5, False)).when(known.isNotNull(), make(known, 1.0, True)).otherwise(make(k, 0.85, False))


def family(pred: Column) -> Column:
    return F.try_element_at(literal_map(FAMILY_OF), pred)


# Legal forms, in the order they are taken off.
LEGAL = [r"\bcorporation\b", r"\bcorp\.?\b", r"\bincorporated\b", r"\binc\.?\b", r"\blimited\b", r"\bltd\.?\b", r"\bllc\.?\b", r"\bl\.l\.c\.?\b", r"\bgmbh\b", r"\bplc\.?\b", r"\bpte\.?\s+ltd\.?\b", r"\bs\.a\.?\b", r"\ba\.g\.?\b"]
GENERIC = ["the company", "the group", "the organization", "the firm", "the corporation", "management", "board of directors", "company", "group", "we", "our"]


def clean_name(c: Column) -> Column:
    """A name with single spaces; `Unknown Entity` where it is null or blank (N-4)."""
    return F.coalesce(filled(collapse(strip(c))), F.lit("Unknown Entity"))


def legal_stem(c: Column) -> Column:
    """A name without its legal form (N-5)."""
    s = clean_name(c)
    for p in LEGAL:
        s = F.regexp_replace(F.regexp_replace(s, "(?i)" + p, ""), r"^[ ,.\-]+|[ ,.\-]+$", "")
    return s


def is_generic(c: Column) -> Column:
    return F.lower(clean_name(c)).isin(GENERIC)
