"""Scalar functions as Column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strict_number(text: Column) -> Column:
    """A number by the strict grammar; anything else is null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def only_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def null_if_empty(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def norm_ticker(t: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(t)), r"\.", "-")


def yahoo_symbol(t: Column) -> Column:
    return norm_ticker(t)


def common_ticker(t: Column) -> Column:
    """False for units, warrants, rights and preferred classes."""
    return ~F.upper(F.trim(t)).rlike(r"-(UN|U|WT|WS|W|R|RT|P[A-Z]?)$")


def fiscal_year_of(d: Column) -> Column:
    """Periods that end by May belong to the year before."""
    return F.when(F.month(d) <= 5, F.year(d) - 1).otherwise(F.year(d))


def month_end_back(d: Column, months: int = 3) -> Column:
    return F.last_day(F.add_months(d, -months))


def eastern_instant(t: Column) -> Column:
    """A naive Eastern timestamp as an instant."""
    return F.to_utc_timestamp(t, "America/New_York")


# Patterns whose matches leave a company name, in this order, each for the replacement beside it.
NAME_PASSES = [
    (r"/[a-z]{2,3}(/|$)|\(new\)|\bnew$|\([a-z]{2,3}\)", " "),
    (r"[^a-z0-9]+", " "),
    (
        r"\b(inc|incorporated|corp|corporation|co|cos|company|companies|ltd|limited|plc|llc|lp)\s+"
        r"([ab]|de|md|nv|ca|ny|nj|pa|tx|va|ma|oh|mn|wi|fl|ga|wa|il|mi|ct|mo|ut|az|nc|tn|in|or)\s*$",
        " ",
    ),
    (
        r"\b(cl ?[ab]|class ?[ab]|the|inc|incorporated|corp|corporation|co|cos|company|companies|ltd|limited|plc|holdings?|"
        r"hldgs?|group|grp|llc|lp|l p|sa|nv|ag|international|intl|int l|int)\b",
        " ",
    ),
    (r"[^a-z0-9]", ""),
]


def norm_company_name(t: Column) -> Column:
    """A company's name without state and edition tags, punctuation, corporate forms and share-class tails."""
    out = F.lower(F.coalesce(t, F.lit("")))
    for pattern, by in NAME_PASSES:
        out = F.regexp_replace(out, pattern, by)
    return out


# The sectors, and other spellings of them.
SECTORS = [
    "Communication Services", "Consumer Discretionary", "Consumer Staples", "Energy", "Financials", "Health Care",
    "Industrials", "Information Technology", "Materials", "Real Estate", "Utilities", "Telecommunication Services",
]
SECTOR_SPELLINGS = {
    "Healthcare": "Health Care",
    "Utilites": "Utilities",
    "Utilties": "Utilities",
    "FInancials": "Financials",
    "Finances": "Financials",
    "Finance": "Financials",
    "Information Technologies": "Information Technology",
    "Technology": "Information Technology",
    "Communications Services": "Communication Services",
    "Telecommunications Services": "Telecommunication Services",
}


def sector_canonical(label: Column) -> Column:
    """The sector that a label names; unknown labels are null."""
    names = {**{s: s for s in SECTORS}, **SECTOR_SPELLINGS}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), label)


# Filing forms by lifecycle event; the whole form must match, the first match counts.
FORM_EVENTS = [
    (r"8-A12[BG](/A)?", "LISTING_REGISTRATION"),
    (r"25(-NSE)?(/A)?", "DELISTING_NOTICE"),
    (r"15F?-(12B|12G|15D)(/A)?", "DEREGISTRATION"),
    (r"S-1(/A|MEF)?", "IPO_REGISTRATION"),
    (r"F-1(/A|MEF)?", "IPO_REGISTRATION"),
    (r"424B[14]", "IPO_PRICING"),
    (r"10-K.*", "PERIODIC_REPORT"),
    (r"10-Q.*", "PERIODIC_REPORT"),
    (r"20-F(/A)?", "PERIODIC_REPORT"),
    (r"40-F(/A)?", "PERIODIC_REPORT"),
]


def first_match(text: Column, rules, default=None, whole: bool = False) -> Column:
    """The value of the first (pattern, value) that matches."""
    out = F.lit(default)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(f"^(?:{pattern})$" if whole else pattern), F.lit(value)).otherwise(out)
    return out


def classify_form(form: Column) -> Column:
    return first_match(F.upper(F.trim(form)), FORM_EVENTS, whole=True)


def clean_ticker(t: Column) -> Column:
    """Upper case, without characters that are part of no ticker; dots stay."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(t, F.lit("")))), r"[^A-Z0-9.\-]", "")


def parse_segments(segments: Column) -> Column:
    """Map of axis to member of ``Axis=Member;Axis=Member;``; null when consolidated."""
    pairs = F.filter(F.split(segments, ";"), lambda x: x.contains("="))
    return F.when(segments.isNotNull(), F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_extract(x, "=(.*)$", 1).alias("v")))))


def camel_words(name: Column) -> Column:
    """CamelCase identifiers as words."""
    split = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.trim(F.regexp_replace(split, r"\s+", " "))


def industry_scope(sic: Column, prefix: Column) -> Column:
    return (prefix == "") | F.coalesce(sic.cast("string").startswith(prefix), F.lit(False))


def industry_in(sic: Column, prefixes: Column) -> Column:
    """An empty list is every industry."""
    return (F.size(prefixes) == 0) | F.exists(prefixes, lambda p: F.coalesce(sic.cast("string").startswith(p), F.lit(False)))


def iter_quarters(start: tuple[int, int], end: tuple[int, int]):
    """Quarters from start to end, both included; none when the end is earlier."""
    y, q = start
    while (y, q) <= end:
        yield y, q
        y, q = (y, q + 1) if q < 4 else (y + 1, 1)


def parse_quarter(text: str) -> tuple[int, int]:
    year, _, q = text.strip().lower().partition("q")
    if not (year.isdigit() and q in ("1", "2", "3", "4")):
        raise ValueError(f"not a quarter: {text!r}")
    return int(year), int(q)


def last_completed_quarter(today: date) -> tuple[int, int]:
    q = (today.month - 1) // 3
    return (today.year, q) if q else (today.year - 1, 4)
