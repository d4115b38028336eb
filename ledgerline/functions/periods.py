"""Reporting periods. A period string has one of three grains in one column:
``YYYY-MM-01``, ``YYYY-Qn`` and ``YYYY-FY``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and their numbers.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
#: Forms whose covering period is a fiscal year.
ANNUAL_FORMS = ("10-K", "20-F", "40-F", "10-K/A", "20-F/A", "40-F/A")
_NAMES = "january|february|march|april|may|june|july|august|september|october|november|december"


def month_number(name: Column) -> Column:
    """1 to 12 for an English month name or its first three letters, else null."""
    table = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    return F.try_element_at(table, F.lower(name))


def _pick(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _year_month(year: Column, month: Column) -> Column:
    return F.when(month.between(1, 12), F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0")))


def normalize_period(raw: Column, fiscal_year_end: Column | int = 12) -> Column:
    """``YYYY-MM`` of any known way to write a period, null for others.

    A quarter gives its first month, a fiscal year its last (clamped to 1-12).
    """
    raw = F.trim(raw)
    # The six accepted ways to write a period.
    end = fiscal_year_end if isinstance(fiscal_year_end, Column) else F.lit(fiscal_year_end)
    plain, quarter, of_quarter = r"^(\d{4})-(\d{2})(-\d{2})?$", r"^(\d{4})[- ]?[Qq]([1-4])$", r"^[Qq]([1-4])\s+(\d{4})$"
    fiscal, named, named_late = r"(?i)^(?:FY)?(\d{4})(?:-FY)?$", r"^([A-Za-z]+)[,\s]+(\d{4})$", r"^(\d{4})\s+([A-Za-z]+)$"
    first = lambda q: q.cast("int") * 3 - 2
    return F.coalesce(
        _year_month(_pick(raw, plain, 1), _pick(raw, plain, 2).cast("int")),
        _year_month(_pick(raw, quarter, 1), first(_pick(raw, quarter, 2))),
        _year_month(_pick(raw, of_quarter, 2), first(_pick(raw, of_quarter, 1))),
        _year_month(_pick(raw, fiscal, 1), F.greatest(F.lit(1), F.least(F.lit(12), end))),
        _year_month(_pick(raw, named, 2), month_number(_pick(raw, named, 1))),
        _year_month(_pick(raw, named_late, 1), month_number(_pick(raw, named_late, 2))),
    )


def time_grain(period: Column) -> Column:
    """quarterly, annual or monthly by the form of the period string."""
    return (
        F.when(period.rlike(r"^\d{4}-Q[1-4]$"), "quarterly").when(period.rlike(r"^\d{4}-FY$"), "annual").otherwise("monthly")
    )


def period_sort_key(period: Column) -> Column:
    """(year, month, annual) so that mixed grains sort by the time they end."""
    year = F.coalesce(_pick(period, r"^(\d{4})-", 1).cast("int"), F.lit(0))
    key = lambda y, m, a: F.struct(y.alias("year"), m.cast("int").alias("month"), F.lit(a).alias("annual"))
    return (
        F.when(period.rlike(r"^\d{4}-Q[1-4]$"), key(year, _pick(period, r"Q([1-4])$", 1).cast("int") * 3, 0))
        .when(period.rlike(r"^\d{4}-FY$"), key(year, F.lit(12), 1))
        .when(period.rlike(r"^\d{4}-\d{2}"), key(year, _pick(period, r"^\d{4}-(\d{2})", 1).cast("int"), 0))
        .otherwise(key(F.lit(0), F.lit(0), 0))
    )


def quarter_of(day: Column) -> Column:
    """``YYYY-Qn`` of a date."""
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def covering_period(period_of_report: Column, form: Column) -> Column:
    """``YYYY-FY`` for annual forms, ``YYYY-Qn`` for the others."""
    return F.when(form.isin(*ANNUAL_FORMS), F.concat(F.year(period_of_report).cast("string"), F.lit("-FY"))).otherwise(
        quarter_of(period_of_report)
    )


def covered_months(period: Column) -> Column:
    """First days of the 3 or 12 months of a ``YYYY-Qn`` or ``YYYY-FY``; null for others."""
    year = _pick(period, r"^(\d{4})-", 1)
    quarter = _pick(period, r"^\d{4}-Q([1-4])$", 1).cast("int")
    start = F.make_date(year.cast("int"), F.coalesce(quarter * 3 - 2, F.lit(1)), F.lit(1))
    last = F.when(quarter.isNotNull(), F.add_months(start, 2)).when(period.rlike(r"^\d{4}-FY$"), F.add_months(start, 11))
    return F.when(last.isNotNull(), F.sequence(start, last, F.expr("interval 1 month")))


def month_spine(lo: Column, hi: Column) -> Column:
    """All first days of months from ``lo`` to ``hi``, both dates included."""
    return F.sequence(F.trunc(lo, "MM"), F.trunc(hi, "MM"), F.expr("interval 1 month"))


def prior_months(period: Column, n: int) -> Column:
    """The ``n`` months before a month, nearest first."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.add_months(period, -k))


def period_label(period: Column) -> Column:
    """Q1 2025, FY 2024 or Jan 2024."""
    year = F.substring(period, 1, 4)
    return (
        F.when(time_grain(period) == "quarterly", F.concat(F.substring(period, 6, 2), F.lit(" "), year))
        .when(time_grain(period) == "annual", F.concat(F.lit("FY "), year))
        .otherwise(F.date_format(F.try_to_timestamp(F.substring(period, 1, 7), F.lit("yyyy-MM")), "MMM yyyy"))
    )


def _first_of(year: Column, month: Column) -> Column:
    return F.when(month.between(1, 12), F.make_date(year.cast("int"), month, F.lit(1)))


def _named_month(text: Column, pattern: str) -> Column:
    return _first_of(_pick(text, pattern, 2), month_number(_pick(text, pattern, 1)))


def period_from_filename(path: Column) -> Column:
    """Month of a file by its name: an ISO date in it, else Month YYYY."""
    name = F.element_at(F.split(path, "/"), -1)
    iso = r"(\d{4})-(\d{2})-\d{2}"
    return F.coalesce(_first_of(_pick(name, iso, 1), _pick(name, iso, 2).cast("int")), _named_month(name, rf"(?i)({_NAMES})\s+(\d{{4}})"))


#: Words before a month, and words after it; the surest first.
PERIOD_PHRASES = (
    rf"(?i)(?:for\s+the\s+month\s+of|during|in)\s+({_NAMES})\s+(\d{{4}})",
    rf"(?i)({_NAMES})\s+(\d{{4}})\s+(?:production|mining|bitcoin|btc|results)",
    rf"(?i)({_NAMES})\s+(\d{{4}})",
)


def period_from_text(text: Column, opening: int = 3000) -> Column:
    """Month that the opening of a text is about, the surest phrase first."""
    head = F.substring(text, 1, opening)
    return F.coalesce(*(_named_month(head, p) for p in PERIOD_PHRASES))


def undated_period(path: Column, body: Column) -> Column:
    """(period, confidence, method) of a file without a date: its name, else the
    visible text of an HTML file, else nothing is found."""
    named = F.coalesce(period_from_filename(path), F.when(F.lower(path).endswith(".html"), period_from_text(body)))
    return F.struct(
        named.alias("period"),
        F.when(named.isNotNull(), 0.85).otherwise(0.0).alias("confidence"),
        F.when(named.isNotNull(), "rule_based").otherwise("not_found").alias("method"),
    )


def slug_period(url: Column) -> Column:
    """Month of a URL whose slug says ``announces-month-year``; of several the
    first that is a month's full name."""
    pattern = r"(?i)announces-([a-z]+)-(\d{4})(?:-|$)"
    found = F.transform(F.regexp_extract_all(url, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lower(F.regexp_extract(x, pattern, 1)).alias("name"), F.regexp_extract(x, pattern, 2).alias("year")))
    first = F.get(F.filter(found, lambda m: m["name"].rlike(rf"^(?:{_NAMES})$")), F.lit(0))
    return _first_of(first["year"], month_number(first["name"]))


def months_mentioned(text: Column) -> Column:
    """Distinct ``month year`` phrases of a text as first days, ascending."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?:{_NAMES})\s+\d{{4}}"), F.lit(0))
    days = F.transform(found, lambda x: _first_of(F.regexp_extract(x, r"(\d{4})", 1), month_number(F.regexp_extract(x, r"^([A-Za-z]+)", 1))))
    return F.array_sort(F.array_distinct(F.filter(days, lambda d: d.isNotNull())))


def months_within(text: Column, now: Column, back: int = 24, ahead: int = 6) -> Column:
    """Months mentioned that are near ``now``."""
    return F.filter(months_mentioned(text), lambda d: d.between(F.add_months(F.trunc(now, "MM"), -back), F.add_months(F.trunc(now, "MM"), ahead)))


def corrected_period(text: Column, title_period: Column, opening: int = 3000) -> Column:
    """The month that the opening of a text reports on, where it is another than
    its title's, else the title's. Only phrases that say so count (never a bare
    month); of the surest kind that names another month, the first."""
    head = F.substring(text, 1, opening)

    def other(pattern: str) -> Column:
        days = F.transform(F.regexp_extract_all(head, F.lit(pattern), F.lit(0)), lambda x: _named_month(x, pattern))
        return F.get(F.filter(days, lambda d: d.isNotNull() & ~d.eqNullSafe(title_period)), F.lit(0))

    return F.coalesce(*(other(p) for p in PERIOD_PHRASES[:2]), title_period)


def quarterly_document(url: Column, text: Column) -> Column:
    """``YYYY-Qn`` if the URL or the text's opening speaks of a quarter, else null."""
    words = {"first": 1, "second": 2, "third": 3, "fourth": 4}
    both = F.concat_ws(" ", url, F.substring(text, 1, 1500))
    short, spelt = r"(?i)\bq([1-4])[-_ ](\d{4})", rf"(?i)({'|'.join(words)})[- ]quarter[- ](?:of[- ])?(?:fiscal[- ])?(\d{{4}})"
    number = F.try_element_at(F.create_map(*(F.lit(x) for p in words.items() for x in p)), F.lower(_pick(both, spelt, 1)))
    return F.coalesce(
        F.concat(_pick(both, short, 2), F.lit("-Q"), _pick(both, short, 1)),
        F.concat(_pick(both, spelt, 2), F.lit("-Q"), number.cast("string")),
    )
