"""Period classes, fiscal labels and market-clock expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.numeric import col

# Duration bands in days, both ends included.
DURATION_BANDS = (("Q", 65, 115), ("H", 155, 205), ("9M", 245, 295), ("FY", 340, 400))

# The durations a declared fiscal period may have.
FISCAL_PERIOD_BANDS = (
    ("Q1", 65, 115), ("Q2", 155, 205), ("H1", 155, 205), ("Q3", 245, 295), ("M9", 245, 295),
    ("FY", 340, 395), ("CY", 340, 395), ("H2", 155, 210), ("Q4", 65, 115),
)

# Order of a fiscal period inside its year.
FISCAL_RANK = {"Q1": 1, "Q2": 2, "H1": 2, "Q3": 3, "M9": 3, "Q4": 4, "FY": 4}

def day_gap(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(col(later), col(earlier))


def duration_days(start: Column | str = "start_date", end: Column | str = "end_date") -> Column:
    return F.datediff(col(end), col(start))


def duration_class(start: Column | str = "start_date", end: Column | str = "end_date") -> Column:
    """``instant``, ``Q``, ``H``, ``9M``, ``FY`` or ``other``."""
    days = duration_days(start, end)
    out = F.when(col(start).isNull(), F.lit("instant"))
    for name, lo, hi in DURATION_BANDS:
        out = out.when(days.between(lo, hi), F.lit(name))
    return out.otherwise(F.lit("other"))


def fiscal_rank(fp: Column | str) -> Column:
    upper = F.upper(col(fp))
    out = None
    for name, rank in FISCAL_RANK.items():
        out = F.when(upper == name, F.lit(rank)) if out is None else out.when(upper == name, F.lit(rank))
    return out


def fits_fiscal_period(fp: str, days: Column) -> Column:
    lo, hi = next(((lo, hi) for name, lo, hi in FISCAL_PERIOD_BANDS if name == fp.upper()), (0, 999))
    return days.between(lo, hi)


def fiscal_year(dei_fy: Column, report_date: Column, filed: Column, form: Column) -> Column:
    """Declared year, else the report year, else the filing year.

    An annual report filed in the first quarter belongs to the year before.
    """
    early = form.isin("10-K", "20-F", "40-F") & (F.month(filed) <= 3)
    return F.coalesce(
        dei_fy.cast("int"), F.year(report_date), F.year(filed) - F.when(early, 1).otherwise(0)
    )


def period_kind(form: Column) -> Column:
    return F.when(form.isin("10-Q", "6-K"), "quarterly").otherwise("annual")


def is_year_to_date(form: Column, fp: Column) -> Column:
    return form.isin("10-Q", "6-K") & F.upper(fp).isin("Q2", "Q3", "H1", "M9")


def quarter_label(fp: Column) -> Column:
    # Labels of quarterly periods.
    labels = {
        "Q1": "Q1 (Standalone)", "Q2": "Q2 (6-month YTD)", "Q3": "Q3 (9-month YTD)",
        "H1": "H1 (6-month)", "M9": "M9 (9-month)",
    }
    up = F.upper(fp)
    out = F.lit(None).cast("string")
    for key, text in labels.items():
        out = F.when(up == key, F.lit(text)).otherwise(out)
    return F.coalesce(out, up)


def easter(year: int) -> dt.date:
    """Easter Sunday of a Gregorian year, from the moon's age and the weekday in whole numbers."""
    golden, century, rest = year % 19, year // 100, year % 100
    moon = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * (rest // 4) - moon - rest % 4) % 7
    late = (golden + 11 * moon + 22 * weekday) // 451
    month, day = divmod(moon + weekday - 7 * late + 114, 31)
    return dt.date(year, month, day + 1)


# Two days before Easter, for every year that filings or quotes can be of.
GOOD_FRIDAYS = tuple(easter(y) - dt.timedelta(days=2) for y in range(1960, 2100))


def is_exchange_holiday(day: Column | str) -> Column:
    """Full-day exchange holidays of any year, by rule.

    Holidays by weekday are that weekday's n-th of the month. Those of a fixed
    day move from Saturday to Friday and from Sunday to Monday; New Year's Day
    on a Saturday is not made up. Some only came in later years.
    """
    day = col(day)
    year, month, dom, weekday = F.year(day), F.month(day), F.dayofmonth(day), F.dayofweek(day)
    monday, friday, thursday = weekday == 2, weekday == 6, weekday == 5

    def fixed(m: int, d: int) -> Column:
        return (month == m) & (
            ((dom == d) & weekday.between(2, 6)) | ((dom == d - 1) & friday) | ((dom == d + 1) & monday)
        )

    new_year = (month == 1) & (((dom == 1) & weekday.between(2, 6)) | ((dom == 2) & monday))
    return (
        new_year
        | ((month == 1) & monday & dom.between(15, 21) & (year >= 1998))
        | ((month == 2) & monday & dom.between(15, 21))
        | day.isin(*GOOD_FRIDAYS)
        | ((month == 5) & monday & (dom >= 25))
        | (fixed(6, 19) & (year >= 2022))
        | fixed(7, 4)
        | ((month == 9) & monday & (dom <= 7))
        | ((month == 11) & thursday & dom.between(22, 28))
        | fixed(12, 25)
    )


def _closed_day(local: Column) -> Column:
    return F.dayofweek(local).isin(1, 7) | is_exchange_holiday(F.to_date(local))


def market_session(ts: Column | str) -> Column:
    """pre, regular, after or closed, by Eastern wall clock."""
    local = F.from_utc_timestamp(col(ts), "America/New_York")
    minute = F.hour(local) * 60 + F.minute(local)
    return (
        F.when(_closed_day(local), "closed")
        .when((minute >= 240) & (minute < 570), "pre")
        .when((minute >= 570) & (minute < 960), "regular")
        .when((minute >= 960) & (minute < 1200), "after")
        .otherwise("closed")
    )


def filing_desk_open(ts: Column | str) -> Column:
    """Business days from six in the morning to ten at night, Eastern."""
    local = F.from_utc_timestamp(col(ts), "America/New_York")
    return ~_closed_day(local) & F.hour(local).between(6, 21)
