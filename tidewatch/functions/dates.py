"""Dates as Columns: parsing of published days and deadlines, windows and buckets. Nothing raises; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _day(y: Column, m: Column, d: Column) -> Column:
    """A day of the month is clamped to its month's last; null if the month isn't one."""
    first = F.when(m.between(1, 12) & y.between(1900, 2200), F.make_date(y, F.when(m.between(1, 12), m).otherwise(1), F.lit(1)))
    return F.least(F.date_add(first, F.greatest(d, F.lit(1)) - 1), F.last_day(first))


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found.cast("int"))


def parse_published(text: Column) -> Column:
    """yyyy-mm-dd..., yyyymmdd or yyyy.mm.dd at the start of a text."""
    p = r"^\s*(\d{4})[-./]?(\d{2})[-./]?(\d{2})"
    y, m, d = (_part(text, p, k) for k in (1, 2, 3))
    return F.when(d.between(1, 31), _day(y, m, d))


#: Notations of a deadline, with groups for year, month and day (0: none).
DEADLINES = [(r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})", 1, 2, 3), (r"(\d{4})년 ?(\d{1,2})월 ?(\d{1,2})일", 1, 2, 3), (r"(\d{4})년 ?(\d{1,2})월", 1, 2, 0), (r"(\d{1,2})월 ?(\d{1,2})일", 0, 1, 2), (r"(\d{4})년", 1, 0, 0), (r"(\d{1,2})월", 0, 1, 0)]


def parse_deadline(text: Column, published: Column) -> Column:
    """The first notation that is found: a month means its last day, a year its last; none before ``published`` or 15 years after it."""

    def read(pattern: str, y: int, m: int, d: int) -> Column:
        year = _part(text, pattern, y) if y else F.year(published)
        month = _part(text, pattern, m) if m else F.lit(12)
        day = _part(text, pattern, d) if d else F.lit(31)
        return _day(year, month, day)

    found = F.lit(None).cast("date")
    for x in reversed(DEADLINES):
        found = F.when(text.rlike(x[0]), read(*x)).otherwise(found)
    return F.when((found >= published) & (found <= F.add_months(published, 180)) & (F.year(found) >= 2000), found)


def relative_deadline(text: Column, published: Column) -> Column:
    """"in n days / weeks / months / years", next month or year, this year; in either language."""
    n = lambda p: _part(text, p, 1)
    year_end = lambda k: F.make_date(F.year(published) + k, F.lit(12), F.lit(31))
    days, weeks, months, years = n(r"(\d{1,3}) ?(?:days|일)"), n(r"(\d{1,3}) ?(?:weeks|주)"), n(r"(\d{1,3}) ?(?:months|개월)"), n(r"(\d{1,2}) ?(?:years|년)")
    return F.coalesce(
        F.date_add(published, days),
        F.date_add(published, weeks * 7),
        F.add_months(published, months),
        F.add_months(published, years * 12),
        F.when(text.rlike("next month|다음 ?달|내달"), F.last_day(F.add_months(published, 1))),
        F.when(text.rlike("next year|내년"), year_end(1)),
        F.when(text.rlike("first half|상반기"), F.make_date(F.year(published), F.lit(6), F.lit(30))),
        F.when(text.rlike("this year|올해|연내|second half|하반기"), year_end(0)),
        F.when(text.rlike("this month|이달"), F.last_day(published)),
    )


def age_bucket(days: Column) -> Column:
    ladder = F.when(days < 0, "before")
    for most in (3, 7, 30, 90, 180, 365):
        ladder = ladder.when(days <= most, f"<={most}")
    return ladder.otherwise("later")


def signed_log(days: Column) -> Column:
    return F.signum(days) * F.log1p(F.abs(days))


def quarter_window(day: Column, pad: int = 45) -> Column:
    start = F.trunc(day, "quarter")
    return F.struct(F.date_sub(start, pad).alias("start"), F.date_add(F.add_months(start, 3), pad).alias("end"))


def next_run(at: Column, hour: int = 4, zone: str = "Asia/Seoul") -> Column:
    """The first time strictly after ``at`` (a UTC timestamp) when it is ``hour`` o'clock in ``zone``, as UTC."""
    local = F.from_utc_timestamp(at, zone)
    today = F.date_trunc("day", local) + F.make_interval(hours=F.lit(hour))
    return F.to_utc_timestamp(F.when(today > local, today).otherwise(today + F.make_interval(days=F.lit(1))), zone)
