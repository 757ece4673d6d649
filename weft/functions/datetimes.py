"""Date and time functions of a timestamp column, named as in ``Series.dt``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_UNITS = {"D": "day", "h": "hour", "min": "minute", "s": "second", "ms": "millisecond", "us": "microsecond"}
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "E", "%A": "EEEE", "%p": "a", "%I": "hh", "%j": "DDD"}


class Dt:
    """Accessor over one column; every method gives a column."""

    def __init__(self, column: Column) -> None:
        self.c = column

    def year(self) -> Column: return F.year(self.c)
    def month(self) -> Column: return F.month(self.c)
    def day(self) -> Column: return F.dayofmonth(self.c)
    def hour(self) -> Column: return F.hour(self.c)
    def minute(self) -> Column: return F.minute(self.c)
    def second(self) -> Column: return F.second(self.c)
    def microsecond(self) -> Column: return (F.pmod(F.unix_micros(self.c.cast("timestamp")), F.lit(1_000_000))).cast("int")
    def nanosecond(self) -> Column: return F.when(self.c.isNotNull(), F.lit(0))
    def quarter(self) -> Column: return F.quarter(self.c)
    def dayofweek(self) -> Column: return F.weekday(self.c)
    weekday = day_of_week = dayofweek
    def dayofyear(self) -> Column: return F.dayofyear(self.c)
    day_of_year = dayofyear
    def weekofyear(self) -> Column: return F.weekofyear(self.c)
    week = weekofyear
    def days_in_month(self) -> Column: return F.dayofmonth(F.last_day(self.c))
    daysinmonth = days_in_month
    def day_name(self) -> Column: return F.date_format(self.c, "EEEE")
    def month_name(self) -> Column: return F.date_format(self.c, "MMMM")
    def date(self) -> Column: return F.to_date(self.c)
    def time(self) -> Column: return F.date_format(self.c, "HH:mm:ss.SSSSSS")
    def timetz(self, zone: str = "UTC") -> Column: return F.concat(self.time(), F.lit(f" {zone}"))
    def tz(self, zone: str = "UTC") -> Column: return F.when(self.c.isNotNull(), F.lit(zone))
    def freq(self, unit: str) -> Column:
        """The unit where every time stands at its start, else missing."""
        return F.when(F.date_trunc(_UNITS[unit], self.c) == self.c, F.lit(unit))

    def as_unit(self, unit: str) -> Column: return F.date_trunc(_UNITS[unit], self.c)
    def to_timestamp(self) -> Column: return self.c.cast("timestamp_ntz")
    to_pydatetime = to_timestamp
    def start_time(self, unit: str) -> Column: return F.date_trunc(_UNITS[unit], self.c)
    def end_time(self, unit: str) -> Column:
        """The last microsecond of the unit that holds a time."""
        return F.date_trunc(_UNITS[unit], self.c) + F.expr(f"interval 1 {_UNITS[unit]}") - F.expr("interval 1 microsecond")

    # parts of a length of time (a day-time interval)
    def days(self) -> Column: return F.extract(F.lit("DAY"), self.c)
    def seconds(self) -> Column: return (F.extract(F.lit("HOUR"), self.c) * 3600 + F.extract(F.lit("MINUTE"), self.c) * 60 + F.floor(F.extract(F.lit("SECOND"), self.c))).cast("int")
    def microseconds(self) -> Column:
        part = F.extract(F.lit("SECOND"), self.c)
        return ((part - F.floor(part)) * 1_000_000).cast("int")

    def nanoseconds(self) -> Column: return F.when(self.c.isNotNull(), F.lit(0))
    def normalize(self) -> Column: return F.date_trunc("day", self.c)
    def is_leap_year(self) -> Column: return F.dayofyear(F.make_date(F.year(self.c), F.lit(12), F.lit(31))) == 366
    def is_month_start(self) -> Column: return F.dayofmonth(self.c) == 1
    def is_month_end(self) -> Column: return F.to_date(self.c) == F.last_day(self.c)
    def is_quarter_start(self) -> Column: return (F.dayofmonth(self.c) == 1) & (F.month(self.c) % 3 == 1)
    def is_quarter_end(self) -> Column: return self.is_month_end() & (F.month(self.c) % 3 == 0)
    def is_year_start(self) -> Column: return F.dayofyear(self.c) == 1
    def is_year_end(self) -> Column: return (F.month(self.c) == 12) & (F.dayofmonth(self.c) == 31)
    def strftime(self, form: str) -> Column:
        for old, new in _FORMATS.items():
            form = form.replace(old, new)
        return F.date_format(self.c, form)

    def floor(self, unit: str) -> Column: return F.date_trunc(_UNITS[unit], self.c)

    def ceil(self, unit: str) -> Column:
        low = self.floor(unit)
        return F.when(low == self.c, low).otherwise(low + F.expr(f"interval 1 {_UNITS[unit]}"))

    def round(self, unit: str) -> Column:
        """To the nearest, halves to the even one."""
        low = self.floor(unit)
        size = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[_UNITS[unit]] * 1_000_000
        past = F.unix_micros(self.c.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))
        odd = F.pmod(F.floor(F.unix_micros(low.cast("timestamp")) / size), F.lit(2)) == 1
        return F.when((past * 2 > size) | ((past * 2 == size) & odd), low + F.expr(f"interval 1 {_UNITS[unit]}")).otherwise(low)

    def to_period(self, unit: str) -> Column: return F.date_format(self.c, {"Y": "yyyy", "M": "yyyy-MM", "D": "yyyy-MM-dd"}[unit])
    def tz_localize(self, zone: str) -> Column: return F.to_utc_timestamp(self.c, zone)
    def tz_convert(self, zone: str) -> Column: return F.from_utc_timestamp(self.c, zone)
    def epoch(self) -> Column: return F.unix_micros(self.c.cast("timestamp")) / 1_000_000
    def total_seconds(self, since: Column) -> Column: return (F.unix_micros(self.c.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1_000_000


def to_datetime(a: Column, form: str | None = None, unit: str | None = None, errors: str = "raise") -> Column:
    """Timestamps of strings or numbers; with ``coerce`` what can't be read is missing."""
    if unit:
        scale = {"s": 1_000_000, "ms": 1000, "us": 1, "D": 86_400_000_000}[unit]
        return F.timestamp_micros((a * scale).cast("bigint"))
    for old, new in _FORMATS.items():
        form = form.replace(old, new) if form else form
    read = F.try_to_timestamp if errors == "coerce" else F.to_timestamp
    return read(a, F.lit(form)) if form and errors == "coerce" else read(a, form) if form else read(a)
