"""Dates as serial numbers of the 1900 system, on date or timestamp columns or on serials.

A serial counts days from 1899-12-30, so it equals the spreadsheet's from 1900-03-01 on; the
fictitious 1900-02-29 has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.cell import NUM, VALUE, Cell, cell, function, number, raised

_ZERO = "1899-12-30"


def day(x: Column) -> Column:
    """The date of a date, a timestamp or a serial."""
    kind = F.typeof(x)
    return F.when(kind.isin("date", "timestamp", "timestamp_ntz", "string"), x.try_cast("string").try_cast("date")).otherwise(F.date_add(F.to_date(F.lit(_ZERO)), F.floor(x.try_cast("string").try_cast("double")).cast("int")))


def moment(x: Column) -> Column:
    """The timestamp of a date, a timestamp or a serial, to the second."""
    kind = F.typeof(x)
    n = x.try_cast("string").try_cast("double")
    at = F.to_timestamp(F.date_add(F.to_date(F.lit(_ZERO)), F.floor(n).cast("int"))) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round((n - F.floor(n)) * 86400, 0).cast("decimal(18,6)"))
    return F.when(kind.isin("date", "timestamp", "timestamp_ntz", "string"), x.try_cast("string").try_cast("timestamp")).otherwise(at)


def serial(d: Column) -> Column:
    return F.datediff(d, F.to_date(F.lit(_ZERO))).cast("double")


def _part(name: str, value, of=day) -> None:
    @function(name, low=1, high=1)
    def build(x):
        c = cell(x)
        out = value(of(c.value)).cast("double")
        return raised(out, (c.value.isNotNull() & out.isNull(), VALUE), over=(c,))


_part("YEAR", F.year)
_part("MONTH", F.month)
_part("DAY", F.dayofmonth)
_part("HOUR", F.hour, moment)
_part("MINUTE", F.minute, moment)
_part("SECOND", F.second, moment)
_part("ISOWEEKNUM", F.weekofyear)
_part("DATEVALUE", serial)


@function("DATE")
def date(year, month, day_):
    y, m, d = number(year), number(month), number(day_)
    full = F.floor(y.value) + F.when(F.floor(y.value) < 1900, 1900).otherwise(0)
    first = F.add_months(F.make_date(full.cast("int"), F.lit(1), F.lit(1)), (F.floor(m.value) - 1).cast("int"))
    out = serial(first) + F.floor(d.value) - 1
    return raised(out, (out < 0, NUM), over=(y, m, d))


@function("TODAY", low=0, high=1)
def today(pinned=None):
    return Cell(serial(F.current_date() if pinned is None else F.to_date(F.lit(pinned))))


@function("NOW", low=0, high=1)
def now(pinned=None):
    at = F.current_timestamp() if pinned is None else F.to_timestamp(F.lit(pinned))
    return Cell(serial(F.to_date(at)) + (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)) / 86400)


@function("TIME")
def time(hour, minute, second):
    h, m, s = number(hour), number(minute), number(second)
    total = F.floor(h.value) * 3600 + F.floor(m.value) * 60 + F.floor(s.value)
    return raised((total - 86400 * F.floor(total / 86400)) / 86400, (total < 0, NUM), over=(h, m, s))


@function("TIMEVALUE")
def timevalue(x):
    c = cell(x)
    shape = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?\s*$"
    part = lambda k: F.coalesce(F.regexp_extract(c.value, shape, k).try_cast("int"), F.lit(0))
    half = F.lower(F.regexp_extract(c.value, shape, 4))
    hours = F.when((half == "pm") & (part(1) < 12), part(1) + 12).when((half == "am") & (part(1) == 12), 0).otherwise(part(1))
    return raised((hours * 3600 + part(2) * 60 + part(3)) / 86400.0, (~c.value.rlike(shape), VALUE), over=(c,))


@function("DAYS")
def days(end, start):
    a, b = cell(end), cell(start)
    return raised(F.datediff(day(a.value), day(b.value)).cast("double"), over=(a, b))


@function("EDATE")
def edate(x, months):
    c, n = cell(x), number(months)
    return raised(serial(F.add_months(day(c.value), F.floor(n.value).cast("int"))), over=(c, n))


@function("EOMONTH")
def eomonth(x, months):
    c, n = cell(x), number(months)
    return raised(serial(F.last_day(F.add_months(day(c.value), F.floor(n.value).cast("int")))), over=(c, n))


#: First day of the week (Monday is 0) and first number by return type; fixed values.
_WEEK = {1: (6, 1), 2: (0, 1), 3: (0, 0), 11: (0, 1), 12: (1, 1), 13: (2, 1), 14: (3, 1), 15: (4, 1), 16: (5, 1), 17: (6, 1)}


@function("WEEKDAY")
def weekday(x, kind: int = 1):
    c = cell(x)
    if kind not in _WEEK:
        return Cell(F.lit(None).cast("double"), F.lit(NUM))
    first, base = _WEEK[kind]
    return raised((F.pmod(F.weekday(day(c.value)) - first, F.lit(7)) + base).cast("double"), over=(c,))


@function("WEEKNUM")
def weeknum(x, kind: int = 1):
    c = cell(x)
    d = day(c.value)
    if kind == 21:
        return raised(F.weekofyear(d).cast("double"), over=(c,))
    if kind not in _WEEK or kind == 3:
        return Cell(F.lit(None).cast("double"), F.lit(NUM))
    offset = F.pmod(F.weekday(F.trunc(d, "year")) - _WEEK[kind][0], F.lit(7))
    return raised(F.floor((F.dayofyear(d) - 1 + offset) / 7) + 1.0, over=(c,))


@function("DATEDIF")
def datedif(start, end, unit: str):
    a, b = cell(start), cell(end)
    x, y = day(a.value), day(b.value)
    months = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x) - (F.dayofmonth(y) < F.dayofmonth(x)).cast("int")
    same_month = F.add_months(x, months.cast("int"))
    out = {
        "Y": F.floor(months / 12), "M": months, "D": F.datediff(y, x), "YM": months - 12 * F.floor(months / 12),
        "MD": F.datediff(y, same_month), "YD": F.datediff(y, F.add_months(x, (12 * F.floor(months / 12)).cast("int"))),
    }.get(unit.upper())
    if out is None:
        return Cell(F.lit(None).cast("double"), F.lit(NUM))
    return raised(out.cast("double"), (x > y, NUM), over=(a, b))


#: Weekend days (Monday is 0) by code; fixed values.
_WEEKEND = {1: (5, 6), 2: (6, 0), 3: (0, 1), 4: (1, 2), 5: (2, 3), 6: (3, 4), 7: (4, 5), **{11 + k: ((6 + k) % 7,) for k in range(7)}}


def _off(weekend) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(weekend) if c == "1") if isinstance(weekend, str) else _WEEKEND[weekend]


def _working(low: Column, high: Column, off: tuple[int, ...]) -> Column:
    """Working days from low to high, both included, without listing them: whole weeks, then at most six days."""
    n = F.datediff(high, low) + 1
    weeks, rest = F.floor(n / 7), F.pmod(n, F.lit(7))
    first, out = F.weekday(low), weeks * (7 - len(off))
    for k in range(6):
        out = out + ((rest > k) & ~F.pmod(first + k, F.lit(7)).isin(*off)).cast("int") if off else out + (rest > k).cast("int")
    return out


def _networkdays(start, end, off, holidays):
    a, b = cell(start), cell(end)
    x, y = day(a.value), day(b.value)
    low, high = F.least(x, y), F.greatest(x, y)
    out = _working(low, high, off)
    for h in dict.fromkeys(holidays or ()):
        d = F.to_date(F.lit(h))
        out = out - (d.between(low, high) & ~F.weekday(d).isin(*off)).cast("int") if off else out - d.between(low, high).cast("int")
    return raised(F.when(x > y, -out).otherwise(out).cast("double"), over=(a, b))


@function("NETWORKDAYS")
def networkdays(start, end, holidays=None):
    """``holidays`` is a list of ISO dates."""
    return _networkdays(start, end, (5, 6), holidays)


@function("NETWORKDAYS.INTL")
def networkdays_intl(start, end, weekend=1, holidays=None):
    return _networkdays(start, end, _off(weekend), holidays)


def _workday(start, n, off, holidays):
    """Among enough days after or before the start, the n-th that works."""
    a, k = cell(start), number(n)
    x, count = day(a.value), F.floor(k.value).cast("int")
    free = F.array(*(F.to_date(F.lit(h)) for h in holidays)) if holidays else F.array().cast("array<date>")
    reach = F.ceil(F.abs(count) * 7 / max(1, 7 - len(off))).cast("int") + 7 + 2 * len(holidays or ())
    sign = F.when(count < 0, -1).otherwise(1)
    ok = F.filter(F.transform(F.sequence(F.lit(1), reach), lambda i: F.date_add(x, i * sign)), lambda d: ~F.weekday(d).isin(*off) & ~F.array_contains(free, d))
    return raised(F.when(count == 0, serial(x)).otherwise(serial(F.try_element_at(ok, F.greatest(F.abs(count), F.lit(1))))), over=(a, k))


@function("WORKDAY")
def workday(start, n, holidays=None):
    return _workday(start, n, (5, 6), holidays)


@function("WORKDAY.INTL")
def workday_intl(start, n, weekend=1, holidays=None):
    return _workday(start, n, _off(weekend), holidays)


def days360_(x: Column, y: Column, european: bool) -> Column:
    d1, d2 = F.dayofmonth(x), F.dayofmonth(y)
    if european:
        d1, d2 = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
    else:
        d1 = F.when((d1 == 31) | (x == F.last_day(x)), 30).otherwise(d1)
        d2 = F.when((F.dayofmonth(y) == 31) & (d1 >= 30), 30).otherwise(d2)
    return (F.year(y) - F.year(x)) * 360 + (F.month(y) - F.month(x)) * 30 + d2 - d1


@function("DAYS360")
def days360(start, end, european=False):
    a, b = cell(start), cell(end)
    return raised(days360_(day(a.value), day(b.value), european).cast("double"), over=(a, b))


def yearfrac_(x: Column, y: Column, basis: int) -> Column:
    low, high = F.least(x, y), F.greatest(x, y)
    n = F.datediff(high, low)
    if basis in (0, 4):
        return days360_(low, high, basis == 4) / 360
    if basis == 2:
        return n / 360
    if basis == 3:
        return n / 365
    length = lambda v: F.when(((v % 4 == 0) & (v % 100 != 0)) | (v % 400 == 0), 366).otherwise(365)
    start = lambda v: F.make_date(v, F.lit(1), F.lit(1))
    return F.aggregate(F.sequence(F.year(low), F.year(high)), F.lit(0.0), lambda s, v: s + F.datediff(F.least(high, start(v + 1)), F.greatest(low, start(v))) / length(v))


@function("YEARFRAC")
def yearfrac(start, end, basis: int = 0):
    a, b = cell(start), cell(end)
    if basis not in range(5):
        return Cell(F.lit(None).cast("double"), F.lit(NUM))
    return raised(yearfrac_(day(a.value), day(b.value), basis), over=(a, b))
