"""Loans, depreciation, bills and bonds.  Closed forms are columns; solved rates run as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.cell import DIV0, NUM, VALUE, Cell, cell, function, let, number, raised
from tessella.functions.date import day, yearfrac_
from tessella.functions.engineering import vectorised


def growth(rate: Column, n: Column) -> Column:
    return F.pow(1 + rate, n)


def annuity(rate: Column, n: Column, due: Column) -> Column:
    """Value at the end of n payments of 1."""
    return F.when(rate == 0, n).otherwise((1 + rate * due) * F.try_divide(growth(rate, n) - 1, rate))


def payment(rate: Column, n: Column, pv: Column, fv: Column, due: Column) -> Column:
    return F.try_divide(-(fv + pv * growth(rate, n)), annuity(rate, n, due))


def future(rate: Column, n: Column, pmt: Column, pv: Column, due: Column) -> Column:
    return -(pv * growth(rate, n) + pmt * annuity(rate, n, due))


def interest(rate: Column, per: Column, n: Column, pv: Column, fv: Column, due: Column) -> Column:
    pmt = payment(rate, n, pv, fv, due)
    out = future(rate, per - 1, pmt, pv, due) * rate
    return F.when((due != 0) & (per == 1), 0.0).when(due != 0, out / (1 + rate)).otherwise(out)


def numbers(name: str, low: int, high: int, defaults: tuple, value: Callable[..., Column], *rules: tuple[Callable[..., Column], str]) -> None:
    """Register a function of numbers with defaults for the last arguments."""

    @function(name, low=low, high=high)
    def build(*args):
        cells = [number(a) for a in (*args, *defaults[len(args) - low :])]
        v = [c.value for c in cells]
        return raised(value(*v), *((rule(*v), e) for rule, e in rules), over=tuple(cells))


numbers("PMT", 3, 5, (0, 0), payment, (lambda r, n, *_: n == 0, NUM))
numbers("FV", 3, 5, (0, 0), lambda r, n, p, pv, d: future(r, n, p, pv, d))
numbers("PV", 3, 5, (0, 0), lambda r, n, p, fv, d: F.try_divide(-(fv + p * annuity(r, n, d)), growth(r, n)))
numbers("NPER", 3, 5, (0, 0), lambda r, p, pv, fv, d: F.when(r == 0, F.try_divide(-(pv + fv), p)).otherwise(F.try_divide(F.ln(F.try_divide(p * (1 + r * d) - fv * r, pv * r + p * (1 + r * d))), F.ln(1 + r))))
numbers("IPMT", 4, 6, (0, 0), interest, (lambda r, per, n, *_: (per < 1) | (per > n), NUM))
numbers("PPMT", 4, 6, (0, 0), lambda r, per, n, pv, fv, d: payment(r, n, pv, fv, d) - interest(r, per, n, pv, fv, d), (lambda r, per, n, *_: (per < 1) | (per > n), NUM))
numbers("ISPMT", 4, 4, (), lambda r, per, n, pv: pv * r * (F.try_divide(per, n) - 1), (lambda r, per, n, pv: n == 0, DIV0))
numbers("SLN", 3, 3, (), lambda c, s, n: F.try_divide(c - s, n), (lambda c, s, n: n == 0, DIV0))
numbers("SYD", 4, 4, (), lambda c, s, n, per: F.try_divide((c - s) * (n - per + 1) * 2, n * (n + 1)), (lambda c, s, n, per: (per < 1) | (per > n), NUM))
numbers("EFFECT", 2, 2, (), lambda r, n: F.pow(1 + r / F.floor(n), F.floor(n)) - 1, (lambda r, n: (r <= 0) | (n < 1), NUM))
numbers("NOMINAL", 2, 2, (), lambda r, n: (F.pow(1 + r, 1 / F.floor(n)) - 1) * F.floor(n), (lambda r, n: (r <= 0) | (n < 1), NUM))
numbers("PDURATION", 3, 3, (), lambda r, pv, fv: (F.ln(fv) - F.ln(pv)) / F.ln(1 + r), (lambda r, pv, fv: (r <= 0) | (pv <= 0) | (fv <= 0), NUM))
numbers("RRI", 3, 3, (), lambda n, pv, fv: F.pow(F.try_divide(fv, pv), F.try_divide(F.lit(1.0), n)) - 1, (lambda n, pv, fv: (n <= 0) | (pv == 0), NUM))
numbers("DOLLARDE", 2, 2, (), lambda x, f: F.signum(x) * (F.floor(F.abs(x)) + (F.abs(x) - F.floor(F.abs(x))) * F.pow(F.lit(10.0), F.ceil(F.log10(F.floor(f)))) / F.floor(f)), (lambda x, f: f < 0, NUM), (lambda x, f: f < 1, DIV0))
numbers("DOLLARFR", 2, 2, (), lambda x, f: F.signum(x) * (F.floor(F.abs(x)) + (F.abs(x) - F.floor(F.abs(x))) * F.floor(f) / F.pow(F.lit(10.0), F.ceil(F.log10(F.floor(f))))), (lambda x, f: f < 0, NUM), (lambda x, f: f < 1, DIV0))


def _steps(low: Column, high: Column) -> Column:
    return F.when(high >= low, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))


_range = (lambda r, n, pv, a, b, d: (r <= 0) | (n <= 0) | (pv <= 0) | (a < 1) | (b < a) | (b > n), NUM)
numbers("CUMIPMT", 6, 6, (), lambda r, n, pv, a, b, d: F.aggregate(_steps(a, b), F.lit(0.0), lambda s, k: s + interest(r, k, n, pv, F.lit(0.0), d)), _range)
numbers("CUMPRINC", 6, 6, (), lambda r, n, pv, a, b, d: F.aggregate(_steps(a, b), F.lit(0.0), lambda s, k: s + payment(r, n, pv, F.lit(0.0), d) - interest(r, k, n, pv, F.lit(0.0), d)), _range)


def _ddb(cost: Column, salvage: Column, life: Column, period: Column, factor: Column) -> Column:
    """Book value falls by a fixed share each period, never below salvage."""
    step = lambda s: F.greatest(F.least(s["book"] * factor / life, s["book"] - salvage), F.lit(0.0))
    return F.aggregate(_steps(F.lit(1), period), F.struct(cost.alias("book"), F.lit(0.0).alias("last")), lambda s, _: F.struct((s["book"] - step(s)).alias("book"), step(s).alias("last")))["last"]


numbers("DDB", 4, 5, (2,), _ddb, (lambda c, s, n, per, f: (c < 0) | (s < 0) | (n <= 0) | (per < 1) | (per > n) | (f <= 0), NUM))


def _db(cost: Column, salvage: Column, life: Column, period: Column, month: Column) -> Column:
    rate = F.round(1 - F.pow(F.try_divide(salvage, cost), F.try_divide(F.lit(1.0), life)), 3)
    first = cost * rate * month / 12
    done = F.aggregate(_steps(F.lit(2), period), F.struct(first.alias("sum"), first.alias("last")), lambda s, _: F.struct((s["sum"] + (cost - s["sum"]) * rate).alias("sum"), ((cost - s["sum"]) * rate).alias("last")))
    before = F.aggregate(_steps(F.lit(2), life), first, lambda s, _: s + (cost - s) * rate)
    return F.when(period > life, (cost - before) * rate * (12 - month) / 12).otherwise(done["last"])


numbers("DB", 4, 5, (12,), _db, (lambda c, s, n, per, m: (c <= 0) | (s < 0) | (n <= 0) | (per < 1) | (per > n + 1) | (m < 1) | (m > 12), NUM))


@function("NPV", low=2)
def npv(rate, *values):
    r, cells = number(rate), [number(v) for v in values]
    out = F.lit(0.0)
    for i, c in enumerate(cells, 1):
        out = out + c.value / F.pow(1 + r.value, i)
    return raised(out, (r.value == -1, DIV0), over=(r, *cells))


@function("FVSCHEDULE", low=2)
def fvschedule(principal, *rates):
    p, cells = number(principal), [number(r) for r in rates]
    out = p.value
    for c in cells:
        out = out * (1 + c.value)
    return raised(out, over=(p, *cells))


def root(f: Callable[[float], float], guess: float) -> float:
    """A zero of ``f`` above -1: Newton from a guess, then bisection over a grid of rates."""
    x = guess
    for _ in range(100):
        y = f(x)
        slope = (f(x + 1e-7) - f(x - 1e-7)) / 2e-7
        if not slope:
            break
        new = x - y / slope
        if new <= -1:
            new = (x - 1) / 2
        if abs(new - x) < 1e-12:
            return new
        x = new
    grid = [-0.999, -0.9, -0.5, -0.2, -0.05, 0.0, 0.05, 0.1, 0.2, 0.5, 1, 2, 5, 10]
    for a, b in zip(grid, grid[1:], strict=False):
        if f(a) * f(b) <= 0:
            for _ in range(200):
                m = (a + b) / 2
                a, b = (a, m) if f(a) * f(m) <= 0 else (m, b)
            return (a + b) / 2
    raise ValueError


def _rate(n: float, pmt: float, pv: float, fv: float, due: float, guess: float) -> float:
    def f(r: float) -> float:
        if abs(r) < 1e-12:
            return pv + pmt * n + fv
        g = (1 + r) ** n
        return pv * g + pmt * (1 + r * due) * (g - 1) / r + fv

    return root(f, guess)


@function("RATE", low=3, high=6)
def rate(n, pmt, pv, fv=0, due=0, guess=0.1):
    cells = [number(x) for x in (n, pmt, pv, fv, due, guess)]
    out = vectorised(_rate)(*(c.value for c in cells))
    return raised(out, (out.isNull(), NUM), over=tuple(cells))


def irr(values: list[float], guess: float = 0.1) -> float:
    if not (any(v > 0 for v in values) and any(v < 0 for v in values)):
        raise ValueError
    return root(lambda r: sum(v / (1 + r) ** i for i, v in enumerate(values)), guess)


def xirr(values: list[float], days: list[float], guess: float = 0.1) -> float:
    if not (any(v > 0 for v in values) and any(v < 0 for v in values)):
        raise ValueError
    return root(lambda r: sum(v / (1 + r) ** ((d - days[0]) / 365) for v, d in zip(values, days, strict=True)), guess)


@function("IRR")
def irr_(values, guess=0.1):
    """Of an array column of payments in order."""
    c = cell(values)
    out = vectorised(lambda v, g: irr([x or 0.0 for x in v], g))(c.value.cast("array<double>"), F.lit(float(guess)))
    return raised(out, (out.isNull(), NUM), over=(c,))


@function("XIRR")
def xirr_(values, days, guess=0.1):
    """Of array columns of payments and of serials."""
    c, d = cell(values), cell(days)
    out = vectorised(lambda v, t, g: xirr(list(v), list(t), g))(c.value.cast("array<double>"), d.value.cast("array<double>"), F.lit(float(guess)))
    return raised(out, (out.isNull(), NUM), over=(c, d))


@function("XNPV")
def xnpv(rate_, values, days):
    r, v, d = number(rate_), cell(values), cell(days)
    first = F.get(d.value, 0)
    terms = F.zip_with(v.value, d.value, lambda x, t: x / F.pow(1 + r.value, (t - first) / 365))
    return raised(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), (r.value <= -1, NUM), over=(r, v, d))


@function("MIRR")
def mirr(values, finance, reinvest):
    v, a, b = cell(values), number(finance), number(reinvest)
    n = F.size(v.value)
    out_ = F.aggregate(F.transform(v.value, lambda x, i: F.when(x < 0, x / F.pow(1 + a.value, i)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    in_ = F.aggregate(F.transform(v.value, lambda x, i: F.when(x > 0, x * F.pow(1 + b.value, n - 1 - i)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return raised(F.pow(F.try_divide(in_, -out_), F.try_divide(F.lit(1.0), n - 1)) - 1, ((out_ == 0) | (in_ == 0), DIV0), over=(v, a, b))


def _vdb(cost: float, salvage: float, life: float, start: float, end: float, factor: float, no_switch: float) -> float:
    if not (cost >= 0 and salvage >= 0 and life > 0 and 0 <= start <= end <= life):
        raise ValueError
    total, book, t = 0.0, cost, 0
    while t < end:
        span = min(1.0, life - t)
        part = min(book * factor / life, max(0.0, book - salvage))
        if not no_switch:
            part = max(part, (book - salvage) / (life - t) * span if life > t else 0.0)
        part = min(part, max(0.0, book - salvage))
        total += part * max(0.0, min(end, t + 1) - max(start, t))
        book, t = book - part, t + 1
    return total


@function("VDB", low=5, high=7)
def vdb(cost, salvage, life, start, end, factor=2, no_switch=0):
    cells = [number(x) for x in (cost, salvage, life, start, end, factor, no_switch)]
    out = vectorised(_vdb)(*(c.value for c in cells))
    return raised(out, (out.isNull(), NUM), over=tuple(cells))


def _security(name: str, low: int, value: Callable[..., Column], basis_at: int, *rules) -> None:
    """Register a function of settlement, maturity, numbers and a Python basis."""

    @function(name, low=low, high=low + 1)
    def build(settlement, maturity, *rest):
        basis = int(rest[basis_at]) if len(rest) > basis_at else 0
        s, m, cells = cell(settlement), cell(maturity), [number(x) for x in rest[:basis_at]]
        a, b = day(s.value), day(m.value)
        v = [c.value for c in cells]
        return raised(value(yearfrac_(a, b, basis), *v), (a >= b, NUM), *((rule(*v), e) for rule, e in rules), over=(s, m, *cells))


_security("DISC", 4, lambda y, pr, red: (red - pr) / red / y, 2, (lambda pr, red: (pr <= 0) | (red <= 0), NUM))
_security("INTRATE", 4, lambda y, inv, red: (red - inv) / inv / y, 2, (lambda inv, red: (inv <= 0) | (red <= 0), NUM))
_security("RECEIVED", 4, lambda y, inv, disc: inv / (1 - disc * y), 2, (lambda inv, disc: (inv <= 0) | (disc <= 0), NUM))
_security("PRICEDISC", 4, lambda y, disc, red: red - disc * red * y, 2, (lambda disc, red: (disc <= 0) | (red <= 0), NUM))
_security("YIELDDISC", 4, lambda y, pr, red: (red / pr - 1) / y, 2, (lambda pr, red: (pr <= 0) | (red <= 0), NUM))
_security("ACCRINTM", 4, lambda y, r, par: par * r * y, 2, (lambda r, par: (r <= 0) | (par <= 0), NUM))


def _bill(name: str, value: Callable[[Column, Column], Column], rule: Callable[[Column], Column]) -> None:
    @function(name, low=3, high=3)
    def build(settlement, maturity, x):
        s, m, n = cell(settlement), cell(maturity), number(x)
        days = F.datediff(day(m.value), day(s.value))
        return raised(value(n.value, days), ((days <= 0) | (days > 366) | rule(n.value), NUM), over=(s, m, n))


_bill("TBILLPRICE", lambda d, n: 100 * (1 - d * n / 360), lambda d: d <= 0)
_bill("TBILLYIELD", lambda p, n: (100 - p) / p * 360 / n, lambda p: p <= 0)
_bill("TBILLEQ", lambda d, n: F.try_divide(365 * d, 360 - d * n), lambda d: d <= 0)


# Coupon dates are whole numbers of months before maturity.


def _coupon(settlement, maturity, frequency: int) -> Column:
    """A struct of settlement s, maturity m, how many coupons remain n, and the previous and the next coupon date."""
    step = 12 // frequency
    dates = lambda s, m, n: F.struct(s.alias("s"), m.alias("m"), n.alias("n"), F.add_months(m, -n * step).alias("before"), F.add_months(m, -(n - 1) * step).alias("after"))
    counted = lambda s, m, rough: let(dates, s, m, rough + F.when(F.add_months(m, -rough * step) > s, 1).otherwise(0))
    rough = lambda s, m: let(counted, s, m, F.floor(F.months_between(m, s) / step).cast("int"))
    return let(rough, day(cell(settlement).value), day(cell(maturity).value))


def _late(settlement, maturity) -> Column:
    return day(cell(settlement).value) >= day(cell(maturity).value)


def _coupons(name: str, value: Callable[..., Column]) -> None:
    @function(name, low=3, high=4)
    def build(settlement, maturity, frequency: int, basis: int = 0):
        out = let(lambda x: value(x["s"], x["n"], x["before"], x["after"], frequency, basis).cast("double"), _coupon(settlement, maturity, frequency))
        return raised(out, (_late(settlement, maturity), NUM), over=(cell(settlement), cell(maturity)))


def _serial(d: Column) -> Column:
    return F.datediff(d, F.to_date(F.lit("1899-12-30")))


def coupon_days(before: Column, after: Column, frequency: int, basis: int) -> Column:
    return F.datediff(after, before) if basis == 1 else F.lit(365 / frequency if basis == 3 else 360 / frequency)


def since(a: Column, b: Column, basis: int) -> Column:
    return yearfrac_(a, b, basis) * 360 if basis in (0, 4) else F.datediff(b, a)


_coupons("COUPNUM", lambda s, n, a, b, f, k: n)
_coupons("COUPPCD", lambda s, n, a, b, f, k: _serial(a))
_coupons("COUPNCD", lambda s, n, a, b, f, k: _serial(b))
_coupons("COUPDAYBS", lambda s, n, a, b, f, k: since(a, s, k))
_coupons("COUPDAYS", lambda s, n, a, b, f, k: coupon_days(a, b, f, k))
_coupons("COUPDAYSNC", lambda s, n, a, b, f, k: coupon_days(a, b, f, k) - since(a, s, k) if k in (0, 4) else F.datediff(b, s))


def _bond(rate: Column, y: Column, redemption: Column, n: Column, waited: Column, whole: Column, f: int, weigh=lambda t: F.lit(1.0)) -> Column:
    """Discounted coupons and redemption at settlement; ``weigh`` multiplies each by a function of its time in periods."""
    c, left = 100 * rate / f, (whole - waited) / whole
    paid = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, k: s + weigh(k + left) * c / F.pow(1 + y / f, k + left))
    return paid + weigh(n - 1 + left) * redemption / F.pow(1 + y / f, n - 1 + left)


def _periods(x: Column, frequency: int, basis: int) -> tuple[Column, Column]:
    """Days since the last coupon date, and days of the coupon's period."""
    return since(x["before"], x["s"], basis), coupon_days(x["before"], x["after"], frequency, basis)


def _priced(n: Column, waited: Column, whole: Column, r: Column, y: Column, red: Column, frequency: int) -> Column:
    c = 100 * r / frequency
    one = (red + c) / (1 + (whole - waited) / whole * y / frequency)
    return F.when(n == 1, one).otherwise(_bond(r, y, red, n, waited, whole, frequency)) - c * waited / whole


@function("PRICE", low=6, high=7)
def price(settlement, maturity, rate_, yield_, redemption, frequency: int, basis: int = 0):
    r, y, red = number(rate_), number(yield_), number(redemption)

    def body(x: Column, r: Column, y: Column, red: Column) -> Column:
        return let(lambda *v: _priced(*v, frequency), x["n"], *_periods(x, frequency, basis), r, y, red)

    out = let(body, _coupon(settlement, maturity, frequency), r.value, y.value, red.value)
    return raised(out, (_late(settlement, maturity) | (r.value < 0) | (y.value < 0) | (red.value <= 0), NUM), over=(r, y, red))


#: Newton's steps at most; they end once one is below this.
_STEPS, _LAST = 60, 1e-15


def _yield(n: Column, left: Column, c: Column, red: Column, target: Column) -> Column:
    """The yield of a period at which ``n`` coupons ``c``, the first after ``left`` periods, and ``red`` are worth ``target``.

    By Newton's steps from 0 for u, the logarithm of a period's growth: the logarithm of the worth falls ever
    slower with it, so they do not pass the root twice, and it is almost a line, so they are few.
    """

    def sums(v: Column) -> Column:
        # By Horner's rule from the last coupon on: the worth, and the sum of worths times their periods.
        down = lambda a, _: F.struct((c + v * a["worth"]).alias("worth"), (v * (a["times"] + a["worth"])).alias("times"))
        return F.aggregate(F.sequence(F.lit(2), n), F.struct((c + red).cast("double").alias("worth"), F.lit(0.0).alias("times")), down)

    def move(u: Column, a: Column) -> Column:
        return F.try_divide(F.ln(a["worth"] / target) - left * u, left + a["times"] / a["worth"])

    moved = lambda u, by: F.struct((u + by).alias("u"), (F.abs(by) < _LAST).alias("done"))
    step = lambda u: let(moved, u, let(move, u, let(sums, F.exp(-u))))
    start = F.struct(F.lit(0.0).alias("u"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, lambda s, _: F.when(s["done"], s).otherwise(step(s["u"])), lambda s: F.expm1(s["u"]))


def _once(c: Cell) -> Cell:
    """``c`` as a number, read from one copy of its expression."""
    seen = let(lambda v: number(v).struct(), c.value)
    return raised(seen["value"], (seen["error"].isNotNull(), VALUE), over=(c,))


@function("YIELD", low=6, high=7)
def yield_(settlement, maturity, rate_, price_, redemption, frequency: int, basis: int = 0):
    """In one step where one coupon is left, else by Newton's steps."""
    r, given, red = number(rate_), cell(price_), number(redemption)
    # The price may be a long expression: it stands here once.
    p = _once(given)

    def body(x: Column, r: Column, p: Column, red: Column) -> Column:
        return let(named, x["n"], *_periods(x, frequency, basis), r, p, red)

    def named(n: Column, waited: Column, whole: Column, r: Column, p: Column, red: Column) -> Column:
        return let(solved, n, (whole - waited) / whole, 100 * r / frequency, red, p + 100 * r / frequency * waited / whole)

    def solved(n: Column, left: Column, c: Column, red: Column, target: Column) -> Column:
        return F.when(n == 1, F.try_divide(((red + c) / target - 1) * frequency, left)).otherwise(frequency * _yield(n, left, c, red, target))

    out = let(body, _coupon(settlement, maturity, frequency), r.value, p.value, red.value)
    return raised(out, (_late(settlement, maturity) | (r.value < 0) | (p.value <= 0) | (red.value <= 0), NUM), over=(r, p, red))


def _duration(modified: bool):
    def build(settlement, maturity, coupon, yield_, frequency: int, basis: int = 0):
        r, y = number(coupon), number(yield_)

        def weighed(n: Column, waited: Column, whole: Column, r: Column, y: Column) -> Column:
            args = (r, y, F.lit(100.0), n, waited, whole, frequency)
            out = _bond(*args, weigh=lambda t: t / frequency) / _bond(*args)
            return out / (1 + y / frequency) if modified else out

        out = let(lambda x, r, y: let(weighed, x["n"], *_periods(x, frequency, basis), r, y), _coupon(settlement, maturity, frequency), r.value, y.value)
        return raised(out, (_late(settlement, maturity) | (r.value < 0) | (y.value < 0), NUM), over=(r, y))

    return build


function("DURATION", low=5, high=6)(_duration(False))
function("MDURATION", low=5, high=6)(_duration(True))


def _at_maturity(solve_yield: bool):
    def build(settlement, maturity, issue, rate_, x, basis: int = 0):
        s, m, i = (day(cell(d).value) for d in (settlement, maturity, issue))
        r, v = number(rate_), number(x)

        def priced(whole: Column, before: Column, rest: Column) -> Column:
            if solve_yield:
                return ((1 + whole * r.value) / (v.value / 100 + before * r.value) - 1) / rest
            return (100 + whole * r.value * 100) / (1 + rest * v.value) - before * r.value * 100

        out = let(lambda s, m, i: priced(yearfrac_(i, m, basis), yearfrac_(i, s, basis), yearfrac_(s, m, basis)), s, m, i)
        return raised(out, ((s >= m) | (r.value < 0), NUM), over=(r, v))

    return build


function("PRICEMAT", low=5, high=6)(_at_maturity(False))
function("YIELDMAT", low=5, high=6)(_at_maturity(True))


@function("ACCRINT", low=6, high=8)
def accrint(issue, first_interest, settlement, rate_, par, frequency: int, basis: int = 0, calc_method=True):
    i, s = (day(cell(d).value) for d in (issue, settlement))
    r, p = number(rate_), number(par)
    return raised(p.value * r.value * yearfrac_(i, s, basis), ((i >= s) | (r.value <= 0) | (p.value <= 0), NUM), over=(r, p))


def _amortised(name: str, share: Callable[..., Column]) -> None:
    @function(name, low=6, high=7)
    def build(cost, purchased, first_end, salvage, period, rate_, basis: int = 0):
        a, b = day(cell(purchased).value), day(cell(first_end).value)
        c, s, p, r = (number(x) for x in (cost, salvage, period, rate_))
        out, bad = share(c.value, s.value, F.floor(p.value), r.value, yearfrac_(a, b, basis))
        bad = bad | (r.value <= 0) | (p.value < 0) | (s.value < 0) | (s.value > c.value) | (a > b) | F.lit(basis not in (0, 1, 3, 4))
        return raised(out, (bad, NUM), over=(c, s, p, r))


def _linear(cost: Column, salvage: Column, period: Column, rate: Column, part: Column) -> tuple[Column, Column]:
    """The same each period, but a part in the first and what is left in the last."""
    each, first = cost * rate, cost * rate * part
    left = cost - salvage - first - each * (period - 1)
    return F.when(period == 0, first).otherwise(F.greatest(F.lit(0.0), F.least(each, left))), F.lit(False)


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def _degressive(cost: Column, salvage: Column, period: Column, rate: Column, part: Column) -> tuple[Column, Column]:
    """A share of the book value each period, in whole numbers, by a coefficient that follows from the life; fixed values."""
    life = 1 / rate
    by = F.when((life >= 3) & (life <= 4), 1.5).when((life >= 5) & (life <= 6), 2.0).when(life > 6, 2.5)
    first = _half_up(cost * rate * by * part)
    step = lambda s: F.least(_half_up(s["book"] * rate * by), F.greatest(F.lit(0.0), s["book"] - salvage))
    end = F.aggregate(_steps(F.lit(1), period), F.struct((cost - first).alias("book"), first.alias("last")), lambda s, _: F.struct((s["book"] - step(s)).alias("book"), step(s).alias("last")))
    return end["last"], by.isNull()


_amortised("AMORLINC", _linear)
_amortised("AMORDEGRC", _degressive)
