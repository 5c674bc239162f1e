"""Arithmetic, rounding, trigonometry and combinatorics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.cell import DIV0, NA, NUM, VALUE, Cell, function, number, raised, text

INF = float("inf")


def unary(*names: str, value, rules=()):
    """Register functions of one number."""

    @function(*names, low=1, high=1)
    def build(x):
        n = number(x)
        return raised(value(n.value), *((c(n.value), e) for c, e in rules), over=(n,))

    return build


def binary(*names: str, value, rules=(), default=None):
    """Register functions of two numbers, the second of which may have a default."""

    @function(*names, low=2 if default is None else 1, high=2)
    def build(x, y=default):
        a, b = number(x), number(y)
        return raised(value(a.value, b.value), *((c(a.value, b.value), e) for c, e in rules), over=(a, b))

    return build


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def _strange(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == INF)


unary("ABS", value=F.abs)
unary("SIGN", value=F.signum)
unary("SQRT", value=lambda x: F.sqrt(F.greatest(x, F.lit(0.0))), rules=[(lambda x: x < 0, NUM)])
unary("EXP", value=F.exp, rules=[(lambda x: F.exp(x) == INF, NUM)])
unary("LN", value=F.ln, rules=[(lambda x: x <= 0, NUM)])
unary("LOG10", value=F.log10, rules=[(lambda x: x <= 0, NUM)])
unary("SQRTPI", value=lambda x: F.sqrt(F.abs(x) * math.pi), rules=[(lambda x: x < 0, NUM)])
unary("INT", value=lambda x: F.floor(x).cast("double"))
binary("LOG", value=lambda x, b: F.ln(x) / F.ln(b), rules=[(lambda x, b: (x <= 0) | (b <= 0), NUM), (lambda x, b: b == 1, DIV0)], default=10)
binary("MOD", value=lambda n, d: n - d * F.floor(F.try_divide(n, d)), rules=[(lambda n, d: d == 0, DIV0)])
binary("QUOTIENT", value=lambda n, d: trunc(F.try_divide(n, d)), rules=[(lambda n, d: d == 0, DIV0)])
binary("POWER", value=F.pow, rules=[(lambda a, b: (a == 0) & (b < 0), DIV0), (lambda a, b: _strange(F.pow(a, b)), NUM)])

# Rounding works in binary, by a factor of ten: 1.005 to two digits is 1.


def _scaled(step):
    return lambda n, d: F.signum(n) * step(F.abs(n) * F.pow(F.lit(10.0), trunc(d))) / F.pow(F.lit(10.0), trunc(d))


binary("ROUND", value=_scaled(lambda x: F.floor(x + 0.5)))
binary("ROUNDUP", value=_scaled(F.ceil))
binary("ROUNDDOWN", value=_scaled(F.floor))
binary("TRUNC", value=_scaled(F.floor), default=0)
binary("MROUND", value=lambda n, m: F.when(m == 0, 0.0).otherwise(F.floor(F.try_divide(n, m) + 0.5) * m), rules=[(lambda n, m: n * m < 0, NUM)])
binary("CEILING", "ECMA.CEILING", value=lambda n, s: F.when(s == 0, 0.0).otherwise(F.ceil(F.try_divide(n, s)) * s), rules=[(lambda n, s: (n > 0) & (s < 0), NUM)])
binary("FLOOR", value=lambda n, s: F.floor(F.try_divide(n, s)) * s, rules=[(lambda n, s: s == 0, DIV0), (lambda n, s: (n > 0) & (s < 0), NUM)])
binary("CEILING.PRECISE", "ISO.CEILING", value=lambda n, s: F.when(s == 0, 0.0).otherwise(F.ceil(F.try_divide(n, F.abs(s))) * F.abs(s)), default=1)
binary("FLOOR.PRECISE", value=lambda n, s: F.when(s == 0, 0.0).otherwise(F.floor(F.try_divide(n, F.abs(s))) * F.abs(s)), default=1)
unary("EVEN", value=lambda x: F.signum(x) * F.ceil(F.abs(x) / 2) * 2)
unary("ODD", value=lambda x: F.when(x < 0, -1.0).otherwise(1.0) * (F.ceil((F.greatest(F.abs(x), F.lit(1.0)) - 1) / 2) * 2 + 1))


def _math_step(name: str, up) -> None:
    @function(name, low=1, high=3)
    def build(x, significance=1, mode=0):
        n, s, m = number(x), number(significance), number(mode)
        size = F.abs(s.value)
        q = F.try_divide(n.value, size)
        away = (n.value < 0) & (m.value != 0)
        out = F.when(away, F.floor(q) if up else F.ceil(q)).otherwise(F.ceil(q) if up else F.floor(q))
        return raised(F.when(size == 0, 0.0).otherwise(out * size), over=(n, s, m))


_math_step("CEILING.MATH", True)
_math_step("FLOOR.MATH", False)

for _name, _f in (("SIN", F.sin), ("COS", F.cos), ("TAN", F.tan), ("ATAN", F.atan), ("DEGREES", F.degrees), ("RADIANS", F.radians), ("SINH", F.sinh), ("COSH", F.cosh), ("TANH", F.tanh), ("ASINH", F.asinh), ("SEC", F.sec)):
    unary(_name, value=_f, rules=[(lambda x, f=_f: _strange(f(x)), NUM)])
for _name, _f in (("ASIN", F.asin), ("ACOS", F.acos)):
    unary(_name, value=_f, rules=[(lambda x: F.abs(x) > 1, NUM)])
unary("ACOSH", value=F.acosh, rules=[(lambda x: x < 1, NUM)])
unary("ATANH", value=F.atanh, rules=[(lambda x: F.abs(x) >= 1, NUM)])
unary("SECH", value=lambda x: F.try_divide(F.lit(1.0), F.cosh(x)))
for _name, _f in (("COT", F.tan), ("CSC", F.sin), ("COTH", F.tanh), ("CSCH", F.sinh)):
    unary(_name, value=lambda x, f=_f: F.try_divide(F.lit(1.0), f(x)), rules=[(lambda x: x == 0, DIV0)])
unary("ACOT", value=lambda x: math.pi / 2 - F.atan(x))
unary("ACOTH", value=lambda x: 0.5 * F.ln(F.try_divide(x + 1, x - 1)), rules=[(lambda x: F.abs(x) <= 1, NUM)])
binary("ATAN2", value=lambda x, y: F.atan2(y, x), rules=[(lambda x, y: (x == 0) & (y == 0), DIV0)])


@function("PI", low=0, high=0)
def pi():
    return Cell(F.lit(math.pi))


def falling(n: Column, k: Column) -> Column:
    """n * (n - 1) * ... over k factors; k is a whole number of 0 or more."""
    steps = F.when(k >= 1, F.sequence(F.lit(0), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda s, i: s * (n - i))


def choose(n: Column, k: Column) -> Column:
    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.round(F.aggregate(steps, F.lit(1.0), lambda s, i: s * (n - k + i) / i), 0)


unary("FACT", value=lambda x: falling(F.floor(x), F.floor(x)), rules=[(lambda x: (x < 0) | (x > 170), NUM)])
unary("FACTDOUBLE", value=lambda x: F.aggregate(F.when(x >= 2, F.sequence(F.floor(x).cast("int"), F.lit(1), F.lit(-2))).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda s, i: s * i), rules=[(lambda x: x < -1, NUM)])
_bad = [(lambda n, k: (F.floor(n) < 0) | (F.floor(k) < 0) | (F.floor(k) > F.floor(n)), NUM)]
binary("COMBIN", value=lambda n, k: choose(F.floor(n), F.floor(k)), rules=_bad)
binary("PERMUT", value=lambda n, k: falling(F.floor(n), F.floor(k)), rules=_bad)
binary("COMBINA", value=lambda n, k: F.when((F.floor(n) == 0) & (F.floor(k) == 0), 1.0).otherwise(choose(F.floor(n) + F.floor(k) - 1, F.floor(k))), rules=[(lambda n, k: (n < 0) | (k < 0), NUM)])
binary("PERMUTATIONA", value=lambda n, k: F.pow(F.floor(n), F.floor(k)), rules=[(lambda n, k: (n < 0) | (k < 0), NUM)])


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's remainders; a pair of doubles is done after 80 steps."""
    steps = F.sequence(F.lit(1), F.lit(80))
    pair = F.aggregate(steps, F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] - s["b"] * F.floor(F.try_divide(s["a"], s["b"]))).alias("b"))))
    return pair["a"]


@function("GCD")
def gcd(*xs):
    cells = [number(x) for x in xs]
    out = F.floor(cells[0].value).cast("double")
    for c in cells[1:]:
        out = _gcd(out, F.floor(c.value).cast("double"))
    return raised(out, *((c.value < 0, NUM) for c in cells), over=tuple(cells))


@function("LCM")
def lcm(*xs):
    cells = [number(x) for x in xs]
    out = F.floor(cells[0].value).cast("double")
    for c in cells[1:]:
        n = F.floor(c.value).cast("double")
        out = F.coalesce(F.try_divide(out * n, _gcd(out, n)), F.lit(0.0))
    return raised(out, *((c.value < 0, NUM) for c in cells), over=tuple(cells))


@function("MULTINOMIAL")
def multinomial(*xs):
    cells = [number(x) for x in xs]
    whole = [F.floor(c.value) for c in cells]
    total, out = F.lit(0.0), F.lit(1.0)
    for n in whole:
        total = total + n
        out = out * choose(total, n)
    return raised(out, *((c.value < 0, NUM) for c in cells), over=tuple(cells))


@function("SERIESSUM", low=4)
def seriessum(x, n, m, *coefficients):
    a, b, c = number(x), number(n), number(m)
    some = [number(k) for k in coefficients]
    out = F.lit(0.0)
    for i, k in enumerate(some):
        out = out + k.value * F.pow(a.value, b.value + i * c.value)
    return raised(out, over=(a, b, c, *some))


#: Roman numerals of decimal digits; fixed values.
_ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


@function("ROMAN", low=1, high=2)
def roman(x, form=0):
    n = number(x)
    digit = lambda scale: F.pmod(F.floor(n.value / scale).cast("int"), F.lit(10))
    signs = lambda one, five, ten: F.array(*map(F.lit, ("", one, 2 * one, 3 * one, one + five, five, five + one, five + 2 * one, five + 3 * one, one + ten)))
    places = ((1000, signs("M", "", "")), (100, signs("C", "D", "M")), (10, signs("X", "L", "C")), (1, signs("I", "V", "X")))
    return raised(F.concat(*(F.coalesce(F.get(names, digit(scale)), F.lit("")) for scale, names in places)), ((n.value < 0) | (n.value >= 4000), VALUE), over=(n,))


@function("ARABIC")
def arabic(x):
    t = text(x)
    upper = F.upper(F.trim(t.value))
    signs = F.split(F.regexp_replace(upper, "^-", ""), "")
    worth = lambda c: F.coalesce(F.element_at(F.create_map(*(F.lit(v) for n, s in _ROMAN if len(s) == 1 for v in (s, n))), c), F.lit(0))
    total = F.aggregate(F.reverse(F.transform(signs, worth)), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, w: F.struct((s["sum"] + F.when(w < s["last"], -w).otherwise(w)).alias("sum"), F.greatest(w, s["last"]).alias("last")))["sum"]
    return raised((total * F.when(upper.startswith("-"), -1).otherwise(1)).cast("double"), (~upper.rlike("^-?[MDCLXVI]*$"), VALUE), over=(t,))


@function("BASE", low=2, high=3)
def base(x, radix, length=0):
    n, r, k = number(x), number(radix), number(length)
    digits = F.upper(_to_base(F.floor(n.value), r.value))
    return raised(F.when(F.length(digits) < k.value, F.lpad(digits, k.value.cast("int"), "0")).otherwise(digits), ((n.value < 0) | (r.value < 2) | (r.value > 36), NUM), over=(n, r, k))


def _to_base(n: Column, radix: Column) -> Column:
    """Digits of a whole number: by Spark's own where a double holds it exactly, else from the lowest up, 53 at most."""
    r = F.floor(radix)
    signs = F.lit("0123456789abcdefghijklmnopqrstuvwxyz")
    pair = F.aggregate(
        F.sequence(F.lit(1), F.lit(53)),
        F.struct(n.cast("double").alias("n"), F.lit("").alias("s")),
        lambda s, _: F.when((s["n"] < 1) & (s["s"] != ""), s).otherwise(F.struct(F.floor(s["n"] / r).cast("double").alias("n"), F.concat(F.substr(signs, (s["n"] - r * F.floor(s["n"] / r) + 1).cast("int"), F.lit(1)), s["s"]).alias("s"))),
    )
    exact = F.call_function("conv", n.try_cast("bigint").cast("string"), F.lit(10), r.cast("int"))
    return F.when((n >= 0) & (n < float(2**53)), exact).otherwise(pair["s"])


@function("DECIMAL")
def decimal(x, radix):
    t, r = text(x), number(radix)
    low = F.lower(F.trim(t.value))
    signs = F.lit("0123456789abcdefghijklmnopqrstuvwxyz")
    digit = lambda c: F.instr(signs, c) - 1
    value = F.aggregate(F.split(low, ""), F.lit(0.0), lambda s, c: F.when(c == "", s).otherwise(s * r.value + digit(c)))
    bad = F.exists(F.split(low, ""), lambda c: (c != "") & ((digit(c) < 0) | (digit(c) >= r.value)))
    return raised(value, (bad | (r.value < 2) | (r.value > 36), NUM), over=(t, r))


#: Factors of units to the base of their category, and how temperatures become kelvin; fixed values.
UNITS = {
    "mass": {"g": 1.0, "kg": 1000.0, "mg": 0.001, "lbm": 453.59237, "ozm": 28.349523125, "stone": 6350.29318, "ton": 907184.74, "grain": 0.06479891, "u": 1.66053100460465e-24, "sg": 14593.9029372064},
    "length": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "Nmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10, "ell": 1.143, "ly": 9.46073047258080e15, "pc": 3.08567758128155e16},
    "time": {"sec": 1.0, "s": 1.0, "min": 60.0, "mn": 60.0, "hr": 3600.0, "day": 86400.0, "d": 86400.0, "yr": 31557600.0},
    "pressure": {"Pa": 1.0, "p": 1.0, "atm": 101325.0, "at": 101325.0, "mmHg": 133.322, "psi": 6894.75729316836, "Torr": 133.322368421053},
    "force": {"N": 1.0, "dyn": 1e-5, "dy": 1e-5, "lbf": 4.4482216152605, "pond": 0.00980665},
    "energy": {"J": 1.0, "e": 1e-7, "c": 4.184, "cal": 4.1868, "eV": 1.60217653e-19, "ev": 1.60217653e-19, "HPh": 2684519.53769617, "Wh": 3600.0, "wh": 3600.0, "flb": 1.3558179483314, "BTU": 1055.05585262, "btu": 1055.05585262},
    "power": {"W": 1.0, "w": 1.0, "HP": 745.69987158227, "h": 745.69987158227, "PS": 735.49875},
    "magnetism": {"T": 1.0, "ga": 1e-4},
    "volume": {"l": 1.0, "L": 1.0, "lt": 1.0, "ml": 0.001, "tsp": 0.00492892159375, "tbs": 0.01478676478125, "oz": 0.0295735295625, "cup": 0.2365882365, "pt": 0.473176473, "us_pt": 0.473176473, "qt": 0.946352946, "gal": 3.785411784, "m3": 1000.0},
    "area": {"m2": 1.0, "ha": 10000.0, "uk_acre": 4046.8564224, "us_acre": 4046.87260987425, "ft2": 0.09290304, "in2": 0.00064516, "km2": 1e6, "mi2": 2589988.110336},
    "speed": {"m/s": 1.0, "m/sec": 1.0, "m/h": 1 / 3600, "m/hr": 1 / 3600, "mph": 0.44704, "kn": 0.514444444444444, "admkn": 0.514773333333333, "km/h": 1 / 3.6},
    "information": {"bit": 1.0, "byte": 8.0, "kbyte": 8000.0, "kbit": 1000.0},
}
_KELVIN = {"C": (1.0, 273.15), "cel": (1.0, 273.15), "F": (5 / 9, 459.67 * 5 / 9), "fah": (5 / 9, 459.67 * 5 / 9), "K": (1.0, 0.0), "kel": (1.0, 0.0), "Rank": (5 / 9, 0.0), "Reau": (1.25, 273.15)}


@function("CONVERT")
def convert(x, from_unit: str, to_unit: str):
    """Units are Python strings: the factor is then a constant of the plan."""
    n = number(x)
    for units in UNITS.values():
        if from_unit in units and to_unit in units:
            return raised(n.value * units[from_unit] / units[to_unit], over=(n,))
    if from_unit in _KELVIN and to_unit in _KELVIN:
        (a, b), (c, d) = _KELVIN[from_unit], _KELVIN[to_unit]
        return raised((n.value * a + b - d) / c, over=(n,))
    return Cell(F.lit(None).cast("double"), F.lit(NA))


@function("RAND", low=0, high=1)
def rand(seed=42):
    return Cell(F.rand(seed))


@function("RANDBETWEEN", low=2, high=3)
def randbetween(low, high, seed=42):
    a, b = number(low), number(high)
    return raised(F.floor(F.rand(seed) * (F.floor(b.value) - F.ceil(a.value) + 1)) + F.ceil(a.value), (F.ceil(a.value) > F.floor(b.value), NUM), over=(a, b))

