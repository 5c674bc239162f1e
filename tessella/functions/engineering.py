"""Number bases, bits, error function, Bessel functions and complex numbers."""

from __future__ import annotations

import cmath
import math
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.functions.cell import NUM, VALUE, Cell, Unbound, function, inside, number, raised, text
from tessella.functions.math import _to_base

#: Digits of each base, and how many make a negative number; fixed values.
_BASES = {"BIN": (2, 10), "OCT": (8, 10), "HEX": (16, 10)}


def _from(name: str, t: Cell) -> tuple:
    base, width = _BASES[name]
    digits = F.upper(F.trim(t.value))
    n = F.conv(F.when(digits == "", "0").otherwise(digits), base, 10).cast("double")
    value = F.when((F.length(digits) == width) & (n >= base**width / 2), n - float(base) ** width).otherwise(n)
    shape = {"BIN": "^[01]{0,10}$", "OCT": "^[0-7]{0,10}$", "HEX": "^[0-9A-F]{0,10}$"}[name]
    return value, ~digits.rlike(shape)


def _into(name: str, value, places: Cell | None):
    base, width = _BASES[name]
    half = float(base) ** width / 2
    whole = F.when(value < 0, value + 2 * half).otherwise(value)
    digits = F.upper(_to_base(whole, F.lit(float(base))))
    bad = (value < -half) | (value >= half)
    if places is None:
        return digits, bad
    k = F.floor(places.value)
    return F.when(value < 0, digits).otherwise(F.lpad(digits, F.greatest(k, F.length(digits)).cast("int"), "0")), bad | (k < 0) | ((value >= 0) & (F.length(digits) > k))


def _bases() -> None:
    for a in _BASES:

        @function(f"{a}2DEC", low=1, high=1)
        def to_decimal(x, a=a):
            t = text(x)
            value, bad = _from(a, t)
            return raised(value, (bad, NUM), over=(t,))

        @function(f"DEC2{a}", low=1, high=2)
        def from_decimal(x, places=None, a=a):
            n, p = number(x), None if places is None else number(places)
            digits, bad = _into(a, F.floor(n.value), p)
            return raised(digits, (bad, NUM), over=(n, *([p] if p else [])))

        for b in _BASES:
            if a != b:

                @function(f"{a}2{b}", low=1, high=2)
                def between(x, places=None, a=a, b=b):
                    t, p = text(x), None if places is None else number(places)
                    value, bad = _from(a, t)
                    digits, worse = _into(b, value, p)
                    return raised(digits, (bad | worse, NUM), over=(t, *([p] if p else [])))


_bases()


@function("DELTA")
def delta(x, y=0):
    a, b = number(x), number(y)
    return raised((a.value == b.value).cast("double"), over=(a, b))


@function("GESTEP")
def gestep(x, step=0):
    a, b = number(x), number(step)
    return raised((a.value >= b.value).cast("double"), over=(a, b))


_MOST = float(2**48 - 1)


def _bits(name: str, op) -> None:
    @function(name, low=2, high=2)
    def build(x, y):
        a, b = number(x), number(y)
        bad = [(c.value < 0) | (c.value > _MOST) | (c.value != F.floor(c.value)) for c in (a, b)]
        return raised(op(a.value.try_cast("bigint"), b.value.try_cast("bigint")).cast("double"), (bad[0] | bad[1], NUM), over=(a, b))


_bits("BITAND", lambda a, b: a.bitwiseAND(b))
_bits("BITOR", lambda a, b: a.bitwiseOR(b))
_bits("BITXOR", lambda a, b: a.bitwiseXOR(b))


def _shift(name: str, sign: int) -> None:
    @function(name, low=2, high=2)
    def build(x, y):
        a, b = number(x), number(y)
        out = F.floor(a.value * F.pow(F.lit(2.0), sign * b.value))
        return raised(out.cast("double"), ((a.value < 0) | (a.value > _MOST) | (F.abs(b.value) > 53) | (out > _MOST), NUM), over=(a, b))


_shift("BITLSHIFT", 1)
_shift("BITRSHIFT", -1)


def _codes(s: pd.Series):
    """A number for each value and how many there are; None where values are lists.  0.0 and -0.0 are two values."""
    if s.dtype.kind == "f":
        bits = np.ascontiguousarray(s.to_numpy(np.float64)).view(np.int64)
        codes, found = pd.factorize(bits)
    elif pd.api.types.infer_dtype(s, skipna=True) in ("string", "empty", "integer", "boolean"):
        codes, found = pd.factorize(s, use_na_sentinel=False)
    else:
        return None
    return codes, len(found)


def _distinct(columns: tuple[pd.Series, ...]):
    """The number of each row of a batch, equal for equal rows, and the first row of each number; None where values are lists."""
    codes = np.zeros(len(columns[0]), np.int64)
    for s in columns:
        found = _codes(s)
        if found is None:
            return None
        if found[1] > 1:
            codes = pd.factorize(codes * found[1] + found[0])[0] if codes.any() else found[0]
    # The last one written to a place is the first row of its number.
    first = np.zeros(codes.max() + 1 if len(codes) else 0, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def by_distinct(f: Callable, *columns: pd.Series, made: Callable = list):
    """``f`` of each row of a batch, as ``made`` puts results; it is called once for rows that are equal."""
    found = _distinct(columns)
    if found is None:
        return made([f(*row) for row in zip(*columns, strict=True)])
    codes, first = found
    out = made([f(*row) for row in zip(*(s.iloc[first].tolist() for s in columns), strict=True)])
    return [out[i] for i in codes.tolist()] if made is list else out[codes]


def vectorised(f: Callable[..., float], kind: str = "double"):
    """An Arrow UDF over columns of arguments that gives null where ``f`` raises or is not finite."""

    @F.pandas_udf(kind)
    def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
        def one(*args):
            try:
                if any(a is None or (isinstance(a, float) and a != a) for a in args):
                    return None
                out = f(*args)
                return out if not isinstance(out, float) or math.isfinite(out) else None
            except (ValueError, ZeroDivisionError, OverflowError, IndexError):
                return None

        dtype = "object" if kind == "string" else "float64"
        return pd.Series(by_distinct(one, first, *rest, made=lambda found: np.array(found, dtype)), dtype=dtype)

    def applied(*columns: Column) -> Column:
        if inside[0]:
            raise Unbound  # a Python function cannot be called in a lambda function of columns
        return run(*columns)

    return applied


def _fixed(x) -> bool:
    """Whether an argument is a number that all rows share, which need not be sent with each."""
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def _with(f: Callable[..., float], fixed: dict[int, float]) -> Callable[..., float]:
    """``f`` of the arguments that are not fixed at their places."""
    if not fixed:
        return f

    def rest(*args):
        every = list(args)
        for i, x in fixed.items():  # by ascending place
            every.insert(i, x)
        return f(*every)

    return rest


def computed(*names: str, f: Callable[..., float], low: int, high: int | None = None, defaults: tuple = ()) -> None:
    """Register functions of numbers that no column expression gives; ``#NUM!`` where ``f`` fails."""
    # One function for the same numbers at the same places, so that Spark computes equal calls once.
    runs = {}

    @function(*names, low=low, high=high or low)
    def build(*args):
        if defaults:
            args = (*args, *defaults[len(args) - low :])
        fixed = {i: float(a) for i, a in enumerate(args) if _fixed(a)}
        if len(fixed) == len(args):
            fixed = {}
        key = repr(fixed)
        if key not in runs:
            runs[key] = vectorised(_with(f, fixed))
        cells = [number(a) for i, a in enumerate(args) if i not in fixed]
        out = runs[key](*(c.value for c in cells))
        return raised(out, (out.isNull(), NUM), over=tuple(cells))


@function("ERF", low=1, high=2)
def erf(low, high=None):
    run = vectorised(math.erf)
    a = number(low)
    if high is None:
        return raised(run(a.value), over=(a,))
    b = number(high)
    return raised(run(b.value) - run(a.value), over=(a, b))


computed("ERF.PRECISE", f=math.erf, low=1)
computed("ERFC", "ERFC.PRECISE", f=math.erfc, low=1)


def _integral(f: Callable[[np.ndarray], np.ndarray], low: float, high: float, n: int = 2000) -> float:
    """By Simpson's rule over ``n`` steps, an even number."""
    weights = np.full(n + 1, 2.0)
    weights[1::2] = 4.0
    weights[[0, n]] = 1.0
    with np.errstate(all="ignore"):
        return float((high - low) / n / 3 * (weights @ f(np.linspace(low, high, n + 1))))


def _whole(n: float) -> int:
    if n < 0:
        raise ValueError
    return int(n)


def _steps(x: float, k: int) -> int:
    """Steps over half a period: what they leave out of the integral are Bessel functions of orders beyond them, nothing at this size."""
    return 200 if abs(x) + k <= 50 else 2000


def _j(x: float, n: float) -> float:
    k = _whole(n)
    return _integral(lambda t: np.cos(k * t - x * np.sin(t)), 0, math.pi, _steps(x, k)) / math.pi


def _i(x: float, n: float) -> float:
    k = _whole(n)
    return _integral(lambda t: np.exp(x * np.cos(t)) * np.cos(k * t), 0, math.pi, _steps(x, k)) / math.pi


def _y(x: float, n: float) -> float:
    k = _whole(n)
    if x <= 0:
        raise ValueError
    a = _integral(lambda t: np.sin(x * np.sin(t) - k * t), 0, math.pi) / math.pi
    top = math.asinh((60 + k * 12) / x) if x else 0
    return a - _integral(lambda t: (np.exp(k * t) + (-1) ** k * np.exp(-k * t)) * np.exp(-x * np.sinh(t)), 0, top, 6000) / math.pi


def _k(x: float, n: float) -> float:
    k = _whole(n)
    if x <= 0:
        raise ValueError
    top = math.acosh(1 + (60 + k * 12) / x)
    return _integral(lambda t: np.exp(-x * np.cosh(t)) * np.cosh(k * t), 0, top, 6000)


for _name, _f in (("BESSELJ", _j), ("BESSELI", _i), ("BESSELY", _y), ("BESSELK", _k)):
    computed(_name, f=_f, low=2)


# Complex numbers are text: 3+4i.


def parse_complex(s: str) -> complex:
    s = s.strip().replace("j", "i")
    if not s:
        return 0j
    if not s.endswith("i"):
        return complex(float(s), 0)
    body = s[:-1]
    cut = max(body.rfind("+"), body.rfind("-"))
    while cut > 0 and body[cut - 1] in "eE":
        cut = max(body.rfind("+", 0, cut), body.rfind("-", 0, cut))
    real, imag = (body[:cut], body[cut:]) if cut > 0 else ("", body)
    return complex(float(real or 0), float(imag + "1") if imag in ("", "+", "-") else float(imag))


def show_complex(z: complex, suffix: str = "i") -> str:
    def part(x: float) -> str:
        return f"{x:.15g}"

    real, imag = (0.0 if abs(v) < 1e-300 else v for v in (z.real, z.imag))
    if imag == 0:
        return part(real)
    shown = {1.0: "", -1.0: "-"}.get(imag, part(imag)) + suffix
    return shown if real == 0 else part(real) + ("+" if imag > 0 else "") + shown


def _lazily(f: Callable, kind: str = "double") -> Callable:
    """``vectorised`` on first use, and the same one from then on: Spark computes equal calls of one function once."""
    return cache(lambda: vectorised(f, kind))


def _complex(name: str, f: Callable, high: int = 1) -> None:
    def shown(*some: str) -> str:
        return show_complex(f(*map(parse_complex, some)), "j" if any("j" in s for s in some) else "i")

    run = _lazily(shown, "string")

    @function(name, low=1, high=high)
    def build(*args):
        cells = [text(a) for a in args]
        out = run()(*(c.value for c in cells))
        return raised(out, (out.isNull(), NUM), over=tuple(cells))


def _measure(name: str, f: Callable) -> None:
    run = _lazily(lambda s: float(f(parse_complex(s))))

    @function(name, low=1, high=1)
    def build(x):
        c = text(x)
        out = run()(c.value)
        return raised(out, (out.isNull(), NUM), over=(c,))


def _phase(z: complex) -> float:
    if z == 0:
        raise ZeroDivisionError
    return cmath.phase(z)


for _name, _f in (("IMREAL", lambda z: z.real), ("IMAGINARY", lambda z: z.imag), ("IMABS", abs), ("IMARGUMENT", _phase)):
    _measure(_name, _f)
for _name, _f in (
    ("IMCONJUGATE", lambda z: z.conjugate()), ("IMSQRT", cmath.sqrt), ("IMEXP", cmath.exp), ("IMLN", cmath.log), ("IMLOG10", cmath.log10), ("IMLOG2", lambda z: cmath.log(z) / math.log(2)),
    ("IMSIN", cmath.sin), ("IMCOS", cmath.cos), ("IMTAN", cmath.tan), ("IMSINH", cmath.sinh), ("IMCOSH", cmath.cosh), ("IMSEC", lambda z: 1 / cmath.cos(z)), ("IMCSC", lambda z: 1 / cmath.sin(z)),
    ("IMCOT", lambda z: 1 / cmath.tan(z)), ("IMSECH", lambda z: 1 / cmath.cosh(z)), ("IMCSCH", lambda z: 1 / cmath.sinh(z)),
):
    _complex(_name, _f)
_complex("IMSUM", lambda *z: sum(z), 255)
_complex("IMPRODUCT", lambda *z: math.prod(z, start=1 + 0j), 255)
_complex("IMSUB", lambda a, b: a - b, 2)
_complex("IMDIV", lambda a, b: a / b, 2)


@function("IMPOWER")
def impower(x, n):
    c, k = text(x), number(n)
    out = vectorised(lambda s, p: show_complex(parse_complex(s) ** p), "string")(c.value, k.value)
    return raised(out, (out.isNull(), NUM), over=(c, k))


_COMPLEX = {k: _lazily(lambda x, y, k=k: show_complex(complex(x, y), k), "string") for k in ("i", "j")}


@function("COMPLEX")
def complex_(real, imag, suffix: str = "i"):
    a, b = number(real), number(imag)
    if suffix not in ("i", "j"):
        return Cell(F.lit(None).cast("string"), F.lit(VALUE))
    out = _COMPLEX[suffix]()(a.value, b.value)
    return raised(out, over=(a, b))
