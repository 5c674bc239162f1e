"""Conditions, errors and kinds of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessella.functions.cell import ERRORS, NA, VALUE, Cell, cell, function, number, raised


def truth(x) -> Cell:
    """As a condition: numbers by being other than 0, text TRUE or FALSE, empty false."""
    c = cell(x)
    shown = F.lower(c.value.cast("string"))
    value = F.when(c.value.isNull(), False).when(shown == "true", True).when(shown == "false", False).otherwise(shown.try_cast("double") != 0)
    return raised(value, (value.isNull(), VALUE), over=(c,))


def _pick(condition: Cell, yes: Cell, no: Cell) -> Cell:
    """Lazy: the error of the branch not taken does not count."""
    error = F.coalesce(condition.error, F.when(condition.value, yes.error).otherwise(no.error))
    return Cell(F.when(condition.value, yes.value).otherwise(no.value), error)


@function("IF")
def if_(condition, yes, no=False):
    return _pick(truth(condition), cell(yes), cell(no))


@function("IFS", low=2)
def ifs(*pairs):
    out = Cell(F.lit(None), F.lit(NA))
    for condition, value in reversed(list(zip(pairs[::2], pairs[1::2], strict=True))):
        out = _pick(truth(condition), cell(value), out)
    return out


@function("SWITCH", low=3)
def switch(x, *cases):
    c = cell(x)
    out = cell(cases[-1]) if len(cases) % 2 else Cell(F.lit(None), F.lit(NA))
    for key, value in reversed(list(zip(cases[::2], cases[1::2], strict=False))):
        out = _pick(Cell(F.coalesce(c.value == cell(key).value, F.lit(False))), cell(value), out)
    return raised(out.value, over=(c, out))


@function("CHOOSE", low=2)
def choose(k, *values):
    n = number(k)
    at, out = F.floor(n.value), Cell(F.lit(None), F.lit(VALUE))
    for i, v in enumerate(values, 1):
        out = _pick(Cell(at == i), cell(v), out)
    return raised(out.value, over=(n, out))


def _fold(name: str, join, stop: bool) -> None:
    @function(name)
    def build(*xs):
        cells = [truth(x) for x in xs]
        # In order: what settles the result comes before a later error.
        error = F.lit(None).cast("string")
        for c in reversed(cells):
            error = F.when(c.error.isNotNull(), c.error).when(c.value == stop, F.lit(None)).otherwise(error)
        return Cell(reduce(join, (F.coalesce(c.value, F.lit(not stop)) for c in cells)), error)


_fold("AND", lambda a, b: a & b, False)
_fold("OR", lambda a, b: a | b, True)


@function("XOR")
def xor(*xs):
    cells = [truth(x) for x in xs]
    return raised(sum((c.value.cast("int") for c in cells), F.lit(0)) % 2 == 1, over=tuple(cells))


@function("NOT")
def not_(x):
    c = truth(x)
    return raised(~c.value, over=(c,))


@function("TRUE", low=0, high=0)
def true():
    return Cell(F.lit(True))


@function("FALSE", low=0, high=0)
def false():
    return Cell(F.lit(False))


@function("IFERROR")
def iferror(x, other):
    c, o = cell(x), cell(other)
    return Cell(F.when(c.error.isNull(), c.value).otherwise(o.value), F.when(c.error.isNotNull(), o.error))


@function("IFNA")
def ifna(x, other):
    c, o = cell(x), cell(other)
    missing = c.error.eqNullSafe(NA)
    return Cell(F.when(missing, o.value).otherwise(c.value), F.when(missing, o.error).otherwise(c.error))


@function("NA", low=0, high=0)
def na():
    return Cell(F.lit(None).cast("double"), F.lit(NA))


def _test(name: str, value) -> None:
    @function(name, low=1, high=1)
    def build(x):
        return Cell(value(cell(x)))


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")
_is = lambda c, *kinds: c.error.isNull() & c.value.isNotNull() & F.typeof(c.value).isin(*kinds)
_test("ISBLANK", lambda c: c.error.isNull() & c.value.isNull())
_test("ISERROR", lambda c: c.error.isNotNull())
_test("ISERR", lambda c: c.error.isNotNull() & (c.error != NA))
_test("ISNA", lambda c: c.error.eqNullSafe(NA))
_test("ISNUMBER", lambda c: _is(c, *_NUMBERS) | (c.error.isNull() & c.value.isNotNull() & F.typeof(c.value).startswith("decimal")))
_test("ISTEXT", lambda c: _is(c, "string"))
_test("ISNONTEXT", lambda c: ~_is(c, "string"))
_test("ISLOGICAL", lambda c: _is(c, "boolean"))
_test("TYPE", lambda c: F.when(c.error.isNotNull(), 16).when(F.typeof(c.value).startswith("array"), 64).when(_is(c, "string"), 2).when(_is(c, "boolean"), 4).otherwise(1))


@function("ERROR.TYPE")
def error_type(x):
    c = cell(x)
    codes = F.create_map(*(F.lit(v) for pair in ERRORS.items() for v in pair))
    return Cell(F.try_element_at(codes, c.error).cast("double"), F.when(c.error.isNull(), F.lit(NA)))


@function("N")
def n(x):
    c = cell(x)
    return raised(F.when(F.typeof(c.value) == "string", 0.0).otherwise(F.coalesce(c.value.try_cast("string").try_cast("double"), c.value.try_cast("string").try_cast("boolean").cast("double"), F.lit(0.0))), over=(c,))


def _parity(name: str, rest: int) -> None:
    @function(name, low=1, high=1)
    def build(x):
        c = number(x)
        return raised(F.floor(F.abs(c.value)) % 2 == rest, over=(c,))


_parity("ISEVEN", 0)
_parity("ISODD", 1)
