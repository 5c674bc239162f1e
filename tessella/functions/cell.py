"""A spreadsheet value as two columns: what it is, and its error.

Functions of this package take and return cells.  Errors are data: the first error among the
arguments passes through, else a function may raise its own.  A plain column, column name
given as ``col("x")`` or Python value becomes a cell without error.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error values and their ERROR.TYPE codes; fixed values.
ERRORS = {"#NULL!": 1, "#DIV/0!": 2, "#VALUE!": 3, "#REF!": 4, "#NAME?": 5, "#NUM!": 6, "#N/A": 7, "#GETTING_DATA": 8, "#SPILL!": 9, "#CALC!": 14}
DIV0, VALUE, REF, NUM, NA, CALC = "#DIV/0!", "#VALUE!", "#REF!", "#NUM!", "#N/A", "#CALC!"


class Cell:
    """A value column and an error column (null where there is none)."""

    #: Whether a registered function made it, and both columns as one struct where it came as one.
    made, whole = False, None

    def __init__(self, value: Column, error: Column | None = None) -> None:
        self.error = F.lit(None).cast("string") if error is None else error
        self.plain = error is None
        self.value = value if error is None else F.when(error.isNull(), value)

    def struct(self) -> Column:
        return self.whole if self.whole is not None else F.struct(self.value.alias("value"), self.error.alias("error"))

    def alias(self, name: str) -> Column:
        """The value, named; null on error."""
        return self.value.alias(name)

    def shown(self) -> Column:
        """The value as text, or the error's code."""
        return F.coalesce(self.error, self.value.cast("string"))

    def __add__(self, other):
        return _arithmetic(self, other, lambda a, b: a + b)

    def __radd__(self, other):
        return _arithmetic(other, self, lambda a, b: a + b)

    def __sub__(self, other):
        return _arithmetic(self, other, lambda a, b: a - b)

    def __rsub__(self, other):
        return _arithmetic(other, self, lambda a, b: a - b)

    def __mul__(self, other):
        return _arithmetic(self, other, lambda a, b: a * b)

    def __rmul__(self, other):
        return _arithmetic(other, self, lambda a, b: a * b)

    def __truediv__(self, other):
        a, b = number(self), number(other)
        return raised(F.try_divide(a.value, b.value), (b.value == 0, DIV0), over=(a, b))

    def __rtruediv__(self, other):
        return cell(other) / self

    def __pow__(self, other):
        a, b = number(self), number(other)
        out = F.pow(a.value, b.value)
        return raised(out, ((a.value == 0) & (b.value < 0), DIV0), (F.isnan(out) | (F.abs(out) == float("inf")), NUM), over=(a, b))

    def __neg__(self):
        return 0 - self

    # Comparisons: numbers come before texts and texts before booleans; texts compare without case, and
    # an empty cell is 0, "" or FALSE, as the other side needs.

    def __eq__(self, other):
        return compare(self, other, lambda a, b: a == b)

    def __ne__(self, other):
        return compare(self, other, lambda a, b: a != b)

    def __lt__(self, other):
        return compare(self, other, lambda a, b: a < b)

    def __le__(self, other):
        return compare(self, other, lambda a, b: a <= b)

    def __gt__(self, other):
        return compare(self, other, lambda a, b: a > b)

    def __ge__(self, other):
        return compare(self, other, lambda a, b: a >= b)

    __hash__ = None

    def __and__(self, other):
        a, b = text(self), text(other)
        return raised(F.concat(a.value, b.value), over=(a, b))


def cell(x) -> Cell:
    if isinstance(x, Cell):
        return x
    return Cell(x if isinstance(x, Column) else F.lit(x))


def raised(value: Column, *rules: tuple[Column, str], over: tuple[Cell, ...] = ()) -> Cell:
    """``value`` unless an argument of ``over`` has an error or a rule (condition, error) holds; the first counts."""
    own = reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest), reversed(rules), F.lit(None).cast("string")) if rules else None
    errors = [c.error for c in over if not c.plain]
    if own is not None:
        errors.append(own)
    if not errors:
        return Cell(value)
    return Cell(value, F.coalesce(*errors) if len(errors) > 1 else errors[0])


#: Names of Spark's numeric types.
_NUMERIC = "^(tinyint|smallint|int|bigint|float|double|decimal.*)$"


def of_kind(value: Column, kinds: str) -> Column:
    """Whether a column's type is one of a pattern; the optimiser knows, so branches for other types cost nothing."""
    return F.typeof(value).rlike(kinds)


def compare(x, y, op: Callable) -> Cell:
    """``op`` of two cells by the order of kinds."""
    a, b = cell(x), cell(y)
    text_a, text_b, bool_a, bool_b = (of_kind(c.value, k) for k in ("^string", "^boolean$") for c in (a, b))
    none_a, none_b = a.value.isNull(), b.value.isNull()
    low = lambda c: F.coalesce(F.lower(c.value.try_cast("string")), F.lit(""))
    flag = lambda c, is_bool: F.coalesce(F.when(is_bool, c.value.try_cast("string") == "true"), F.lit(False)).cast("int")
    rank = lambda is_text, is_bool: F.when(is_bool, 2).when(is_text, 1).otherwise(0)
    rank_a, rank_b = rank(text_a, bool_a), rank(text_b, bool_b)
    # An empty cell takes the other's kind.
    rank_a, rank_b = F.when(none_a & ~none_b, rank_b).otherwise(rank_a), F.when(none_b & ~none_a, rank_a).otherwise(rank_b)
    numbers = op(number(Cell(a.value)).value, number(Cell(b.value)).value)
    same = F.when(none_a & none_b, op(F.lit(0), F.lit(0))).when(rank_a == 2, op(flag(a, bool_a), flag(b, bool_b))).when(rank_a == 1, op(low(a), low(b))).otherwise(numbers)
    return raised(F.when(rank_a != rank_b, op(rank_a, rank_b)).otherwise(same), over=(a, b))


def number(x) -> Cell:
    """As a number: empty is 0, a boolean 0 or 1, text what it reads as or ``#VALUE!``."""
    c = cell(x)
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return Cell(F.lit(float(x)))
    known = of_kind(c.value, _NUMERIC)
    trimmed = F.trim(c.value.cast("string"))
    read = F.when(F.lower(trimmed) == "true", 1.0).when(F.lower(trimmed) == "false", 0.0).when(trimmed == "", 0.0).otherwise(F.try_cast(trimmed, "double") if hasattr(F, "try_cast") else trimmed.try_cast("double"))
    value = F.when(c.value.isNull(), 0.0).when(known, c.value.try_cast("double")).otherwise(F.coalesce(c.value.try_cast("double"), read))
    return raised(value, (~known & c.value.isNotNull() & value.isNull(), VALUE), over=(c,))


def numeric(x) -> Cell:
    """A column that is known to hold numbers: only empty becomes 0."""
    c = cell(x)
    return raised(F.coalesce(c.value.cast("double"), F.lit(0.0)), over=(c,))


def number_text(value: Column) -> Column:
    """A number as text with 15 significant digits, whole numbers without a point."""
    whole = value.cast("decimal(38,0)").cast("string")
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), whole).otherwise(F.regexp_replace(F.format_string("%.15g", value), r"(\.\d*?)0+$|\.0*$", "$1"))


def text(x) -> Cell:
    """As text: empty is "", a boolean TRUE or FALSE."""
    c = cell(x)
    return raised(F.coalesce(c.value.cast("string"), F.lit("")), over=(c,))


def _arithmetic(a, b, op: Callable) -> Cell:
    a, b = numeric(a) if isinstance(a, Cell) else number(a), numeric(b) if isinstance(b, Cell) else number(b)
    return raised(op(a.value, b.value), over=(a, b))


class Function:
    """A registered function: its name, how many arguments it takes, and what builds its cell."""

    def __init__(self, name: str, build: Callable[..., Cell], low: int, high: int) -> None:
        self.name, self.build, self.low, self.high = name, build, low, high

    def __call__(self, *args) -> Cell:
        if not self.low <= len(args) <= self.high:
            return Cell(F.lit(None).cast("double"), F.lit(VALUE))
        out = _bound(self.build, args) if any(isinstance(a, Cell) and a.made for a in args) else self.build(*args)
        out.made = True
        return out


class Unbound(Exception):
    """Raised by what cannot be built inside a lambda function of columns."""


#: Whether a function is being built inside a lambda function.
inside = [False]


def _bound(build: Callable[..., Cell], args: tuple) -> Cell:
    """A function of other functions' results, each named once, so that expressions grow with the formula's length."""
    at = [i for i, a in enumerate(args) if isinstance(a, Cell) and a.made]

    def body(s: Column) -> Column:
        named = list(args)
        for i in at:
            named[i] = _known(s[f"c{i}"]["value"], s[f"c{i}"]["error"])
        return build(*named).struct()

    before, inside[0] = inside[0], True
    try:
        found = F.get(F.transform(F.array(F.struct(*(args[i].struct().alias(f"c{i}") for i in at))), body), F.lit(0))
    except Unbound:
        found = None
    finally:
        inside[0] = before
    if found is None:
        return build(*args)
    out = _known(found["value"], found["error"])
    out.whole = found
    return out


def let(body: Callable[..., Column], *columns: Column) -> Column:
    """``body`` of columns that stand in the expression once, however often it uses them."""
    names = [f"v{i}" for i in range(len(columns))]
    named = F.array(F.struct(*(c.alias(n) for c, n in zip(columns, names, strict=True))))
    return F.get(F.transform(named, lambda s: body(*(s[n] for n in names))), F.lit(0))


def _known(value: Column, error: Column) -> Cell:
    """A cell whose value is null on error already."""
    out = Cell(value)
    out.error, out.plain = error, False
    return out


FUNCTIONS: dict[str, Function] = {}


def function(*names: str, low: int | None = None, high: int | None = None):
    """Register a builder under spreadsheet names; the number of arguments follows its signature unless given."""

    def add(build: Callable[..., Cell]) -> Callable[..., Cell]:
        parameters = inspect.signature(build).parameters.values()
        fixed = [p for p in parameters if p.kind is p.POSITIONAL_OR_KEYWORD]
        least = sum(p.default is p.empty for p in fixed) if low is None else low
        most = (255 if any(p.kind is p.VAR_POSITIONAL for p in parameters) else len(fixed)) if high is None else high
        for n in names:
            FUNCTIONS[n.upper()] = Function(n.upper(), build, least, most)
        return build

    return add


def call(name: str, *args) -> Cell:
    """The function of that name applied, whatever the case; an unknown name gives ``#NAME?``."""
    found = FUNCTIONS.get(name.upper())
    return found(*args) if found else Cell(F.lit(None).cast("double"), F.lit("#NAME?"))
