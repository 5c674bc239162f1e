"""Text functions: code points, case-insensitive search without wildcards, JavaScript-free regex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.cell import NA, VALUE, Cell, cell, function, number, raised, text


def _cut(s: Column, start: Column, n: Column) -> Column:
    return F.substring(s, start.cast("int"), F.greatest(n, F.lit(0)).cast("int"))


@function("LEFT", "LEFTB")
def left(s, n=1):
    t, k = text(s), number(n)
    return raised(_cut(t.value, F.lit(1), F.floor(k.value)), (k.value < 0, VALUE), over=(t, k))


@function("RIGHT", "RIGHTB")
def right(s, n=1):
    t, k = text(s), number(n)
    size = F.least(F.floor(k.value), F.length(t.value))
    return raised(F.when(size == 0, "").otherwise(_cut(t.value, F.length(t.value) - size + 1, size)), (k.value < 0, VALUE), over=(t, k))


@function("MID", "MIDB")
def mid(s, start, n):
    t, a, k = text(s), number(start), number(n)
    return raised(_cut(t.value, F.floor(a.value), F.floor(k.value)), ((a.value < 1) | (k.value < 0), VALUE), over=(t, a, k))


@function("LEN", "LENB")
def length(s):
    t = text(s)
    return raised(F.length(t.value).cast("double"), over=(t,))


def _one(*names: str, value) -> None:
    @function(*names, low=1, high=1)
    def build(s):
        t = text(s)
        return raised(value(t.value), over=(t,))


_one("UPPER", value=F.upper)
_one("LOWER", value=F.lower)
_one("TRIM", value=lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
_one("CLEAN", value=lambda s: F.regexp_replace(s, r"[\x00-\x1F]", ""))
_one("ENCODEURL", value=lambda s: F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")))


@function("PROPER")
def proper(s):
    t = text(s)
    letters = F.split(F.lower(t.value), "")
    out = F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~F.get(letters, i - 1).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")
    return raised(out, over=(t,))


@function("EXACT")
def exact(a, b):
    x, y = text(a), text(b)
    return raised(x.value == y.value, over=(x, y))


def _search(fold) -> object:
    def build(part, s, start=1):
        p, t, k = text(part), text(s), number(start)
        a, b = fold(p.value), fold(t.value)
        at = F.instr(F.substring(b, k.value.cast("int"), F.length(b)), a) + k.value.cast("int") - 1
        return raised(at.cast("double"), ((k.value < 1) | (F.instr(F.substring(b, k.value.cast("int"), F.length(b)), a) == 0), VALUE), over=(p, t, k))

    return build


function("FIND", "FINDB", low=2, high=3)(_search(lambda x: x))
function("SEARCH", "SEARCHB", low=2, high=3)(_search(F.lower))


@function("CONCATENATE", "CONCAT")
def concat(*parts):
    cells = [text(p) for p in parts]
    return raised(F.concat(*(c.value for c in cells)), over=tuple(cells))


@function("TEXTJOIN", low=3)
def textjoin(delimiter, ignore_empty, *parts):
    d, cells = text(delimiter), [text(p) for p in parts]
    flag = cell(ignore_empty).value
    some = F.array(*(c.value for c in cells))
    return raised(F.array_join(F.when(flag, F.filter(some, lambda x: x != "")).otherwise(some), d.value) if isinstance(delimiter, Cell) else F.concat_ws(delimiter, F.when(flag, F.filter(some, lambda x: x != "")).otherwise(some)), over=(d, *cells))


def _pieces(t: Column, d: Column, fold: bool) -> Column:
    """Where each delimiter begins, 1-based, left to right."""
    a, b = (F.lower(t), F.lower(d)) if fold else (t, d)
    return F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.length(b)) == b)


def _around(after: bool):
    def build(s, delimiter, instance=1, match_mode=0, match_end=0, if_not_found=None):
        t, d, k = text(s), text(delimiter), number(instance)
        found = _pieces(t.value, d.value, bool(match_mode))
        at = F.try_element_at(found, k.value.cast("int"))
        size = F.length(t.value)
        out = F.substring(t.value, (at + F.length(d.value)).cast("int"), size) if after else F.substring(t.value, F.lit(1), (at - 1).cast("int"))
        if match_end:
            out = F.when(at.isNotNull(), out).otherwise(F.lit("") if after else t.value)
            miss = F.lit(False)
        else:
            miss = at.isNull()
        if if_not_found is not None:
            alt = text(if_not_found)
            return raised(F.when(miss, alt.value).otherwise(out), (k.value == 0, VALUE), over=(t, d, k, alt))
        return raised(out, (k.value == 0, VALUE), (miss, NA), over=(t, d, k))

    return build


function("TEXTBEFORE", low=2, high=6)(_around(False))
function("TEXTAFTER", low=2, high=6)(_around(True))


@function("TEXTSPLIT")
def textsplit(s, delimiter, ignore_empty=False):
    """One row of pieces, as an array; explode it for a column."""
    t, d = text(s), text(delimiter)
    parts = F.split(t.value, F.concat(F.lit(r"\Q"), d.value, F.lit(r"\E")))
    return raised(F.filter(parts, lambda x: x != "") if ignore_empty else parts, (d.value == "", VALUE), over=(t, d))


@function("SUBSTITUTE")
def substitute(s, old, new, instance=None):
    t, a, b = text(s), text(old), text(new)
    if instance is None:
        return raised(F.when(a.value == "", t.value).otherwise(F.replace(t.value, a.value, b.value)), over=(t, a, b))
    k = number(instance)
    at = F.get(_pieces(t.value, a.value, False), (k.value - 1).cast("int"))
    out = F.concat(F.substring(t.value, F.lit(1), (at - 1).cast("int")), b.value, F.substring(t.value, (at + F.length(a.value)).cast("int"), F.length(t.value)))
    return raised(F.coalesce(out, t.value), (k.value < 1, VALUE), over=(t, a, b, k))


@function("REPLACE", "REPLACEB")
def replace(s, start, n, new):
    t, a, k, b = text(s), number(start), number(n), text(new)
    at = F.floor(a.value).cast("int")
    out = F.concat(F.substring(t.value, F.lit(1), at - 1), b.value, F.substring(t.value, (at + F.floor(k.value)).cast("int"), F.length(t.value)))
    return raised(out, ((a.value < 1) | (k.value < 0), VALUE), over=(t, a, k, b))


@function("REPT")
def rept(s, n):
    t, k = text(s), number(n)
    return raised(F.repeat(t.value, F.floor(k.value).cast("int")), (k.value < 0, VALUE), over=(t, k))


@function("VALUE")
def value(s):
    t = text(s)
    plain = F.regexp_replace(F.trim(t.value), r"[$€£¥,\s]", "")
    percent = plain.endswith("%")
    n = F.regexp_replace(plain, "%$", "").try_cast("double")
    out = F.when(plain == "", 0.0).when(percent, n / 100).otherwise(n)
    return raised(out, ((plain != "") & n.isNull(), VALUE), over=(t,))


@function("NUMBERVALUE")
def numbervalue(s, point=".", group=","):
    t, p, g = text(s), text(point), text(group)
    plain = F.replace(F.replace(F.regexp_replace(t.value, r"\s", ""), g.value, F.lit("")), p.value, F.lit("."))
    percents = F.length(plain) - F.length(F.regexp_replace(plain, "%+$", ""))
    n = F.regexp_replace(plain, "%+$", "").try_cast("double")
    return raised(F.when(plain == "", 0.0).otherwise(n / F.pow(F.lit(100.0), percents)), ((plain != "") & n.isNull(), VALUE), over=(t, p, g))


@function("UNICODE", "CODE")
def unicode(s):
    t = text(s)
    return raised(F.ascii(t.value).cast("double"), (t.value == "", VALUE), over=(t,))


@function("UNICHAR", "CHAR")
def unichar(n):
    """From the code point's UTF-8 bytes."""
    k = number(n)
    c = F.floor(k.value).cast("int")
    low = lambda shift: F.shiftright(c, shift).bitwiseAND(63) + 128
    byte = lambda x: F.lpad(F.hex(x.cast("int")), 2, "0")
    coded = (
        F.when(c < 128, byte(c)).when(c < 2048, F.concat(byte(F.shiftright(c, 6) + 192), byte(low(0)))).when(c < 65536, F.concat(byte(F.shiftright(c, 12) + 224), byte(low(6)), byte(low(0)))).otherwise(F.concat(byte(F.shiftright(c, 18) + 240), byte(low(12)), byte(low(6)), byte(low(0))))
    )
    bad = (c < 1) | (c > 0x10FFFF) | c.between(0xD800, 0xDFFF)
    return raised(F.decode(F.unhex(F.when(~bad, coded)), "UTF-8"), (bad, VALUE), over=(k,))


@function("T")
def t_(x):
    """``x`` if its column is text, else ""; the kind of a column is static."""
    c = cell(x)
    return raised(F.when(F.typeof(c.value) == "string", c.value.cast("string")).otherwise(""), over=(c,))


@function("FIXED")
def fixed(x, decimals=2, no_commas=False):
    n = number(x)
    out = F.format_number(F.round(n.value, int(decimals)), max(0, int(decimals)))
    return raised(F.replace(out, F.lit(","), F.lit("")) if no_commas else out, over=(n,))


@function("DOLLAR")
def dollar(x, decimals=2):
    n = number(x)
    shown = F.concat(F.lit("$"), F.format_number(F.abs(F.round(n.value, int(decimals))), max(0, int(decimals))))
    return raised(F.when(n.value < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown), over=(n,))


@function("ARRAYTOTEXT")
def arraytotext(array, strict=0):
    c = cell(array)
    return raised(F.concat(F.lit("{"), F.array_join(c.value, ","), F.lit("}")) if strict else F.array_join(c.value, ", "), over=(c,))


@function("VALUETOTEXT")
def valuetotext(x, strict=0):
    c = cell(x)
    shown = F.coalesce(c.value.cast("string"), F.lit(""))
    return raised(F.when(F.typeof(c.value) == "string", F.concat(F.lit('"'), shown, F.lit('"'))).otherwise(shown) if strict else shown, over=(c,))


@function("HYPERLINK")
def hyperlink(url, shown=None):
    return text(url if shown is None else shown)


@function("PHONETIC")
def phonetic(x):
    return Cell(F.lit(None).cast("string"), F.lit(NA))


@function("ASC")
def asc(s):
    """Full-width forms to ASCII."""
    t = text(s)
    wide = "".join(chr(c + 0xFEE0) for c in range(33, 127)) + "　"
    return raised(F.translate(t.value, wide, "".join(map(chr, range(33, 127))) + " "), over=(t,))


@function("REGEXTEST")
def regextest(s, pattern):
    t, p = text(s), text(pattern)
    return raised(F.regexp_like(t.value, p.value), over=(t, p))


@function("REGEXEXTRACT")
def regexextract(s, pattern, mode=0):
    """The first match, or with mode 1 an array of all."""
    t, p = text(s), text(pattern)
    found = F.regexp_extract_all(t.value, p.value, F.lit(0))
    return raised(found if mode else F.get(found, 0), (F.size(found) == 0, NA), over=(t, p))


@function("REGEXREPLACE")
def regexreplace(s, pattern, new):
    t, p, n = text(s), text(pattern), text(new)
    return raised(F.regexp_replace(t.value, p.value, n.value), over=(t, p, n))


@function("TEXT")
def text_(x, code: str):
    """The common number and date codes, given as a Python string: 0, #, comma, percent, and y, m, d, h, s."""
    c = cell(x)
    if any(k in code.lower() for k in ("y", "d", "h")) or "mm" in code.lower():
        from tessella.functions.date import moment

        java = code.replace("YYYY", "yyyy").replace("dddd", "EEEE").replace("ddd", "EEE").replace("mmmm", "MMMM").replace("mmm", "MMM")
        parts, hour = "", False
        for i, ch in enumerate(java):
            parts += "M" if ch == "m" and not hour else ch
            if ch in "hHs":
                hour = True
            elif ch in "yd-/ ,":
                hour = hour and ch == " " and i > 0
        return raised(F.date_format(moment(c.value), parts.replace("hh", "HH")), over=(c,))
    n = number(c)
    decimals = len(code.split(".")[1].rstrip("%").rstrip(")")) if "." in code else 0
    scaled = n.value * 100 if "%" in code else n.value
    out = F.format_number(scaled, decimals)
    if "," not in code:
        out = F.replace(out, F.lit(","), F.lit(""))
    whole = len(code.split(".")[0].replace(",", "").replace("#", "").rstrip("%"))
    if whole > 1:
        out = F.when(F.length(out) < whole + (decimals + 1 if decimals else 0), F.lpad(out, whole + (decimals + 1 if decimals else 0), "0")).otherwise(out)
    return raised(F.concat(out, F.lit("%")) if "%" in code else out, over=(n,))


def _letters(n: Column) -> Column:
    """Letters of a column number up to 18,278."""
    sign = lambda k: F.char(F.lit(65) + F.pmod(k - 1, F.lit(26)))
    second, third = F.floor((n - 1) / 26), F.floor((F.floor((n - 1) / 26) - 1) / 26)
    return F.concat(F.when(third > 0, sign(third)).otherwise(""), F.when(second > 0, sign(second)).otherwise(""), sign(n))


@function("ADDRESS", low=2, high=5)
def address(row, column, kind: int = 1, a1: bool = True, sheet: str | None = None):
    """``kind`` 1 is absolute, 2 of the row, 3 of the column, 4 of neither."""
    r, k = number(row), number(column)
    row_, column_ = F.floor(r.value).cast("long"), F.floor(k.value).cast("long")
    if a1:
        out = F.concat(F.lit("$" if kind in (1, 3) else ""), _letters(column_), F.lit("$" if kind in (1, 2) else ""), row_.cast("string"))
    else:
        own = lambda name, x, fixed: F.concat(F.lit(name if fixed else f"{name}["), x.cast("string"), F.lit("" if fixed else "]"))
        out = F.concat(own("R", row_, kind in (1, 2)), own("C", column_, kind in (1, 3)))
    named = out if sheet is None else F.concat(F.lit(sheet + "!"), out)
    return raised(named, ((row_ < 1) | (column_ < 1) | F.lit(kind not in (1, 2, 3, 4)), VALUE), over=(r, k))
