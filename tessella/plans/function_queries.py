"""Registered queries over scalar functions: a column for each function, beside the SQL that says the same."""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import functions as F

from tessella.functions.cell import Cell, call, cell
from tessella.plans.registry import ORACLE_SQL, QUERIES, table

PI = repr(math.pi)


def _columns() -> SimpleNamespace:
    """The columns that functions are applied to."""
    v = SimpleNamespace(Z=F.col("p_size"), P=F.col("p_retailprice"), K=F.col("p_partkey"), N=F.col("p_name"), B=F.col("p_brand"), T=F.col("ts"), O=F.to_date("o_orderdate"))
    v.X, v.W, v.Q = v.Z / 51, (v.Z - 25) / 12, v.Z % 8
    v.A, v.I_ = v.Z / 25, (v.K % 7 + 1) / 5
    # A coupon date, its bond's maturity, a bill's maturity, and a yield.
    v.S = F.make_date(F.year(v.O), F.month(v.O), F.lit(15))
    v.M, v.H, v.Y = F.add_months(v.S, 60), F.date_add(v.S, 90), (F.col("o_custkey") % 9) / 100
    return v


def scalars(name: str, source: str, key: str, *columns: tuple[str, object, str, int | None]) -> None:
    """Register a query of ``columns``: (name, function of ``_columns()`` that gives a cell, SQL, decimals or None for what is no number)."""

    def run(spark, d):
        def shown(made: Cell, digits: int | None):
            return made.value if digits is None else F.round(made.value.cast("double"), digits) + F.lit(0.0)

        v = _columns()
        return table(spark, d, source).select(key, *(shown(cell(f(v)), digits).alias(n) for n, f, _, digits in columns))

    sql = ", ".join(f"{s} {n}" if digits is None else f"round(({s})::DOUBLE, {digits}) + 0.0::DOUBLE {n}" for n, _, s, digits in columns)
    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {key}, {sql} FROM {source}"


x_ = "(p_size / 51)"

scalars(
    "trigonometric_functions", "part", "p_partkey",
    ("cos_", lambda v: call("COS", v.Z), "cos(p_size)", 9), ("tan_", lambda v: call("TAN", v.X), f"tan{x_}", 9), ("asin_", lambda v: call("ASIN", v.X), f"asin{x_}", 9), ("acos_", lambda v: call("ACOS", v.X), f"acos{x_}", 9),
    ("atan_", lambda v: call("ATAN", v.Z), "atan(p_size)", 9), ("sinh_", lambda v: call("SINH", v.X), f"(exp{x_} - exp(-{x_})) / 2", 9), ("cosh_", lambda v: call("COSH", v.X), f"(exp{x_} + exp(-{x_})) / 2", 9), ("asinh_", lambda v: call("ASINH", v.Z), "ln(p_size + sqrt(p_size * p_size + 1))", 9),
    ("acosh_", lambda v: call("ACOSH", v.Z), "ln(p_size + sqrt(p_size * p_size - 1))", 9), ("atanh_", lambda v: call("ATANH", v.X), f"0.5 * ln((1 + {x_}) / (1 - {x_}))", 9), ("coth_", lambda v: call("COTH", v.X), f"(exp(2 * {x_}) + 1) / (exp(2 * {x_}) - 1)", 6),
    ("sec_", lambda v: call("SEC", v.X), f"1 / cos{x_}", 9), ("csc_", lambda v: call("CSC", v.X), f"1 / sin{x_}", 9), ("sech_", lambda v: call("SECH", v.X), f"2 / (exp{x_} + exp(-{x_}))", 9), ("csch_", lambda v: call("CSCH", v.X), f"2 / (exp{x_} - exp(-{x_}))", 6),
    ("acot_", lambda v: call("ACOT", v.Z), f"{PI} / 2 - atan(p_size)", 9), ("acoth_", lambda v: call("ACOTH", v.Z + 1), "0.5 * ln((p_size + 2) / p_size)", 9), ("radians_", lambda v: call("RADIANS", v.Z), f"p_size * {PI} / 180", 9), ("pi_", lambda v: call("PI"), PI, 9),
)

scalars(
    "power_and_counting_functions", "part", "p_partkey",
    ("abs_", lambda v: call("ABS", 25 - v.Z), "abs(25 - p_size)", 6), ("exp_", lambda v: call("EXP", v.X), f"exp{x_}", 9), ("log_", lambda v: call("LOG", v.P, 3), "ln(p_retailprice) / ln(3)", 9), ("power_", lambda v: call("POWER", v.P, 0.5), "sqrt(p_retailprice)", 8), ("sqrtpi_", lambda v: call("SQRTPI", v.Z), f"sqrt(p_size * {PI})", 9),
    ("trunc_", lambda v: call("TRUNC", v.P / 7, 1), "trunc(p_retailprice / 7 * 10) / 10", 6), ("ceiling_math", lambda v: call("CEILING.MATH", -v.P, 7), "ceil(-p_retailprice / 7) * 7", 6), ("floor_math", lambda v: call("FLOOR.MATH", -v.P, 7), "floor(-p_retailprice / 7) * 7", 6), ("ceiling_precise", lambda v: call("CEILING.PRECISE", v.P, 7), "ceil(p_retailprice / 7) * 7", 6),
    ("floor_precise", lambda v: call("FLOOR.PRECISE", v.P, 7), "floor(p_retailprice / 7) * 7", 6), ("iso_ceiling", lambda v: call("ISO.CEILING", v.P, 9), "ceil(p_retailprice / 9) * 9", 6), ("ecma_ceiling", lambda v: call("ECMA.CEILING", v.P, 9), "ceil(p_retailprice / 9) * 9", 6),
    ("combin_", lambda v: call("COMBIN", v.Z + 2, 2), "(p_size + 2) * (p_size + 1) / 2", 3), ("combina_", lambda v: call("COMBINA", v.Z, 2), "p_size * (p_size + 1) / 2", 3), ("permut_", lambda v: call("PERMUT", v.Z + 2, 2), "(p_size + 2) * (p_size + 1)", 3), ("permutationa_", lambda v: call("PERMUTATIONA", v.Z, 3), "p_size * p_size * p_size", 3),
    ("factdouble_", lambda v: call("FACTDOUBLE", v.Z % 9), "CASE p_size % 9 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 8 WHEN 5 THEN 15 WHEN 6 THEN 48 WHEN 7 THEN 105 ELSE 384 END", 3), ("lcm_", lambda v: call("LCM", v.Z, 12), "lcm(p_size, 12)", 3), ("multinomial_", lambda v: call("MULTINOMIAL", v.Z % 5, 2), "(p_size % 5 + 2) * (p_size % 5 + 1) / 2", 3),
    ("seriessum_", lambda v: call("SERIESSUM", v.X, 0, 2, 1, 3, 5), f"1 + 3 * pow({x_}, 2) + 5 * pow({x_}, 4)", 9), ("sign_", lambda v: call("SIGN", 25 - v.Z), "sign(25 - p_size)", 3), ("odd_", lambda v: call("ODD", v.Z), "p_size + 1 - p_size % 2", 3), ("iseven_", lambda v: call("ISEVEN", v.Z), "p_size % 2 = 0", None), ("isodd_", lambda v: call("ISODD", v.Z), "p_size % 2 = 1", None),
)

_ROMAN = "concat(['', 'X', 'XX', 'XXX', 'XL', 'L'][p_size // 10 + 1], ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][p_size % 10 + 1])"
scalars(
    "number_system_functions", "part", "p_partkey",
    ("roman_", lambda v: call("ROMAN", v.Z), _ROMAN, None), ("arabic_", lambda v: call("ARABIC", call("ROMAN", v.Z)), "p_size", 3), ("base_", lambda v: call("BASE", v.Z, 7, 4), "lpad(concat(CASE WHEN p_size >= 49 THEN (p_size // 49)::VARCHAR ELSE '' END, CASE WHEN p_size >= 7 THEN (p_size // 7 % 7)::VARCHAR ELSE '' END, (p_size % 7)::VARCHAR), 4, '0')", None), ("decimal_", lambda v: call("DECIMAL", call("BASE", v.K, 7), 7), "p_partkey", 3),
    ("dec2oct", lambda v: call("DEC2OCT", v.Z), "concat(CASE WHEN p_size >= 8 THEN (p_size // 8)::VARCHAR ELSE '' END, (p_size % 8)::VARCHAR)", None), ("bin2dec", lambda v: call("BIN2DEC", call("DEC2BIN", v.Z)), "p_size", 3), ("bin2hex", lambda v: call("BIN2HEX", call("DEC2BIN", v.Z)), "upper(to_hex(p_size))", None), ("bin2oct", lambda v: call("BIN2OCT", call("DEC2BIN", v.Z)), "concat(CASE WHEN p_size >= 8 THEN (p_size // 8)::VARCHAR ELSE '' END, (p_size % 8)::VARCHAR)", None),
    ("hex2dec", lambda v: call("HEX2DEC", call("DEC2HEX", v.K)), "p_partkey", 3), ("hex2bin", lambda v: call("HEX2BIN", call("DEC2HEX", v.Z)), "bin(p_size)", None), ("hex2oct", lambda v: call("HEX2OCT", call("DEC2HEX", v.Z)), "concat(CASE WHEN p_size >= 8 THEN (p_size // 8)::VARCHAR ELSE '' END, (p_size % 8)::VARCHAR)", None),
    ("oct2dec", lambda v: call("OCT2DEC", call("DEC2OCT", v.K)), "p_partkey", 3), ("oct2bin", lambda v: call("OCT2BIN", call("DEC2OCT", v.Z)), "bin(p_size)", None), ("oct2hex", lambda v: call("OCT2HEX", call("DEC2OCT", v.Z)), "upper(to_hex(p_size))", None),
    ("bitor_", lambda v: call("BITOR", v.Z, 6), "p_size | 6", 3), ("bitrshift_", lambda v: call("BITRSHIFT", v.Z, 2), "p_size >> 2", 3), ("delta_", lambda v: call("DELTA", v.Z, 7), "CASE WHEN p_size = 7 THEN 1 ELSE 0 END", 3), ("gestep_", lambda v: call("GESTEP", v.Z, 7), "CASE WHEN p_size >= 7 THEN 1 ELSE 0 END", 3),
)

# Complex numbers a + bi.
a_, b_ = "(p_size / 25)", "((p_partkey % 7 + 1) / 5)"
COMPLEX = lambda v: call("COMPLEX", v.A, v.I_)
r_, t_ = f"sqrt({a_} * {a_} + {b_} * {b_})", f"atan2({b_}, {a_})"
sh, ch = lambda v: f"((exp{v} - exp(-{v})) / 2)", lambda v: f"((exp{v} + exp(-{v})) / 2)"
sin_re, sin_im = f"(sin{a_} * {ch(b_)})", f"(cos{a_} * {sh(b_)})"
cos_re, cos_im = f"(cos{a_} * {ch(b_)})", f"(-sin{a_} * {sh(b_)})"
sinh_re, sinh_im = f"({sh(a_)} * cos{b_})", f"({ch(a_)} * sin{b_})"
cosh_re, cosh_im = f"({ch(a_)} * cos{b_})", f"({sh(a_)} * sin{b_})"
inverse = lambda re, im: (f"({re}) / (({re}) * ({re}) + ({im}) * ({im}))", f"-({im}) / (({re}) * ({re}) + ({im}) * ({im}))")
ratio = lambda a, b, p, q: (f"(({a}) * ({p}) + ({b}) * ({q})) / (({p}) * ({p}) + ({q}) * ({q}))", f"(({b}) * ({p}) - ({a}) * ({q})) / (({p}) * ({p}) + ({q}) * ({q}))")


def _both(name: str, made, sql: tuple[str, str]) -> list:
    return [(f"{name}_re", lambda v: call("IMREAL", made(v)), sql[0], 7), (f"{name}_im", lambda v: call("IMAGINARY", made(v)), sql[1], 7)]


scalars(
    "complex_functions", "part", "p_partkey",
    ("imabs_", lambda v: call("IMABS", COMPLEX(v)), r_, 9), ("imargument_", lambda v: call("IMARGUMENT", COMPLEX(v)), t_, 9), *_both("conjugate", lambda v: call("IMCONJUGATE", COMPLEX(v)), (a_, f"-{b_}")), *_both("exp", lambda v: call("IMEXP", COMPLEX(v)), (f"exp{a_} * cos{b_}", f"exp{a_} * sin{b_}")),
    *_both("ln", lambda v: call("IMLN", COMPLEX(v)), (f"ln({r_})", t_)), *_both("log10", lambda v: call("IMLOG10", COMPLEX(v)), (f"ln({r_}) / ln(10)", f"{t_} / ln(10)")), *_both("log2", lambda v: call("IMLOG2", COMPLEX(v)), (f"ln({r_}) / ln(2)", f"{t_} / ln(2)")), *_both("power", lambda v: call("IMPOWER", COMPLEX(v), 2), (f"{a_} * {a_} - {b_} * {b_}", f"2 * {a_} * {b_}")),
    *_both("sqrt", lambda v: call("IMSQRT", COMPLEX(v)), (f"sqrt({r_}) * cos({t_} / 2)", f"sqrt({r_}) * sin({t_} / 2)")), *_both("product", lambda v: call("IMPRODUCT", COMPLEX(v), "2+3i"), (f"2 * {a_} - 3 * {b_}", f"3 * {a_} + 2 * {b_}")), *_both("div", lambda v: call("IMDIV", COMPLEX(v), "2+3i"), (f"(2 * {a_} + 3 * {b_}) / 13", f"(2 * {b_} - 3 * {a_}) / 13")),
    *_both("sum", lambda v: call("IMSUM", COMPLEX(v), "2+3i"), (f"{a_} + 2", f"{b_} + 3")), *_both("sub", lambda v: call("IMSUB", COMPLEX(v), "2+3i"), (f"{a_} - 2", f"{b_} - 3")),
)

scalars(
    "complex_trigonometric_functions", "part", "p_partkey",
    *_both("sin", lambda v: call("IMSIN", COMPLEX(v)), (sin_re, sin_im)), *_both("cos", lambda v: call("IMCOS", COMPLEX(v)), (cos_re, cos_im)), *_both("sinh", lambda v: call("IMSINH", COMPLEX(v)), (sinh_re, sinh_im)), *_both("cosh", lambda v: call("IMCOSH", COMPLEX(v)), (cosh_re, cosh_im)),
    *_both("tan", lambda v: call("IMTAN", COMPLEX(v)), ratio(sin_re, sin_im, cos_re, cos_im)), *_both("cot", lambda v: call("IMCOT", COMPLEX(v)), ratio(cos_re, cos_im, sin_re, sin_im)), *_both("sec", lambda v: call("IMSEC", COMPLEX(v)), inverse(cos_re, cos_im)), *_both("csc", lambda v: call("IMCSC", COMPLEX(v)), inverse(sin_re, sin_im)),
    *_both("sech", lambda v: call("IMSECH", COMPLEX(v)), inverse(cosh_re, cosh_im)), *_both("csch", lambda v: call("IMCSCH", COMPLEX(v)), inverse(sinh_re, sinh_im)),
)

scalars(
    "text_case_functions", "part", "p_partkey",
    ("lower_", lambda v: call("LOWER", v.B), "lower(p_brand)", None), ("trim_", lambda v: call("TRIM", F.concat(F.lit("  "), v.N, F.lit("   "), v.B)), "concat(p_name, ' ', p_brand)", None), ("clean_", lambda v: call("CLEAN", F.concat(v.N, F.lit("\x07"), v.B)), "concat(p_name, p_brand)", None), ("proper_", lambda v: call("PROPER", v.N), "array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')", None),
    ("char_", lambda v: call("CHAR", v.Z + 64), "chr(p_size + 64)", None), ("unichar_", lambda v: call("UNICHAR", v.Z + 944), "chr(p_size + 944)", None), ("code_", lambda v: call("CODE", v.N), "ascii(p_name)", 3), ("unicode_", lambda v: call("UNICODE", v.N), "unicode(p_name)", 3), ("concatenate_", lambda v: call("CONCATENATE", v.N, "-", v.Z), "concat(p_name, '-', p_size)", None), ("textjoin_", lambda v: call("TEXTJOIN", "/", True, v.N, "", v.B), "concat(p_name, '/', p_brand)", None),
    ("textbefore_", lambda v: call("TEXTBEFORE", v.N, " "), "string_split(p_name, ' ')[1]", None), ("textafter_", lambda v: call("TEXTAFTER", v.B, "#"), "string_split(p_brand, '#')[2]", None), ("search_", lambda v: call("SEARCH", "#", v.B), "instr(p_brand, '#')", 3), ("findb_", lambda v: call("FINDB", "#", v.B), "instr(p_brand, '#')", 3), ("searchb_", lambda v: call("SEARCHB", "RAND", v.B), "2", 3),
    ("leftb_", lambda v: call("LEFTB", v.N, 2), "left(p_name, 2)", None), ("rightb_", lambda v: call("RIGHTB", v.N, 2), "right(p_name, 2)", None), ("midb_", lambda v: call("MIDB", v.N, 2, 2), "substr(p_name, 2, 2)", None), ("lenb_", lambda v: call("LENB", v.N), "length(p_name)", 3), ("replaceb_", lambda v: call("REPLACEB", v.N, 1, 1, "_"), "concat('_', substr(p_name, 2))", None), ("t_", lambda v: call("T", v.N), "p_name", None), ("asc_", lambda v: call("ASC", v.B), "p_brand", None), 
    ("regexextract_", lambda v: call("REGEXEXTRACT", v.B, "[0-9]+"), "regexp_extract(p_brand, '[0-9]+')", None), ("encodeurl_", lambda v: call("ENCODEURL", v.B), "url_encode(p_brand)", None), ("hyperlink_", lambda v: call("HYPERLINK", v.N, v.B), "p_brand", None), ("textsplit_", lambda v: Cell(F.array_join(call("TEXTSPLIT", v.N, " ").value, "|")), "replace(p_name, ' ', '|')", None),
)

scalars(
    "text_number_functions", "part", "p_partkey",
    ("value_", lambda v: call("VALUE", F.concat(F.lit("$"), v.Z.cast("string"))), "p_size", 3), ("numbervalue_", lambda v: call("NUMBERVALUE", F.concat(v.Z.cast("string"), F.lit(",5")), ",", "."), "p_size + 0.5", 3), ("fixed_", lambda v: call("FIXED", v.Z * 1000 + 0.25, 1, True), "printf('%d.3', p_size * 1000)", None), ("dollar_", lambda v: call("DOLLAR", v.Z * 1000, 0), "format('${:,}', p_size * 1000)", None), ("text_fixed", lambda v: call("TEXT", v.Z + 0.25, "0.00"), "printf('%d.25', p_size)", None),
    ("text_percent", lambda v: call("TEXT", v.Z / 100, "0%"), "printf('%d%%', p_size)", None), ("text_group", lambda v: call("TEXT", v.Z * 1000, "#,##0"), "format('{:,}', p_size * 1000)", None), ("valuetotext_", lambda v: call("VALUETOTEXT", v.N), "p_name", None), ("arraytotext_", lambda v: call("ARRAYTOTEXT", F.array(v.N, v.B)), "concat(p_name, ', ', p_brand)", None), ("n_", lambda v: call("N", v.Z), "p_size", 3),
)

scalars(
    "information_functions", "part", "p_partkey",
    ("isblank_", lambda v: call("ISBLANK", F.when(v.Z > 9, v.Z)), "p_size <= 9", None), ("isnumber_", lambda v: call("ISNUMBER", v.Z), "true", None), ("istext_", lambda v: call("ISTEXT", v.N), "true", None), ("isnontext_", lambda v: call("ISNONTEXT", v.N), "false", None), ("islogical_", lambda v: call("ISLOGICAL", v.Z > 9), "true", None), ("iserr_", lambda v: call("ISERR", cell(v.Z) / cell(v.Z % 2)), "p_size % 2 = 0", None),
    ("iserror_", lambda v: call("ISERROR", cell(v.Z) / cell(v.Z % 2)), "p_size % 2 = 0", None), ("isna_", lambda v: call("ISNA", call("NA")), "true", None), ("type_", lambda v: call("TYPE", v.Z), "1", 3), ("type_text", lambda v: call("TYPE", v.N), "2", 3), ("error_type", lambda v: call("IFERROR", call("ERROR.TYPE", cell(v.Z) / cell(v.Z % 2)), 0), "CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END", 3),
    ("if_", lambda v: call("IF", v.Z > 9, "big", "small"), "CASE WHEN p_size > 9 THEN 'big' ELSE 'small' END", None), ("ifna_", lambda v: call("IFNA", call("TEXTAFTER", v.N, "small "), "none"), "CASE WHEN contains(p_name, 'small ') THEN string_split(p_name, 'small ')[2] ELSE 'none' END", None), ("or_", lambda v: call("OR", v.Z > 40, v.Z < 5), "p_size > 40 OR p_size < 5", None), ("not_", lambda v: call("NOT", v.Z > 9), "p_size <= 9", None), ("xor_", lambda v: call("XOR", v.Z > 9, v.Z > 20), "p_size > 9 AND p_size <= 20", None),
    ("choose_", lambda v: call("CHOOSE", v.Z % 3 + 1, "a", "b", "c"), "['a', 'b', 'c'][p_size % 3 + 1]", None), ("true_", lambda v: call("TRUE"), "true", None), ("false_", lambda v: call("FALSE"), "false", None),
    ("less_number", lambda v: cell(v.Z) < cell(20), "p_size < 20", None), ("number_before_text", lambda v: cell(v.P) < cell(v.N), "true", None), ("text_without_case", lambda v: cell(v.N) == cell(F.upper(v.N)), "true", None), ("text_before_boolean", lambda v: cell(v.N) < cell(v.Z > 9), "true", None), ("empty_is_zero", lambda v: cell(F.when(v.Z > 9, v.Z)) >= cell(0), "true", None), ("empty_is_text", lambda v: cell(F.when(v.Z > 9, v.N)) == cell(""), "p_size <= 9", None),
)

o_ = "o_orderdate::DATE"
serial_ = lambda s: f"date_diff('day', DATE '1899-12-30', ({s})::DATE)"
scalars(
    "date_part_functions", "orders", "o_orderkey",
    ("date_", lambda v: call("DATE", F.year(v.O), 14, 5), serial_(f"make_date(year({o_}) + 1, 2, 5)"), 3), ("days360_", lambda v: call("DAYS360", F.make_date(F.year(v.O), F.month(v.O), F.lit(5)), F.make_date(F.year(v.O) + 1, F.lit(3), F.lit(17))), f"360 + (3 - month({o_})) * 30 + 12", 3), ("datedif_d", lambda v: call("DATEDIF", F.make_date(F.lit(1990), F.lit(1), F.lit(1)), v.O, "D"), f"date_diff('day', DATE '1990-01-01', {o_})", 3),
    ("datedif_y", lambda v: call("DATEDIF", F.make_date(F.lit(1990), F.lit(1), F.lit(1)), v.O, "Y"), f"year({o_}) - 1990", 3), ("datedif_m", lambda v: call("DATEDIF", F.make_date(F.lit(1990), F.lit(1), F.lit(1)), v.O, "M"), f"(year({o_}) - 1990) * 12 + month({o_}) - 1", 3), ("yearfrac_", lambda v: call("YEARFRAC", F.make_date(F.lit(1990), F.lit(1), F.lit(1)), v.O, 3), f"date_diff('day', DATE '1990-01-01', {o_}) / 365", 9), ("weeknum_", lambda v: call("WEEKNUM", v.O, 21), f"week({o_})", 3),
    ("weekday_monday", lambda v: call("WEEKDAY", v.O, 2), f"isodow({o_})", 3), ("workday_", lambda v: call("WORKDAY", F.date_sub(v.O, F.weekday(v.O)), 7), serial_(f"{o_} - (isodow({o_}) - 1)::INTEGER + 9"), 3), ("workday_intl", lambda v: call("WORKDAY.INTL", F.date_sub(v.O, F.weekday(v.O)), 7, 1), serial_(f"{o_} - (isodow({o_}) - 1)::INTEGER + 9"), 3), ("networkdays_intl", lambda v: call("NETWORKDAYS.INTL", v.O, F.date_add(v.O, 13), 1), "10", 3),
    ("text_date", lambda v: call("TEXT", v.O, "yyyy-mm-dd"), f"strftime({o_}, '%Y-%m-%d')", None),
)
scalars(
    "time_functions", "events", "event_id",
    ("hour_", lambda v: call("HOUR", v.T), "hour(ts)", 3), ("minute_", lambda v: call("MINUTE", v.T), "minute(ts)", 3), ("second_", lambda v: call("SECOND", v.T), "second(ts)", 3), ("time_", lambda v: call("TIME", F.hour(v.T), F.minute(v.T), 30), "(hour(ts) * 3600 + minute(ts) * 60 + 30) / 86400", 9), ("timevalue_", lambda v: call("TIMEVALUE", F.date_format(v.T, "HH:mm")), "(hour(ts) * 3600 + minute(ts) * 60) / 86400", 9),
)

n_, rate_ = "(p_size + 10)", "0.01"
pay_ = "(-p_retailprice * 0.01 / (1 - pow(1.01, -60)))"
balance_ = lambda k: f"(p_retailprice * pow(1.01, {k}) + {pay_} * (pow(1.01, {k}) - 1) / 0.01)"
scalars(
    "loan_functions", "part", "p_partkey",
    ("pv_", lambda v: call("PV", 0.01, v.Z, -10), "10 * (1 - pow(1.01, -p_size)) / 0.01", 6), ("nper_", lambda v: call("NPER", 0.01, -100, v.P), "-ln(1 - p_retailprice * 0.01 / 100) / ln(1.01)", 6), ("ipmt_", lambda v: call("IPMT", 0.01, v.Z, 60, v.P), f"-{balance_('(p_size - 1)')} * 0.01", 6), ("ppmt_", lambda v: call("PPMT", 0.01, v.Z, 60, v.P), f"{pay_} + {balance_('(p_size - 1)')} * 0.01", 6), ("ispmt_", lambda v: call("ISPMT", 0.01, v.Z, 60, v.P), "p_retailprice * 0.01 * (p_size / 60 - 1)", 6),
    ("cumprinc_", lambda v: call("CUMPRINC", 0.01, 60, v.P, 1, 12, 0), f"{balance_('12')} - p_retailprice", 5), ("cumipmt_", lambda v: call("CUMIPMT", 0.01, 60, v.P, 1, 12, 0), f"12 * {pay_} - ({balance_('12')} - p_retailprice)", 5), ("rate_", lambda v: call("RATE", 60, call("PMT", 0.01, 60, v.P), v.P), "0.01", 6), ("nominal_", lambda v: call("NOMINAL", v.X, 12), f"(pow(1 + {x_}, 1 / 12) - 1) * 12", 9), ("pduration_", lambda v: call("PDURATION", 0.05, v.P, 2 * v.P), "ln(2) / ln(1.05)", 9),
    ("rri_", lambda v: call("RRI", v.Z, v.P, 2 * v.P), "pow(2, 1 / p_size) - 1", 9), ("fvschedule_", lambda v: call("FVSCHEDULE", v.P, 0.1, 0.2), "p_retailprice * 1.32", 6), ("db_", lambda v: call("DB", v.P, 100, 5, 1), "p_retailprice * round(1 - pow(100 / p_retailprice, 0.2), 3)", 6), ("ddb_", lambda v: call("DDB", v.P, 10, 10, 2), "p_retailprice * 0.8 * 0.2", 6), ("vdb_", lambda v: call("VDB", v.P, 10, 10, 0, 1), "p_retailprice * 0.2", 6), ("dollarde_", lambda v: call("DOLLARDE", v.Z + 0.4, 8), "p_size + 0.5", 6),
    ("dollarfr_", lambda v: call("DOLLARFR", v.Z + 0.5, 8), "p_size + 0.4", 6), ("mirr_", lambda v: call("MIRR", F.array(-v.P, F.lit(0.0), 2 * v.P), 0.1, 0.1), "sqrt(2) - 1", 7), ("irr_", lambda v: call("IRR", F.array(-v.P, F.lit(0.0), 2 * v.P)), "sqrt(2) - 1", 7), ("xnpv_", lambda v: call("XNPV", 0.1, F.array(v.P, v.P), F.array(F.lit(40000.0), F.lit(40365.0))), "p_retailprice + p_retailprice / 1.1", 6), ("xirr_", lambda v: call("XIRR", F.array(-v.P, 1.5 * v.P), F.array(F.lit(40000.0), F.lit(40365.0))), "0.5", 6),
)

s_ = f"make_date(year({o_}), month({o_}), 15)"
y_ = "(1 + (o_custkey % 9) / 200)"  # 1 + half a year's yield
paid_ = lambda f: f"list_sum(list_transform(range(1, 11), lambda k: {f}))"
price_ = f"({paid_(f'3 / pow({y_}, k)')} + 100 / pow({y_}, 10))"
duration_ = f"(({paid_(f'k / 2 * 3 / pow({y_}, k)')} + 5 * 100 / pow({y_}, 10)) / {price_})"
scalars(
    "security_functions", "orders", "o_orderkey",
    ("disc_", lambda v: call("DISC", v.S, v.H, 97, 100, 2), "0.03 * 4", 9), ("intrate_", lambda v: call("INTRATE", v.S, v.H, 97, 100, 2), "3 / 97 * 4", 9), ("received_", lambda v: call("RECEIVED", v.S, v.H, 97, 0.05, 2), "97 / (1 - 0.05 / 4)", 9), ("pricedisc_", lambda v: call("PRICEDISC", v.S, v.H, 0.05, 100, 2), "100 - 5 / 4", 9), ("yielddisc_", lambda v: call("YIELDDISC", v.S, v.H, 97, 100, 2), "(100 / 97 - 1) * 4", 9), ("accrintm_", lambda v: call("ACCRINTM", v.S, v.H, 0.05, 1000, 2), "1000 * 0.05 / 4", 9), ("accrint_", lambda v: call("ACCRINT", v.S, v.H, v.H, 0.05, 1000, 2, 2), "1000 * 0.05 / 4", 9),
    ("tbillprice_", lambda v: call("TBILLPRICE", v.S, v.H, 0.05), "100 * (1 - 0.05 / 4)", 9), ("tbillyield_", lambda v: call("TBILLYIELD", v.S, v.H, 97), "3 / 97 * 4", 9), ("tbilleq_", lambda v: call("TBILLEQ", v.S, v.H, 0.05), "365 * 0.05 / (360 - 0.05 * 90)", 9), ("coupnum_", lambda v: call("COUPNUM", v.S, v.M, 2), "10", 3), ("couppcd_", lambda v: call("COUPPCD", v.S, v.M, 2), serial_(s_), 3), ("coupncd_", lambda v: call("COUPNCD", v.S, v.M, 2), serial_(f"{s_} + INTERVAL 6 MONTH"), 3),
    ("coupdaybs_", lambda v: call("COUPDAYBS", v.S, v.M, 2), "0", 3), ("coupdays_", lambda v: call("COUPDAYS", v.S, v.M, 2), "180", 3), ("coupdaysnc_", lambda v: call("COUPDAYSNC", v.S, v.M, 2), "180", 3), ("price_", lambda v: call("PRICE", v.S, v.M, 0.06, v.Y, 100, 2), price_, 6), ("yield_", lambda v: call("YIELD", v.S, v.M, 0.06, call("PRICE", v.S, v.M, 0.06, v.Y, 100, 2).value, 100, 2), "(o_custkey % 9) / 100", 6), ("duration_", lambda v: call("DURATION", v.S, v.M, 0.06, v.Y, 2), duration_, 6), ("mduration_", lambda v: call("MDURATION", v.S, v.M, 0.06, v.Y, 2), f"{duration_} / {y_}", 6),
    ("pricemat_", lambda v: call("PRICEMAT", v.S, v.M, v.S, 0.06, 0.05), "(100 + 5 * 6) / (1 + 5 * 0.05)", 6), ("yieldmat_", lambda v: call("YIELDMAT", v.S, v.M, v.S, 0.06, 104), "((1 + 5 * 0.06) / 1.04 - 1) / 5", 6),
)

# Distributions, where they have closed forms.
erf_ = lambda z: f"(2 / sqrt({PI}) * list_sum(list_transform(range(0, 80), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow({z}, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))))"
normal_ = lambda z: f"(0.5 + 0.5 * {erf_(f'({z}) / sqrt(2)')})"
w_ = "((p_size - 25) / 12)"
choose_ = lambda n, k: f"(gamma({n} + 1) / gamma({k} + 1) / gamma({n} - {k} + 1))"
scalars(
    "normal_distribution_functions", "part", "p_partkey",
    ("norm_dist", lambda v: call("NORM.DIST", v.Z, 25, 12, True), normal_(w_), 7), ("normdist_", lambda v: call("NORMDIST", v.Z, 25, 12, False), f"exp(-{w_} * {w_} / 2) / 12 / sqrt(2 * {PI})", 9), ("norm_s_dist", lambda v: call("NORM.S.DIST", v.W, True), normal_(w_), 7), ("normsdist_", lambda v: call("NORMSDIST", v.W), normal_(w_), 7), ("norm_inv", lambda v: call("NORM.DIST", call("NORM.INV", v.X, 5, 2), 5, 2, True), x_, 7), ("norm_s_inv", lambda v: call("NORM.S.DIST", call("NORM.S.INV", v.X), True), x_, 7),
    ("norminv_", lambda v: call("NORM.DIST", call("NORMINV", v.X, 5, 2), 5, 2, True), x_, 7), ("normsinv_", lambda v: call("NORMSDIST", call("NORMSINV", v.X)), x_, 7), ("gauss_", lambda v: call("GAUSS", v.W), f"{normal_(w_)} - 0.5", 7), ("phi_", lambda v: call("PHI", v.W), f"exp(-{w_} * {w_} / 2) / sqrt(2 * {PI})", 9), ("standardize_", lambda v: call("STANDARDIZE", v.Z, 25, 12), w_, 9), ("fisher_", lambda v: call("FISHER", v.X), f"0.5 * ln((1 + {x_}) / (1 - {x_}))", 9), ("fisherinv_", lambda v: call("FISHERINV", v.W), f"(exp(2 * {w_}) - 1) / (exp(2 * {w_}) + 1)", 9),
    ("lognorm_dist", lambda v: call("LOGNORM.DIST", v.Z, 2, 1.5, True), normal_("(ln(p_size) - 2) / 1.5"), 7), ("lognormdist_", lambda v: call("LOGNORMDIST", v.Z, 2, 1.5), normal_("(ln(p_size) - 2) / 1.5"), 7), ("lognorm_inv", lambda v: call("LOGNORM.DIST", call("LOGNORM.INV", v.X, 2, 1.5), 2, 1.5, True), x_, 7), ("loginv_", lambda v: call("LOGNORM.DIST", call("LOGINV", v.X, 2, 1.5), 2, 1.5, True), x_, 7),
    ("erf_precise", lambda v: call("ERF.PRECISE", v.W), erf_(w_), 7), ("erfc_", lambda v: call("ERFC", v.W), f"1 - {erf_(w_)}", 7), ("erfc_precise", lambda v: call("ERFC.PRECISE", v.W), f"1 - {erf_(w_)}", 7), ("erf_between", lambda v: call("ERF", 0, v.W), erf_(w_), 7), ("confidence_norm", lambda v: call("NORM.S.DIST", call("CONFIDENCE.NORM", v.X, 3, 9).value, True), f"1 - {x_} / 2", 7), ("confidence_", lambda v: call("NORM.S.DIST", call("CONFIDENCE", v.X, 3, 9).value, True), f"1 - {x_} / 2", 7), ("confidence_t", lambda v: call("CONFIDENCE.T", v.X, 3, 2), f"tan({PI} * (0.5 - {x_} / 2)) * 3 / sqrt(2)", 6),
)

scalars(
    "continuous_distribution_functions", "part", "p_partkey",
    ("expon_dist", lambda v: call("EXPON.DIST", v.X, 3, True), f"1 - exp(-3 * {x_})", 9), ("expondist_", lambda v: call("EXPONDIST", v.X, 3, False), f"3 * exp(-3 * {x_})", 9), ("weibull_dist", lambda v: call("WEIBULL.DIST", v.Z, 2, 20, True), "1 - exp(-pow(p_size / 20, 2))", 9), ("weibull_", lambda v: call("WEIBULL", v.Z, 2, 20, False), "2 / 20 * (p_size / 20) * exp(-pow(p_size / 20, 2))", 9), ("gamma_", lambda v: call("GAMMA", v.X + 1), f"gamma({x_} + 1)", 8), ("gammaln_", lambda v: call("GAMMALN", v.Z + 0.5), "lgamma(p_size + 0.5)", 7), ("gammaln_precise", lambda v: call("GAMMALN.PRECISE", v.Z + 0.5), "lgamma(p_size + 0.5)", 7),
    ("gamma_dist", lambda v: call("GAMMA.DIST", v.Z, 2, 10, True), "1 - exp(-p_size / 10) * (1 + p_size / 10)", 8), ("gammadist_", lambda v: call("GAMMADIST", v.Z, 2, 10, False), "p_size / 100 * exp(-p_size / 10)", 9), ("gamma_inv", lambda v: call("GAMMA.INV", v.X, 1, 10), f"-10 * ln(1 - {x_})", 6), ("gammainv_", lambda v: call("GAMMAINV", v.X, 1, 10), f"-10 * ln(1 - {x_})", 6), ("chisq_dist", lambda v: call("CHISQ.DIST", v.Z, 2, True), "1 - exp(-p_size / 2)", 8), ("chisq_dist_rt", lambda v: call("CHISQ.DIST.RT", v.Z / 5, 4), "exp(-p_size / 10) * (1 + p_size / 10)", 8), ("chidist_", lambda v: call("CHIDIST", v.Z / 5, 2), "exp(-p_size / 10)", 8),
    ("chisq_inv", lambda v: call("CHISQ.INV", v.X, 2), f"-2 * ln(1 - {x_})", 6), ("chisq_inv_rt", lambda v: call("CHISQ.INV.RT", v.X, 2), f"-2 * ln({x_})", 6), ("chiinv_", lambda v: call("CHIINV", v.X, 2), f"-2 * ln({x_})", 6), ("beta_dist", lambda v: call("BETA.DIST", v.X, 3, 1, True), f"pow({x_}, 3)", 8), ("betadist_", lambda v: call("BETADIST", v.X, 1, 3), f"1 - pow(1 - {x_}, 3)", 8), ("beta_inv", lambda v: call("BETA.INV", v.X, 3, 1), f"pow({x_}, 1 / 3)", 6), ("betainv_", lambda v: call("BETAINV", v.X, 3, 1), f"pow({x_}, 1 / 3)", 6),
    ("t_dist", lambda v: call("T.DIST", v.W, 1, True), f"0.5 + atan({w_}) / {PI}", 7), ("t_dist_rt", lambda v: call("T.DIST.RT", v.W, 2), f"0.5 - {w_} / (2 * sqrt(2 + {w_} * {w_}))", 7), ("t_dist_2t", lambda v: call("T.DIST.2T", v.X, 1), f"1 - 2 * atan{x_} / {PI}", 7), ("tdist_", lambda v: call("TDIST", v.X, 1, 2), f"1 - 2 * atan{x_} / {PI}", 7), ("t_inv", lambda v: call("T.INV", v.X, 2), f"(2 * {x_} - 1) / sqrt(2 * {x_} * (1 - {x_}))", 6), ("t_inv_2t", lambda v: call("T.INV.2T", v.X, 1), f"tan({PI} * (0.5 - {x_} / 2))", 5), ("tinv_", lambda v: call("TINV", v.X, 1), f"tan({PI} * (0.5 - {x_} / 2))", 5),
    ("f_dist", lambda v: call("F.DIST", v.X * 5, 2, 6, True), f"1 - pow(1 + 5 * {x_} / 3, -3)", 7), ("f_dist_rt", lambda v: call("F.DIST.RT", v.X * 5, 2, 6), f"pow(1 + 5 * {x_} / 3, -3)", 7), ("fdist_", lambda v: call("FDIST", v.X * 5, 2, 6), f"pow(1 + 5 * {x_} / 3, -3)", 7), ("f_inv", lambda v: call("F.INV", v.X, 2, 6), f"3 * (pow(1 - {x_}, -1 / 3) - 1)", 6), ("f_inv_rt", lambda v: call("F.INV.RT", v.X, 2, 6), f"3 * (pow({x_}, -1 / 3) - 1)", 6), ("finv_", lambda v: call("FINV", v.X, 2, 6), f"3 * (pow({x_}, -1 / 3) - 1)", 6),
)

q_ = "(p_size % 8)"
scalars(
    "discrete_distribution_functions", "part", "p_partkey",
    ("poisson_dist", lambda v: call("POISSON.DIST", v.Q, 3, True), f"exp(-3) * list_sum(list_transform(range(0, {q_} + 1), lambda k: pow(3, k) / gamma(k + 1)))", 9), ("poisson_", lambda v: call("POISSON", v.Q, 3, False), f"exp(-3) * pow(3, {q_}) / gamma({q_} + 1)", 9), ("binom_dist", lambda v: call("BINOM.DIST", v.Q, 9, 0.3, False), f"{choose_('9', q_)} * pow(0.3, {q_}) * pow(0.7, 9 - {q_})", 9), ("binomdist_", lambda v: call("BINOMDIST", v.Q, 9, 0.3, True), f"list_sum(list_transform(range(0, {q_} + 1), lambda k: {choose_('9', 'k')} * pow(0.3, k) * pow(0.7, 9 - k)))", 9),
    ("binom_dist_range", lambda v: call("BINOM.DIST.RANGE", 9, 0.3, v.Q, v.Q + 1), f"{choose_('9', q_)} * pow(0.3, {q_}) * pow(0.7, 9 - {q_}) + {choose_('9', f'({q_} + 1)')} * pow(0.3, {q_} + 1) * pow(0.7, 8 - {q_})", 9), ("binom_inv", lambda v: call("BINOM.INV", 1, 0.5, v.X), f"CASE WHEN {x_} <= 0.5 THEN 0 ELSE 1 END", 3), ("critbinom_", lambda v: call("CRITBINOM", 1, 0.5, v.X), f"CASE WHEN {x_} <= 0.5 THEN 0 ELSE 1 END", 3),
    ("negbinom_dist", lambda v: call("NEGBINOM.DIST", v.Q, 1, 0.3, True), f"1 - pow(0.7, {q_} + 1)", 9), ("negbinomdist_", lambda v: call("NEGBINOMDIST", v.Q, 3, 0.3), f"{choose_(f'({q_} + 2)', '2')} * pow(0.3, 3) * pow(0.7, {q_})", 9), ("hypgeom_dist", lambda v: call("HYPGEOM.DIST", v.Q % 4, 3, 8, 20, False), f"{choose_('8', f'({q_} % 4)')} * {choose_('12', f'(3 - {q_} % 4)')} / {choose_('20', '3')}", 9), ("hypgeomdist_", lambda v: call("HYPGEOMDIST", v.Q % 4, 3, 8, 20), f"{choose_('8', f'({q_} % 4)')} * {choose_('12', f'(3 - {q_} % 4)')} / {choose_('20', '3')}", 9),
)

# Bessel functions by their series.
half_ = f"({x_} / 2)"
scalars(
    "bessel_functions", "part", "p_partkey",
    ("besselj_", lambda v: call("BESSELJ", v.X, 1), f"list_sum(list_transform(range(0, 20), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow({half_}, 2 * k + 1) / (gamma(k + 1) * gamma(k + 2))))", 7), ("besseli_", lambda v: call("BESSELI", v.X, 1), f"list_sum(list_transform(range(0, 20), lambda k: pow({half_}, 2 * k + 1) / (gamma(k + 1) * gamma(k + 2))))", 7),
    ("wronskian_jy", lambda v: call("BESSELJ", v.X, 1) * call("BESSELY", v.X, 0) - call("BESSELJ", v.X, 0) * call("BESSELY", v.X, 1), f"2 / ({PI} * {x_})", 5), ("wronskian_ik", lambda v: call("BESSELI", v.X, 0) * call("BESSELK", v.X, 1) + call("BESSELI", v.X, 1) * call("BESSELK", v.X, 0), f"1 / {x_}", 5),
)
