"""Column expressions shared by the read models, validators and jobs.

All of them are built-in Spark functions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odonto.schemas import CODE_FORMATS, MONEY, WEEKDAYS

__all__ = [
    "col_or_lit", "code", "age", "weekday_name", "hhmm", "normalise_time", "js_trim",
    "clean_text", "is_blank", "js_number", "is_finite_non_negative", "positive_id",
    "to_money", "date_text_ok", "date_value", "padded", "time_text_ok", "time_value_ok", "derived_bill_status",
    "weekday_ordinal", "month_range", "year_range", "ilike_any", "substring_pattern",
    "as_date", "to_double_edge", "yes_no_label",
]

_WS = "[\\s\\x{00A0}\\x{FEFF}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def col_or_lit(x) -> Column:
    """A Column as is; a string names a column; anything else is a literal."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def as_date(d) -> Column:
    """A date parameter (``datetime.date`` / ISO text) or column as a date column."""
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = dt.date.fromisoformat(d)
    return F.lit(d)


def code(table: str, id_col) -> Column:
    """Business code from an id: prefix + id zero-padded to the table's width.

    Padding never truncates: id 123456 gives ``PAT-123456``.
    """
    prefix, width = CODE_FORMATS[table]
    return F.format_string(f"{prefix}%0{width}d", col_or_lit(id_col).cast("long"))


def age(dob, as_of) -> Column:
    """Completed years between a birth date and ``as_of`` (NULL stays NULL)."""
    return F.timestamp_diff("YEAR", col_or_lit(dob), as_date(as_of)).cast("long")


def weekday_name(d) -> Column:
    """Full upper-case day name: MONDAY .. SUNDAY."""
    return F.upper(F.date_format(col_or_lit(d), "EEEE"))


def weekday_ordinal(day_col) -> Column:
    """1 for MONDAY .. 6 for SATURDAY, 7 for anything else."""
    c = col_or_lit(day_col)
    expr = F.when(c == WEEKDAYS[0], 1)
    for i, name in enumerate(WEEKDAYS[1:6], start=2):
        expr = expr.when(c == name, i)
    return expr.otherwise(7)


def hhmm(t) -> Column:
    """'HH:mm:ss' -> 'HH:mm'."""
    return F.substring(col_or_lit(t), 1, 5)


def normalise_time(t) -> Column:
    """'HH:mm' -> 'HH:mm:00'; 'HH:mm:ss' unchanged."""
    c = col_or_lit(t)
    return F.when(F.length(c) == 5, F.concat(c, F.lit(":00"))).otherwise(c)


def js_trim(c) -> Column:
    """Trim all leading/trailing white space (Spark's ``trim`` only removes spaces)."""
    return F.regexp_replace(col_or_lit(c), f"^{_WS}+|{_WS}+$", "")


def clean_text(c, max_len: int) -> Column:
    """Missing -> '', then trim, then cut to ``max_len`` characters."""
    return F.substring(js_trim(F.coalesce(col_or_lit(c).cast("string"), F.lit(""))), 1, max_len)


def is_blank(c) -> Column:
    return F.length(js_trim(F.coalesce(col_or_lit(c).cast("string"), F.lit("")))) == 0


# Number literal forms that JS ``Number()`` accepts (after trimming).
_JS_DECIMAL = "^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|Infinity)$"
_JS_RADIX = "^0([xX][0-9a-fA-F]+|[bB][01]+|[oO][0-7]+)$"


def _radix_value(s: Column) -> Column:
    """Value of a prefixed integer text as a double, however many digits it
    has: a fold over the digits, which also keeps the generated code small."""
    kind = F.lower(F.substring(s, 2, 1))
    base = F.when(kind == "x", 16.0).when(kind == "b", 2.0).otherwise(8.0)
    digits = F.split(F.lower(F.substr(s, F.lit(3))), "")
    value = lambda c: (F.call_function("instr", F.lit("0123456789abcdef"), c) - 1).cast("double")
    return F.aggregate(digits, F.lit(0.0), lambda total, c: total * base + value(c))


def js_number(c) -> Column:
    """Numeric value of a text field the way a JS ``Number()`` reads it.

    Blank text is 0; missing is NaN (callers treat it as invalid); decimal,
    exponent and Infinity forms parse, as do 0x / 0b / 0o integers; anything
    else (including Java-only forms such as '1d') is NaN.
    """
    s = js_trim(col_or_lit(c).cast("string"))
    out = (F.when(s.isNull(), F.lit(float("nan")))
           .when(s == "", F.lit(0.0))
           .when(s.rlike(_JS_DECIMAL), s.try_cast("double")))
    out = out.when(s.rlike(_JS_RADIX), _radix_value(s))
    return F.coalesce(out.otherwise(F.lit(float("nan"))), F.lit(float("nan")))


def is_finite_non_negative(num: Column) -> Column:
    return (~F.isnan(num)) & (F.abs(num) != float("inf")) & (num >= 0)


def positive_id(c) -> tuple[Column, Column]:
    """(ok, value) for a positive integer id given as text."""
    n = js_number(c)
    ok = (~F.isnan(n)) & (F.abs(n) != float("inf")) & (n == F.floor(n)) & (n > 0)
    return F.coalesce(ok, F.lit(False)), F.when(ok, n.cast("long"))


def to_money(c) -> Column:
    """Text amount -> DECIMAL(10,2), rounding half up; blank -> 0.

    Plain decimal text is parsed exactly (no detour through a binary
    double); other forms JS reads as numbers go through ``js_number``.
    NULL when the value does not fit DECIMAL(10,2).
    """
    s = js_trim(col_or_lit(c).cast("string"))
    exact = (F.when(s == "", F.lit(0).cast("decimal(38,10)"))
             .when(s.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"), s.try_cast("decimal(38,10)"))
             .otherwise(js_number(s).try_cast("decimal(38,10)")))
    return F.round(exact, 2).try_cast(MONEY)


def date_value(c) -> Column:
    """The date a text names in year-month-day form, else NULL ('1990' is no date)."""
    t = col_or_lit(c)
    return F.when(t.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), t.try_cast("date"))


def padded(c, width: int) -> Column:
    """An integer as zero-padded text; longer numbers keep all their digits."""
    return F.format_string(f"%0{width}d", col_or_lit(c).cast("long"))


def date_text_ok(c) -> Column:
    return F.coalesce(col_or_lit(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))


def time_text_ok(c) -> Column:
    return F.coalesce(col_or_lit(c).rlike("^[0-9]{2}:[0-9]{2}(:[0-9]{2})?$"), F.lit(False))


def time_value_ok(t) -> Column:
    """A well-formed 'HH:mm:ss' text names a storable TIME (minutes, seconds < 60)."""
    c = col_or_lit(t)
    small = lambda at: F.coalesce(F.substring(c, at, 2).try_cast("int") < 60, F.lit(False))
    return small(4) & small(7)


def derived_bill_status(paid, total, has_payment=None) -> Column:
    """Bill status from its payments: PAID when covered, PARTIAL when some, else UNPAID.

    A bill without any payment stays UNPAID, even with a zero total.
    """
    p, t = col_or_lit(paid), col_or_lit(total)
    st = F.when(p >= t, "PAID").when(p > 0, "PARTIAL").otherwise("UNPAID")
    if has_payment is not None:
        st = F.when(col_or_lit(has_payment), st).otherwise("UNPAID")
    return st


def month_range(c, year: int, month: int) -> Column:
    """``year(c) = year AND month(c) = month`` as a range the scan can push down."""
    start = dt.date(year, month, 1)
    end = dt.date(year + (month == 12), month % 12 + 1, 1)
    col = col_or_lit(c)
    return (col >= F.lit(start)) & (col < F.lit(end))


def year_range(c, year: int) -> Column:
    col = col_or_lit(c)
    return (col >= F.lit(dt.date(year, 1, 1))) & (col < F.lit(dt.date(year + 1, 1, 1)))


def substring_pattern(text: str) -> str:
    """``%text%`` without escaping: '%' and '_' typed by a user stay wildcards.

    A backslash escapes a wildcard or another backslash; before anything else
    it stands for itself (an unescaped one would be an invalid pattern).
    """
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\":
            if text[i + 1:i + 2] in ("%", "_", "\\"):
                out.append(text[i:i + 2])
                i += 2
                continue
            out.append("\\\\")
        else:
            out.append(text[i])
        i += 1
    return f"%{''.join(out)}%"


def ilike_any(cols: list[str], text: str) -> Column:
    """Case-insensitive substring match on any of ``cols``."""
    pat = substring_pattern(text)
    cond = None
    for c in cols:
        m = F.col(c).ilike(pat)
        cond = m if cond is None else (cond | m)
    return cond


def yes_no_label(c, yes: str, no: str) -> Column:
    return F.when(col_or_lit(c), yes).otherwise(no)


def to_double_edge(df):
    """Cast DECIMAL columns to DOUBLE: the wire format of amounts."""
    return df.select([
        F.col(f"`{f.name}`").cast("double").alias(f.name)
        if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
