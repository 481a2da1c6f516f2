"""Request validation: ordered rule chains with the first failure as reason.

A rule is (ok, status_code, message). Rules run in the reference's order;
the first failing rule decides the request's status code and reason, as an
exception thrown at that point would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.functions.exprs import (clean_text, date_text_ok, is_blank, is_finite_non_negative,
                                    js_number, js_trim, normalise_time, positive_id, time_text_ok)


class Rule:
    def __init__(self, ok: Column, code: int, message):
        self.ok = F.coalesce(ok, F.lit(False))
        self.code = code
        self.message = message if isinstance(message, Column) else F.lit(message)


def first_failure(rules: list[Rule]) -> tuple[Column, Column]:
    """(status_code, reason) of the first failing rule; (NULL, NULL) when all pass."""
    code, reason = None, None
    for r in rules:
        if code is None:
            code, reason = F.when(~r.ok, F.lit(r.code)), F.when(~r.ok, r.message)
        else:
            code, reason = code.when(~r.ok, F.lit(r.code)), reason.when(~r.ok, r.message)
    return code, reason


def apply_rules(df: DataFrame, rules: list[Rule], code_col="status_code", reason_col="reason") -> DataFrame:
    code, reason = first_failure(rules)
    return df.withColumn(code_col, code).withColumn(reason_col, reason)


# --- VL1-VL3 field rules ---------------------------------------------------

def required_text(c: str, field: str, max_len: int = 120) -> tuple[Rule, Column]:
    """VL1: trimmed text must be non-empty; value cut to ``max_len``."""
    return Rule(~is_blank(F.col(c)), 400, f"{field} is required"), clean_text(F.col(c), max_len)


def required_text_default(c: str, default: str, field: str, max_len: int) -> tuple[Rule, Column]:
    """``requiredText(value || default)``: missing/empty text takes the default first."""
    v = F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(default)).otherwise(F.col(c))
    return Rule(~is_blank(v), 400, f"{field} is required"), clean_text(v, max_len)


def optional_text(c: str, max_len: int = 255) -> Column:
    return clean_text(F.col(c), max_len)


def non_negative_number(c: str, field: str, default_when_falsy=None) -> tuple[Rule, Column]:
    """VL2: finite and >= 0. With a default, missing/empty text takes it first."""
    src = F.col(c)
    if default_when_falsy is not None:
        src = F.when(src.isNull() | (src == ""), F.lit(str(default_when_falsy))).otherwise(src)
    n = js_number(src)
    return Rule(is_finite_non_negative(n), 400, f"{field} must be a valid non-negative number"), n


def positive_id_rule(c: str, field: str) -> tuple[Rule, Column]:
    """VL2: a positive integer id."""
    ok, v = positive_id(F.col(c))
    return Rule(ok, 400, f"{field} must be a valid positive id"), v


def date_rules(c: str, field: str) -> tuple[list[Rule], Column]:
    """VL3: required text of at most 10 characters in YYYY-MM-DD form."""
    req, v = required_text(c, field, 10)
    return [req, Rule(date_text_ok(v), 400, f"{field} must use YYYY-MM-DD format")], v


def time_rules(c: str, field: str) -> tuple[list[Rule], Column]:
    """VL3: required text of at most 8 characters, HH:MM or HH:MM:SS; HH:MM gets :00."""
    req, v = required_text(c, field, 8)
    return [req, Rule(time_text_ok(v), 400, f"{field} must use HH:MM format")], normalise_time(v)


def text_value(c: str) -> Column:
    return js_trim(F.coalesce(F.col(c), F.lit("")))
