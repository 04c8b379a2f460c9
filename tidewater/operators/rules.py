"""Domain rules and rule conditions, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import numbers as N
from .shared import numbers, q, stats_row


def find(df: DataFrame, *names: str) -> str | None:
    """The first column with one of the names, spaces and case apart."""
    by = {c.lower().replace(" ", "_"): c for c in reversed(df.columns)}
    return next((by[n] for n in names if n in by), None)


def replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with columns replaced, all computed from the old ones, in place."""
    return df.select(*[new[c].alias(c) if c in new else q(c) for c in df.columns])


def blank(c: Column) -> Column:
    return c.isNull() | F.trim(c.cast("string")).isin("", "nan", "None")


def date_pair(columns: list[str]) -> tuple[str | None, str | None]:
    """The first order-like and the first delivery-like date column."""
    pick = lambda words: next((c for c in columns if "date" in c.lower() and any(w in c.lower() for w in words)), None)
    return pick(K.ORDER_WORDS), pick(K.DELIVERY_WORDS)


def swap_paradox(df: DataFrame, order: str, delivery: str) -> DataFrame:
    """Swaps the dates of rows whose delivery is before their order."""
    kinds = dict(df.dtypes)
    date = lambda c: q(c) if kinds[c] in ("date", "timestamp") else N.parse_date(q(c))
    wrong = F.coalesce(date(delivery) < date(order), F.lit(False))
    return replace(df, {order: F.when(wrong, q(delivery)).otherwise(q(order)), delivery: F.when(wrong, q(order)).otherwise(q(delivery))})


def within(c: Column, low: float | None, high: float | None) -> Column:
    """c, or null outside the bounds."""
    bad = (c < low) if low is not None else F.lit(False)
    if high is not None:
        bad = bad | (c > high)
    return F.when(~F.coalesce(bad, F.lit(False)), c)


def _bounded(df: DataFrame, words: tuple[str, ...], low: float, high: float | None = None) -> DataFrame:
    return replace(df, {c: within(q(c), low, high) for c in numbers(df) if any(w in c.lower() for w in words)})


def _numeric(df: DataFrame, *names: str) -> str | None:
    c = find(df, *names)
    return c if c in numbers(df) else None


#: Words of column names that domains' rules act on.
RULE_COLUMNS = {
    "Retail": ("priority", "customer_type"), "Finance": ("amount", "balance", "revenue", "profit", "payment_status", "transaction_status"), "Healthcare": ("age", "bmi", "blood_pressure", "systolic"),
    "HR": ("salary",), "E-Commerce": ("price", "mrp", "rating"), "Logistics": ("delivery_status", "tracking_id", "tracking_number"), "Manufacturing": ("yield", "quantity", "production", "output"),
    "Agriculture": ("yield", "production", "area", "acreage"), "Education": ("gpa", "marks", "score", "grade_points"), "Telecommunications": ("data_usage", "call_duration", "minutes"),
}


def retail(df: DataFrame) -> DataFrame:
    priority, kind = find(df, "priority"), find(df, "customer_type")
    if not priority or not kind:
        return df
    return replace(df, {priority: F.when(F.upper(F.trim(q(kind))).isin("B2B", "B2C") & blank(q(priority)), F.lit("Medium")).otherwise(q(priority))})


def finance(df: DataFrame) -> DataFrame:
    new = {c: F.when(q(c).isNotNull(), F.greatest(q(c), F.lit(0).cast(df.schema[c].dataType))) for c in numbers(df) if any(w in c.lower() for w in ("amount", "balance", "revenue", "profit")) and "debit" not in c.lower() and "loss" not in c.lower()}
    pay, status = find(df, "payment_status"), find(df, "order_status", "transaction_status")
    if pay and status:
        new[pay] = F.when(q(pay).isNull() & (F.lower(q(status)) == "delivered"), F.lit("Paid")).otherwise(q(pay))
    return replace(df, new)


def healthcare(df: DataFrame) -> DataFrame:
    bounds = {_numeric(df, "age"): (0, 150), _numeric(df, "bmi"): (10, 70), _numeric(df, "blood_pressure", "systolic"): (60, 250)}
    return replace(df, {c: within(q(c), *b) for c, b in bounds.items() if c})


def hr(df: DataFrame) -> DataFrame:
    c = _numeric(df, "salary")
    return replace(df, {c: within(q(c), 0, None)}) if c else df


def ecommerce(df: DataFrame) -> DataFrame:
    price, rating = _numeric(df, "price", "selling_price", "mrp"), _numeric(df, "rating", "review_rating")
    new = {price: within(q(price), 0, None)} if price else {}
    if rating:
        most = stats_row(df, {"m": F.max(q(rating))})["m"]
        new[rating] = within(q(rating), 0, 10 if most is not None and most > 5 else 5)
    return replace(df, new)


def logistics(df: DataFrame) -> DataFrame:
    status, tracking = find(df, "delivery_status", "status"), find(df, "tracking_id", "tracking_number")
    if not status or not tracking:
        return df
    empty = lambda c: c.isNull() | (F.trim(c.cast("string")) == "")
    return replace(df, {status: F.when(~empty(q(tracking)) & empty(q(status)), F.lit("In Transit")).otherwise(q(status))})


def manufacturing(df: DataFrame) -> DataFrame:
    return _bounded(df, RULE_COLUMNS["Manufacturing"], 0)


def agriculture(df: DataFrame) -> DataFrame:
    return _bounded(df, RULE_COLUMNS["Agriculture"], 0)


def telecommunications(df: DataFrame) -> DataFrame:
    return _bounded(df, RULE_COLUMNS["Telecommunications"], 0)


def education(df: DataFrame) -> DataFrame:
    gpa = _numeric(df, "gpa")
    df = replace(df, {gpa: within(q(gpa), 0, 10)}) if gpa else df
    return _bounded(df, ("marks", "score", "grade_points"), 0, 100)


DOMAINS = {
    "Retail": retail, "Finance": finance, "Healthcare": healthcare, "HR": hr, "E-Commerce": ecommerce, "Logistics": logistics, "Manufacturing": manufacturing, "Agriculture": agriculture,
    "Education": education, "Telecommunications": telecommunications,
}


def domain_rules(df: DataFrame, domain: str) -> DataFrame:
    """The date rule, then the domain's; domains without rules change nothing."""
    order, delivery = date_pair(df.columns)
    if order and delivery:
        df = swap_paradox(df, order, delivery)
    return DOMAINS.get(domain, lambda x: x)(df)


_equal = re.compile(r"^\s*(.+?)\s*(==|!=)\s*(['\"])(.*)\3\s*$", re.S)
_compare = re.compile(r"^\s*(.+?)\s*(>=|<=|>|<)\s*(-?\d+(?:\.\d+)?)\s*$", re.S)


def condition(df: DataFrame, text: str) -> Column:
    """Column of a rule's condition: `name == 'v'`, `name != 'v'` (trimmed, case apart, null being unlike any value) or
    `name > 3` and its kin. What can't be read, or names no column, holds for no row."""
    if (m := _equal.match(text)) and m[1] in df.columns:
        same = F.coalesce(F.lower(F.trim(q(m[1]).cast("string"))) == m[4].strip().lower(), F.lit(False))
        return same if m[2] == "==" else ~same
    if (m := _compare.match(text)) and m[1] in df.columns:
        a, b = N.to_number(q(m[1])), float(m[3])
        return F.coalesce({">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[m[2]], F.lit(False))
    return F.lit(False)
