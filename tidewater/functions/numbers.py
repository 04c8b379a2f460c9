"""Scalar functions on numbers, money and dates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

#: Date formats that are tried, in order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd", "dd MMM yyyy", "MMM dd, yyyy")


def to_number(c: Column) -> Column:
    """A double, or null where the text is no plain decimal number."""
    s = c.cast("string")
    return F.when(s.rlike(K.NUMBER), F.trim(s).try_cast("double"))


def coerce_numeric(c: Column, name: str) -> Column:
    """to_number, without sign where the column's name says amounts that can't be negative."""
    low = name.lower()
    v = to_number(c)
    return F.abs(v) if any(w in low for w in K.ABSOLUTE_WORDS) and not any(w in low for w in K.SIGNED_WORDS) else v


def parse_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Date by the first format that fits the whole trimmed text; a time after a blank or T is ignored."""
    s = F.regexp_replace(F.trim(c.cast("string")), r"(?<=\d)[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$", "")
    shapes = {"yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$", "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$", "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$", "dd.MM.yyyy": r"^\d{2}\.\d{2}\.\d{4}$", "yyyyMMdd": r"^\d{8}$"}
    return F.coalesce(*[F.try_to_date(F.when(s.rlike(shapes[f]), s) if f in shapes else s, f) for f in formats])


def iso_date(c: Column) -> Column:
    return F.date_format(parse_date(c), "yyyy-MM-dd")


def _code(sign: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.CURRENCY_OF.items() for x in kv])
    return F.try_element_at(table, F.lower(F.trim(sign)))


def parse_money(c: Column) -> Column:
    """struct(amount double, code string) of texts like `$1,200.50`, `300 EUR` or `12`; code is null if there's none, both
    are null if the text isn't an amount."""
    s = F.trim(c.cast("string"))
    number = F.regexp_replace(F.regexp_extract(s, K.MONEY, 2), ",", "")
    amount = F.when(number.rlike(K.NUMBER), number.try_cast("double"))
    code = F.coalesce(_code(F.regexp_extract(s, K.MONEY, 1)), _code(F.regexp_extract(s, K.MONEY, 3)))
    return F.struct(amount.alias("amount"), F.when(amount.isNotNull(), code).alias("code"))


def to_rupees(money: Column, rates: dict[str, float] | None = None) -> Column:
    """Amount in rupees, rounded to 2 places; an amount without code counts as rupees."""
    rates = K.RUPEES | (rates or {})
    rate = F.try_element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), money["code"])
    return F.round(money["amount"] * F.coalesce(rate, F.lit(1.0)), 2)
