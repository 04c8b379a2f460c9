"""Columns of money texts: detection, conversion to rupees, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from .rules import replace
from .shared import q, rows_frame, stats_row, strings


def detect(df: DataFrame, least_share: float = 0.5) -> list[str]:
    """String columns that hold amounts in a foreign currency or in several, and whose values are amounts for at least
    least_share (0: one is enough)."""
    items = {}
    for c in strings(df):
        m = N.parse_money(q(c))
        items |= {(c, "n"): F.count(q(c)), (c, "p"): F.count(m["amount"]), (c, "f"): F.count_if(m["code"].isNotNull() & (m["code"] != "INR")), (c, "k"): F.count_distinct(m["code"])}
    s = stats_row(df, items)
    return [c for c in strings(df) if s[c, "p"] and (s[c, "f"] or s[c, "k"] > 1) and s[c, "p"] >= least_share * s[c, "n"]]


def convert(df: DataFrame, columns: list[str] | None = None, rates: dict[str, float] | None = None) -> DataFrame:
    """Columns as doubles in rupees; what isn't an amount becomes null."""
    cols = detect(df) if columns is None else columns
    return replace(df, {c: N.to_rupees(N.parse_money(q(c)), rates) for c in cols})


def report(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, currency (UNKNOWN without), n of the amounts, and n of values that are none as currency FAILED."""
    out = None
    for c in columns:
        m = N.parse_money(q(c))
        code = F.when(m["amount"].isNull(), "FAILED").otherwise(F.coalesce(m["code"], F.lit("UNKNOWN")))
        one = df.where(q(c).isNotNull() & (F.trim(q(c)) != "")).groupBy(code.alias("currency")).agg(F.count("*").alias("n")).select(F.lit(c).alias("column"), "currency", "n")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows_frame(df.sparkSession, [], "column string, currency string, n long")
