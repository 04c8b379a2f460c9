"""Row and column quality filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .shared import q, stats_row, strings


def drop_sparse_columns(df: DataFrame, share: float = 0.1) -> DataFrame:
    """Keeps columns with at least int(share * rows) non-null values."""
    s = stats_row(df, {"": F.count("*"), **{c: F.count(q(c)) for c in df.columns}})
    return df.select(*[q(c) for c in df.columns if s[c] >= int(s[""] * share)])


def drop_sparse_rows(df: DataFrame) -> DataFrame:
    """Drops rows without any value, and rows with fewer values than half the columns, rounded down."""
    return df.dropna("all").dropna(thresh=len(df.columns) // 2) if len(df.columns) > 1 else df.dropna("all")


def critical_columns(columns: Iterable[str], types: dict[str, str] | None = None) -> list[str]:
    return [c for c in columns if any(w in c.lower() or w in (types or {}).get(c, "").lower() for w in K.CRITICAL_WORDS)]


def critical_filter(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """With more than one critical column, keeps rows with at least all but one of them."""
    found = critical_columns(df.columns, types)
    return df.dropna(thresh=len(found) - 1, subset=found) if len(found) > 1 else df


def dummy_filter(df: DataFrame, identifiers: list[str] | None = None) -> DataFrame:
    """Drops rows where placeholders fill at least two and half of the identifier columns (all string columns if none)."""
    cols = identifiers or strings(df)
    if not cols:
        return df
    hits = sum((F.coalesce(F.lower(F.trim(q(c).cast("string"))).rlike(K.DUMMY_VALUE), F.lit(False)).cast("int") for c in cols), F.lit(0))
    return df.where(hits < max(2, len(cols) // 2))


def drop_missing_targets(df: DataFrame, targets: list[str]) -> DataFrame:
    found = [t for t in targets if t in df.columns]
    return df.dropna(subset=found) if found else df


def drop_exact_duplicates(df: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The first row, in the given order, of rows that are the same in `columns` (all but the order's by default).

    A grouped minimum of the order and a join by it rather than a window, so a value that a third of all rows share is
    pre-aggregated.
    """
    columns = columns or [c for c in df.columns if c not in order]
    first = df.groupBy(*[q(c) for c in columns]).agg(F.min(F.struct(*[q(c) for c in order])).alias("_o"))
    return first.select(*[q(c) for c in columns], *[F.col(f"_o.`{c}`").alias(c) for c in order]).select(*[q(c) for c in [*columns, *order]])


def quality_filter(df: DataFrame, types: dict[str, str] | None = None, identifiers: list[str] | None = None) -> DataFrame:
    """All filters in turn: sparse columns, sparse rows, critical fields, placeholders."""
    out = critical_filter(drop_sparse_rows(drop_sparse_columns(df)), types)
    return dummy_filter(out, [c for c in identifiers or [] if c in out.columns] or None)
