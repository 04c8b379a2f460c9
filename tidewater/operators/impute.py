"""Filling gaps by statistics, by order, by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ImputationRule
from ..functions import constants as K
from ..functions import text as X
from .neighbours import knn
from .rules import condition, replace
from .shared import carried, numbers, q, quantiles, stats_row, strings


def sensitive(column: str, words: tuple[str, ...] = K.SENSITIVE_WORDS) -> bool:
    low = column.lower().replace(" ", "_")
    return any(w in low for w in words)


def gaps(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Words that mean a missing value become null."""
    cols = [c for c in columns or df.columns if c in strings(df)]
    return replace(df, {c: X.impute_missing(q(c)) for c in cols})


def statistics(df: DataFrame, plan: dict[str, str]) -> dict[str, object]:
    """The fill value of each column whose strategy is a mean, median, mode or knn (median): one aggregate, and one distributed
    sort for all medians."""
    items: dict[str, Column] = {}
    middle = quantiles(df, {c: [0.5] for c, s in plan.items() if s in ("fill_median", "fill_knn") and c in numbers(df)})
    for c, strategy in plan.items():
        if strategy == "fill_mean" and c in numbers(df):
            items[c] = F.avg(q(c))
        elif strategy == "fill_mode":
            items[c] = F.mode(q(c), deterministic=True)
    return stats_row(df, items) | {c: v[0] if v else None for c, v in middle.items()}


def apply_statistical(df: DataFrame, plan: dict[str, str], order: list[str] | None = None, constant: str = "Unknown", guard: bool = True, near: list[str] | None = None) -> tuple[DataFrame, dict[str, object]]:
    """Fills gaps by a strategy for each column; returns the frame and the values that were used.

    Strategies: fill_none (null words to null), fill_mean, fill_median, fill_mode, fill_knn (median of a single column; with `near`,
    the numeric columns that tell rows apart, by knn()), fill_forward, fill_backward, fill_interpolate (by `order`), fill_constant, leave_empty. guard: sensitive columns get
    fill_none whatever their strategy.
    """
    plan = {c: "fill_none" if guard and s != "leave_empty" and sensitive(c) else s for c, s in plan.items() if c in df.columns}
    df = gaps(df, [c for c, s in plan.items() if s != "leave_empty"])
    by_rows = [c for c, s in plan.items() if s == "fill_knn" and near and c in numbers(df)]
    if by_rows:
        whole = knn(df.withColumns({f"_knn_{c}": q(c) for c in near if c not in by_rows}), [*by_rows, *(f"_knn_{c}" for c in near if c not in by_rows)])
        df = whole.select(*[q(c) for c in df.columns])
        plan = {c: "leave_empty" if c in by_rows else s for c, s in plan.items()}
    values = {c: v for c, v in statistics(df, plan).items() if v is not None}
    new: dict[str, Column] = {c: F.coalesce(q(c), F.lit(v).cast(df.schema[c].dataType if plan[c] == "fill_mode" else "double")) for c, v in values.items()}
    new |= {c: F.coalesce(q(c).cast("string"), F.lit(constant)) for c, s in plan.items() if s == "fill_constant"}
    df = replace(df, new)
    moving = [c for c, s in plan.items() if s in ("fill_forward", "fill_backward", "fill_interpolate")]
    if moving:
        if not order:
            raise ValueError("filling by neighbours needs an order")
        wide = carried(df, moving, order)
        df = wide.select(*[_neighbour(c, plan[c], c in numbers(df)).alias(c) if c in moving else q(c) for c in df.columns])
    return df, values


def _neighbour(c: str, strategy: str, numeric: bool) -> Column:
    before, after = q(f"{c}_prev"), q(f"{c}_next")
    if strategy == "fill_backward":
        return after
    if strategy == "fill_forward" or not numeric:
        return before
    span = q(f"{c}_next_at") - q(f"{c}_prev_at")
    between = before + (after - before) * (F.col("_rid") - q(f"{c}_prev_at")) / span
    return F.coalesce(q(c).cast("double"), F.when(span > 0, between), before.cast("double"), after.cast("double"))


def fill(df: DataFrame, column: str, strategy: str, order: list[str] | None = None, **more) -> DataFrame:
    return apply_statistical(df, {column: strategy}, order, guard=False, **more)[0]


def apply_rules(df: DataFrame, rules: list[ImputationRule]) -> DataFrame:
    """Rules by falling confidence, each on what the ones before it left missing; sensitive columns only lose null words."""
    df = gaps(df, sorted({r.target_column for r in rules if r.target_column in df.columns}))
    for r in sorted(rules, key=lambda r: -r.confidence):
        if r.target_column in df.columns and not sensitive(r.target_column):
            value = F.lit(r.fill_value).try_cast(df.schema[r.target_column].dataType)
            df = replace(df, {r.target_column: F.when(q(r.target_column).isNull() & condition(df, r.condition), value).otherwise(q(r.target_column))})
    return df


def fill_audit(before: DataFrame, plan: dict[str, str], values: dict[str, object]) -> DataFrame:
    """column, strategy, fill_value, rows_filled, missing_pct of a statistical fill."""
    s = stats_row(gaps(before), {"n": F.count("*"), **{f"c {c}": F.count_if(q(c).isNull()) for c in plan}})
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    rows = [(c, p, show(values.get(c)), s[f"c {c}"] if p not in ("leave_empty", "fill_none") else 0, round(100.0 * s[f"c {c}"] / s["n"], 2) if s["n"] else 0.0) for c, p in plan.items()]
    return before.sparkSession.createDataFrame(rows, "column string, strategy string, fill_value string, rows_filled long, missing_pct double")


__all__ = ["apply_rules", "apply_statistical", "fill", "fill_audit", "gaps", "knn", "sensitive", "statistics"]
