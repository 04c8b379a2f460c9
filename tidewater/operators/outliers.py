"""Outliers: choice of method by distribution, clipping, hard bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .rules import replace
from .shared import numbers, q, quantiles, rows_frame, stats_row


def bounds_for(column: str, compat: bool = False) -> tuple[float | None, float | None] | None:
    """Hard bounds of a column: those of the longest word whose parts the name has in a row; compat: of the first word that
    is anywhere in the name."""
    low = column.lower()
    if compat:
        return next((b for w, b in K.DOMAIN_BOUNDS.items() if w in low), None)
    parts = f"_{low.replace(' ', '_')}_"
    found = [w for w in K.DOMAIN_BOUNDS if f"_{w}_" in parts]
    return K.DOMAIN_BOUNDS[max(found, key=len)] if found else None


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """c within bounds; nulls stay."""
    v = c.cast("double")
    if low is not None:
        v = F.greatest(v, F.lit(float(low)))
    if high is not None:
        v = F.least(v, F.lit(float(high)))
    return F.when(c.isNotNull(), v)


def _quartiles(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float] | None]:
    n, found = stats_row(df, {c: F.count(q(c)) for c in columns}), quantiles(df, {c: [0.25, 0.75] for c in columns})
    return {c: tuple(found[c]) if n[c] >= 4 else None for c in columns}


def iqr_bounds(df: DataFrame, columns: list[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Bounds by quartiles; columns with fewer than 4 values have none."""
    return {c: (v[0] - k * (v[1] - v[0]), v[1] + k * (v[1] - v[0])) for c, v in _quartiles(df, columns).items() if v}


def z_bounds(df: DataFrame, columns: list[str], z: float = 3.0) -> dict[str, tuple[float, float]]:
    """Bounds by mean and sample deviation; columns without spread have none."""
    s = stats_row(df, {(c, k): f(q(c)) for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))})
    return {c: (float(s[c, "m"] - z * s[c, "s"]), float(s[c, "m"] + z * s[c, "s"])) for c in columns if s[c, "s"]}


def clip_all(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    return replace(df, {c: clip(q(c), *b) for c, b in bounds.items()})


def cap_domain(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]], k: float = 1.5) -> DataFrame:
    """Values outside hard bounds become the column's median (of all values, before), then quartile bounds clip."""
    medians = {c: v[0] if v else None for c, v in quantiles(df, {c: [0.5] for c in bounds}).items()}

    def capped(c: str) -> Column:
        low, high = bounds[c]
        bad = F.lit(False)
        if low is not None:
            bad = bad | (q(c) < low)
        if high is not None:
            bad = bad | (q(c) > high)
        return F.when(bad, F.lit(medians[c])).otherwise(q(c).cast("double"))

    df = replace(df, {c: capped(c) for c in bounds})
    return clip_all(df, iqr_bounds(df, list(bounds), k))


def choose_methods(df: DataFrame, columns: list[str] | None = None, compat: bool = False) -> dict[str, str]:
    """domain_cap for columns with hard bounds, else iqr for few or skewed values (adjusted skewness over 1), else zscore."""
    cols = columns or numbers(df)
    s = stats_row(df, {(c, k): f(q(c).cast("double")) for c in cols for k, f in (("n", F.count), ("g", F.skewness))})
    out = {}
    for c in cols:
        n, g = s[c, "n"], s[c, "g"]
        skew = abs(g) * (n * (n - 1)) ** 0.5 / (n - 2) if n >= 4 and g is not None and g == g else 0.0
        out[c] = "domain_cap" if bounds_for(c, compat) else "iqr" if n < 4 or skew > 1 else "zscore"
    return out


def treat_outliers(df: DataFrame, intent: str = "", k: float = 1.5, z: float = 3.0, compat: bool = False, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Treats numeric columns (all, or those given), one aggregate for each method; returns the frame and column, method, lower, upper.

    Business measures without hard bounds are left alone in business data.
    """
    chosen = choose_methods(df, [c for c in columns if c in numbers(df)] if columns is not None else None, compat)
    if intent == "Non-Predictive Business":
        chosen = {c: "skip" if m != "domain_cap" and any(w in c.lower() for w in K.BUSINESS_METRICS) else m for c, m in chosen.items()}
    by = lambda m: [c for c, x in chosen.items() if x == m]
    used = iqr_bounds(df, by("iqr"), k) | z_bounds(df, by("zscore"), z)
    hard = {c: bounds_for(c, compat) for c in by("domain_cap")}
    out = cap_domain(clip_all(df, used), hard, k) if hard else clip_all(df, used)
    used |= hard
    rows = [(c, m, *[None if x is None else float(x) for x in used.get(c, (None, None))]) for c, m in chosen.items()]
    return out, rows_frame(df.sparkSession, rows, "column string, method string, lower double, upper double")
