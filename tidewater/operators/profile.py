"""Profiles of a table: column statistics, duplicates, scripts, health counts. One aggregate job a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import numbers as N
from ..functions import text as X
from .shared import distinct_counts, numbers, q, quantiles, rows_frame, stats_row, strings


def primary_like(name: str) -> bool:
    """Names of surrogate keys: id, pk, *_id, id_*, *key at the end of a prefixed name."""
    low = name.lower()
    return low in ("id", "pk") or low.endswith("_id") or low.startswith("id_")


def missing(c: Column, kind: T.DataType) -> Column:
    """Null, NaN, or a load marker."""
    if isinstance(kind, T.StringType):
        return X.load_missing(c).isNull()
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNull()


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """column, dtype, n_rows, null_count, null_pct, n_unique of each column. exact: count distinct values exactly, rather
    than by a sketch (5 % off)."""
    items: dict[str, Column] = {"n": F.count("*")}
    for f in df.schema:
        items[f"null {f.name}"] = F.count_if(missing(q(f.name), f.dataType))
    values = {f.name: F.when(~missing(q(f.name), f.dataType), q(f.name)) for f in df.schema}
    if not exact:
        items |= {("unique", c): F.approx_count_distinct(v) for c, v in values.items()}
    s = stats_row(df, items)
    n, unique = s["n"], distinct_counts(df, values) if exact else {c: s["unique", c] for c in values}
    rows = [(f.name, f.dataType.simpleString(), n, s[f"null {f.name}"], round(100.0 * s[f"null {f.name}"] / n, 4) if n else 0.0, unique[f.name]) for f in df.schema]
    return rows_frame(df.sparkSession, rows, "column string, dtype string, n_rows long, null_count long, null_pct double, n_unique long")


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values: column, missing_count, missing_pct (2 places), most first."""
    p = profile_columns_nulls(df)
    return p.where("missing_count > 0").orderBy(F.desc("missing_count"), "column")


def profile_columns_nulls(df: DataFrame) -> DataFrame:
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(missing(q(f.name), f.dataType)).alias(f.name) for f in df.schema])
    long = counts.unpivot(["n"], [q(c) for c in df.columns], "column", "missing_count")
    return long.select("column", "missing_count", F.round(F.lit(100.0) * F.col("missing_count") / F.col("n"), 2).alias("missing_pct"))


def completeness(df: DataFrame) -> DataFrame:
    """n_rows, n_cells, missing_cells, completeness (per cent of cells that are there)."""
    total = sum((F.count_if(missing(q(f.name), f.dataType)) for f in df.schema), F.lit(0))
    out = df.agg(F.count("*").alias("n_rows"), total.alias("missing_cells")).withColumn("n_cells", F.col("n_rows") * len(df.columns))
    return out.select("n_rows", "n_cells", "missing_cells", F.round(100.0 - F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, F.col("n_cells")), F.lit(0.0)), 4).alias("completeness"))


def duplicate_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Groups of rows that are the same in all columns but key-like ones, compared as profile_key: the columns, n."""
    columns = columns or [c for c in df.columns if not primary_like(c)] or df.columns
    return df.groupBy(*[X.profile_key(q(c)).alias(c) for c in columns]).agg(F.count("*").alias("n"))


def exact_duplicate_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """duplicates: rows beyond the first of their group."""
    return duplicate_groups(df, columns).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def exact_duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of df whose group has more than one row, nulls being equal. Groups are joined to rows null-safely; only groups
    with duplicates take part."""
    columns = columns or [c for c in df.columns if not primary_like(c)] or df.columns
    groups = df.groupBy(*[q(c).alias(f"_{i}") for i, c in enumerate(columns)]).agg(F.count("*").alias("_n")).where("_n > 1")
    same = [q(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(columns)]
    condition = same[0]
    for x in same[1:]:
        condition = condition & x
    return df.join(groups, condition, "left_semi")


def quality_score(df: DataFrame, key_columns: list[str] | None = None) -> DataFrame:
    """100 - 40 * share of missing cells - 30 * share of duplicate rows, at least 0, one place."""
    c = completeness(df).first()
    d = exact_duplicate_count(df, key_columns).first()[0]
    n, cells = c["n_rows"], c["n_cells"]
    score = 100.0 - 40.0 * (c["missing_cells"] / cells if cells else 0.0) - 30.0 * (d / n if n else 0.0)
    return rows_frame(df.sparkSession, [(n, c["missing_cells"], d, max(0.0, round(score, 1)))], "n_rows long, missing_cells long, duplicates long, quality_score double")


def non_ascii_ratio(df: DataFrame) -> DataFrame:
    """column, non_ascii_ratio of each string column's non-null values."""
    cols = strings(df)
    one = df.agg(*[F.round(F.coalesce(F.avg(X.has_non_ascii(q(c)).cast("int")), F.lit(0.0)), 6).alias(c) for c in cols])
    return one.unpivot([], [q(c) for c in cols], "column", "non_ascii_ratio")


def script_distribution(df: DataFrame, column: str) -> DataFrame:
    """script, n of a column's non-null values."""
    return df.where(q(column).isNotNull()).groupBy(X.script_of(q(column)).alias("script")).agg(F.count("*").alias("n"))


def invalid_literals(df: DataFrame) -> DataFrame:
    """column, invalid_count: trimmed values that spell out a null."""
    cols = strings(df)
    one = df.agg(*[F.count_if(F.trim(q(c)).isin(list(K.HEALTH_LITERALS))).alias(c) for c in cols])
    return one.unpivot([], [q(c) for c in cols], "column", "invalid_count")


def iqr_outliers(df: DataFrame, k: float = 1.5, columns: list[str] | None = None) -> DataFrame:
    """column, q1, q3, outliers outside [q1 - k iqr, q3 + k iqr], by exact quartiles."""
    cols = columns or numbers(df)
    bounds = {c: v for c, v in quantiles(df, {c: [0.25, 0.75] for c in cols}).items() if v}
    counts = stats_row(df, {c: F.count_if((q(c) < a - k * (b - a)) | (q(c) > b + k * (b - a))) for c, (a, b) in bounds.items()})
    rows = [(c, *(map(float, bounds[c]) if c in bounds else (None, None)), counts.get(c, 0)) for c in cols]
    return rows_frame(df.sparkSession, rows, "column string, q1 double, q3 double, outliers long")


def three_sigma(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, outliers more than three sample deviations from the mean."""
    cols = columns or numbers(df)
    s = stats_row(df, {(c, k): f(q(c)) for c in cols for k, f in (("m", F.avg), ("s", F.stddev_samp))})
    live = [c for c in cols if s[c, "s"] is not None]
    counts = stats_row(df, {c: F.count_if(F.abs(q(c) - s[c, "m"]) > 3 * s[c, "s"]) for c in live})
    return rows_frame(df.sparkSession, [(c, counts.get(c, 0)) for c in cols], "column string, outliers long")


def null_or_blank(df: DataFrame) -> DataFrame:
    """column, null_count: null, or blank as text."""
    one = df.agg(*[F.count_if(q(c).isNull() | (F.trim(q(c).cast("string")) == "")).alias(c) for c in df.columns])
    return one.unpivot([], [q(c) for c in df.columns], "column", "null_count")


def constant_columns(df: DataFrame) -> DataFrame:
    """column, n_distinct, is_constant (one distinct value)."""
    counts = distinct_counts(df, {c: q(c) for c in df.columns})
    return rows_frame(df.sparkSession, [(c, n, n == 1) for c, n in counts.items()], "column string, n_distinct long, is_constant boolean")


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, mean, median, std, skew (adjusted, as statistics packages give it), min, max."""
    cols = columns or numbers(df)
    fs = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "g1": F.skewness, "min": F.min, "max": F.max}
    s = stats_row(df, {(c, k): f(q(c).cast("double")) for c in cols for k, f in fs.items()})
    middle, rows = quantiles(df, {c: [0.5] for c in cols}), []
    for c in cols:
        n, g = s[c, "n"], s[c, "g1"]
        skew = g * (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 and g is not None and g == g else None
        rows.append((c, n, s[c, "mean"], middle[c][0] if middle[c] else None, s[c, "std"], skew, s[c, "min"], s[c, "max"]))
    return rows_frame(df.sparkSession, rows, "column string, n long, mean double, median double, std double, skew double, min double, max double")


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """value, n, share_pct of the k most frequent values of a column; ties by value."""
    n = df.where(q(column).isNotNull()).agg(F.count("*").alias("total"))
    counts = df.where(q(column).isNotNull()).groupBy(q(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
    total = n.first()[0]
    return counts.withColumn("share_pct", F.round(F.lit(100.0) * F.col("n") / F.lit(float(total or 1)), 4))


def mixed_types(df: DataFrame) -> DataFrame:
    """column, n_numeric, n_text of each string column's non-null values."""
    cols = strings(df)
    items = {(c, k): F.count_if(q(c).isNotNull() & (N.to_number(q(c)).isNotNull() == (k == "n"))) for c in cols for k in "nt"}
    s = stats_row(df, items)
    return rows_frame(df.sparkSession, [(c, s[c, "n"], s[c, "t"]) for c in cols], "column string, n_numeric long, n_text long")


def health(df: DataFrame) -> DataFrame:
    """One row: rows, missing cells, completeness, duplicates, outliers by quartiles, spelled-out nulls, issues in sum, rows
    without duplicates, columns by type."""
    c, d = completeness(df).first(), exact_duplicate_count(df).first()[0]
    o = sum(r["outliers"] for r in iqr_outliers(df).collect()) if numbers(df) else 0
    i = sum(r["invalid_count"] for r in invalid_literals(df).collect()) if strings(df) else 0
    row = (c["n_rows"], c["missing_cells"], c["completeness"], d, o, i, c["missing_cells"] + d + o + i, c["n_rows"] - d, len(numbers(df)), len(strings(df)), len(df.columns) - len(numbers(df)) - len(strings(df)))
    return rows_frame(df.sparkSession, [row], "n_rows long, missing_cells long, completeness double, duplicates long, outliers long, invalid_literals long, issues long, clean_rows long, numeric_columns int, text_columns int, other_columns int")


def describe(df: DataFrame) -> DataFrame:
    return df.summary()


def sample_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """n rows by the digest of their key: a spot check that anyone can repeat."""
    return df.orderBy(F.md5(q(key).cast("string").cast("binary")), q(key)).limit(n)


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n rows in an order."""
    return df.orderBy(*[q(c) for c in order]).limit(n)


def column_profile(df: DataFrame, order: list[str], samples: int = 8) -> DataFrame:
    """column, dtype, null_pct, n_unique, samples (of the first rows), min, max, mean, scripts (of the text values of the
    samples): what an advisor is told about a column."""
    base = {r["column"]: r for r in profile_columns(df).collect()}
    head = preview(df, order, samples).collect()
    ends = stats_row(df, {(c, k): f(q(c).cast("double")) for c in numbers(df) for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))})
    scripts = preview(df, order, samples).agg(*[F.array_sort(F.collect_set(X.script_of(q(c)))).alias(c) for c in strings(df)]).first() if strings(df) else {}
    rows = [(c, base[c]["dtype"], base[c]["null_pct"], base[c]["n_unique"], [str(r[c]) for r in head if r[c] is not None], ends.get((c, "min")), ends.get((c, "max")), ends.get((c, "mean")), list(scripts[c]) if c in strings(df) else []) for c in df.columns]
    return rows_frame(df.sparkSession, rows, "column string, dtype string, null_pct double, n_unique long, samples array<string>, min double, max double, mean double, scripts array<string>")
