"""The audit trail as a DataFrame, and what reports take from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Audit, ColumnSchema
from .shared import q

CHANGES = "step_number int, step string, column string, original string, cleaned string, n long, example string"
SCHEMA = "step string, step_number int, column string, task string, original string, cleaned string, explanation string, severity string"


def trail(spark: SparkSession, audit: Audit) -> DataFrame:
    return spark.createDataFrame(audit.entries, SCHEMA)


def by_step(entries: DataFrame) -> DataFrame:
    """step_number, step, entries, changes (severity change, fix or remove)."""
    return entries.groupBy("step_number", "step").agg(F.count("*").alias("entries"), F.count_if(F.col("severity").isin("change", "fix", "remove")).alias("changes"))


def distinct_changes(entries: DataFrame) -> DataFrame:
    """The first entry of each (original, cleaned)."""
    w = Window.partitionBy("original", "cleaned").orderBy("step_number", "column", "task")
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cell_changes(before: DataFrame, after: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """(key columns, column, original, cleaned): every cell that differs between two states of a table, as text; rows are told by
    their key, and those that only one state has are left out (see row_changes).

    One join of the two by key; nulls are alike, and text and null differ. columns: by default those of both but the key.
    """
    both = columns or [c for c in before.columns if c in after.columns and c not in key]
    left = before.select(*[q(c).alias(f"_k{i}") for i, c in enumerate(key)], *[q(c).cast("string").alias(f"_b{i}") for i, c in enumerate(both)])
    right = after.select(*[q(c).alias(f"_j{i}") for i, c in enumerate(key)], *[q(c).cast("string").alias(f"_a{i}") for i, c in enumerate(both)])
    met = left.join(right, reduce(Column.__and__, (F.col(f"_k{i}").eqNullSafe(F.col(f"_j{i}")) for i in range(len(key)))))
    cells = F.array_compact(F.array(*[F.when(~F.col(f"_b{i}").eqNullSafe(F.col(f"_a{i}")), F.struct(F.lit(c).alias("column"), F.col(f"_b{i}").alias("original"), F.col(f"_a{i}").alias("cleaned"))) for i, c in enumerate(both)]))
    return met.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(key)], F.explode(cells).alias("_x")).select(*[q(c) for c in key], "_x.*")


def row_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """removed, added: how many rows' keys only one of two states has."""
    sides = before.select(*[q(c) for c in key], F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionAll(after.select(*[q(c) for c in key], F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    each = sides.groupBy(*[q(c) for c in key]).agg(F.sum("_b").alias("_b"), F.sum("_a").alias("_a"))
    return each.agg(F.coalesce(F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))), F.lit(0)).alias("removed"), F.coalesce(F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))), F.lit(0)).alias("added"))


def change_counts(before: DataFrame, after: DataFrame, key: list[str], step_number: int, step: str, columns: list[str] | None = None) -> DataFrame:
    """step_number, step, column, original, cleaned, n, example: each different change of a stage, how many cells it changed, and
    the least key of them. Counts are combined before they are shuffled, so what is changed everywhere is one row a task."""
    cells = cell_changes(before, after, key, columns)
    example = F.min(F.concat_ws(",", *[q(c).cast("string") for c in key])).alias("example") if len(key) > 1 else F.min(q(key[0])).cast("string").alias("example")
    return cells.groupBy("column", "original", "cleaned").agg(F.count("*").alias("n"), example).select(F.lit(step_number).alias("step_number"), F.lit(step).alias("step"), "column", "original", "cleaned", "n", "example")


def column_totals(changes: DataFrame) -> DataFrame:
    """step_number, step, column, cells (changed), kinds (different changes), emptied (cells that became null), filled (cells that were null)."""
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return changes.groupBy("step_number", "step", "column").agg(F.sum("n").alias("cells"), F.count("*").alias("kinds"), count(F.col("cleaned").isNull()).alias("emptied"), count(F.col("original").isNull()).alias("filled"))


def top_changes(changes: DataFrame, k: int = 5, salt: int = 64) -> DataFrame:
    """The k most frequent changes of each step and column, with place; ties by original, then cleaned (nulls first).

    A column with very many different changes is first cut to k in each of `salt` parts, so no task ranks all of them.
    """
    order = [F.desc("n"), F.asc_nulls_first("original"), F.asc_nulls_first("cleaned")]
    part = F.pmod(F.xxhash64("original", "cleaned"), F.lit(salt))
    few = changes.withColumn("_s", part).withColumn("_p", F.row_number().over(Window.partitionBy("step_number", "step", "column", "_s").orderBy(*order))).where(F.col("_p") <= k)
    return few.withColumn("place", F.row_number().over(Window.partitionBy("step_number", "step", "column").orderBy(*order))).where(F.col("place") <= k).drop("_s", "_p")


def type_histogram(spark: SparkSession, schema: dict[str, ColumnSchema]) -> DataFrame:
    rows = [(s.semantic_type,) for s in schema.values()]
    return spark.createDataFrame(rows, "semantic_type string").groupBy("semantic_type").agg(F.count("*").alias("n"))


def top_domains(scores: DataFrame, k: int = 5) -> DataFrame:
    return scores.orderBy(F.desc("score"), "domain").limit(k)


def merge_totals(report: DataFrame) -> DataFrame:
    """clusters, merged_rows (rows beyond the first) of a cluster report."""
    return report.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("cluster_size") - 1), F.lit(0)).alias("merged_rows"))


def markdown(metadata: dict, entries: list[tuple]) -> str:
    """A report of a run: figures, then entries by step."""
    lines = ["# Cleaning report", "", *(f"- {k}: {v}" for k, v in metadata.items() if not isinstance(v, (dict, list)))]
    step = None
    for s, n, column, task, original, cleaned, explanation, severity in entries:
        if s != step:
            lines += ["", f"## {n}. {s}", ""]
            step = s
        change = f" `{original}` -> `{cleaned}`" if original or cleaned else ""
        lines.append(f"- [{severity}] {column or 'table'}: {task}{change} {explanation}".rstrip())
    return "\n".join(lines) + "\n"
