"""Profiles of growing tables: sketches of each part are kept, so new data is read alone and merged with what is known.

A part is one aggregate over its rows: counts, nulls, least and greatest values, sums, a HyperLogLog sketch of the values and a
quantile sketch of the numbers. Sketches merge without loss beyond their own error, whatever the order of parts. A part that is added
again under its name replaces itself, so a job that failed half way runs again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .profile import missing
from .shared import numbers, q

#: Registers of a distinct-count sketch are 2 to this power: a relative error of about 1.04 / 2 ** 6.
HLL_BITS = 12
#: Size of a quantile sketch: ranks are off by less than 1 % of the rows.
KLL_SIZE = 400


class ProfileStore:
    """Sketches of a table's parts in a folder that all executors can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, df: DataFrame, part: str) -> None:
        """Reads df once and keeps its sketches under the part's name."""
        if not re.fullmatch(r"\w+", part):
            raise ValueError("a part's name is letters, digits and underscores")
        each = []
        numeric = set(numbers(df))
        for f in df.schema:
            value = F.when(~missing(q(f.name), f.dataType), q(f.name))
            text, number = value.cast("string"), value.cast("double") if f.name in numeric else F.lit(None).cast("double")
            known = F.count(value)
            each.append(
                F.struct(
                    F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.count("*").alias("n_rows"), (F.count("*") - known).alias("null_count"),
                    F.min(number).alias("low"), F.max(number).alias("high"), F.min(F.when(F.lit(f.name not in numeric), text)).alias("first"), F.max(F.when(F.lit(f.name not in numeric), text)).alias("last"),
                    F.sum(number).alias("total"), F.sum(number * number).alias("squares"), F.when(known > 0, F.hll_sketch_agg(text, HLL_BITS)).alias("values"),
                    (F.when(known > 0, F.kll_sketch_agg_double(number, KLL_SIZE)) if f.name in numeric else F.lit(None).cast("binary")).alias("numbers"),
                )
            )
        # a row a column
        df.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/part={part}")

    def merged(self) -> DataFrame:
        """A row for each column of all parts: sums of counts, merged sketches. Columns that came later count no rows before."""
        rows = self.spark.read.parquet(self.path)
        return rows.groupBy("column").agg(
            F.max("dtype").alias("dtype"), F.sum("n_rows").alias("n_rows"), F.sum("null_count").alias("null_count"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"),
            F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.hll_union_agg("values").alias("values"), F.kll_merge_agg_double("numbers").alias("numbers"),
        )

    def profile(self, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
        """column, dtype, n_rows, null_count, null_pct, n_unique (estimate), low, high, mean, std, first, last (of texts), quantiles."""
        known = F.col("n_rows") - F.col("null_count")
        mean = F.try_divide("total", known)
        spread = F.try_divide(F.col("squares") - F.col("total") * mean, known - 1)
        ranks: Column = F.when((known > 0) & F.col("low").isNotNull(), F.array(*[F.kll_sketch_get_quantile_double("numbers", F.lit(p)) for p in quantiles]))
        return self.merged().select(
            "column", "dtype", "n_rows", "null_count", F.round(F.coalesce(F.try_divide(F.col("null_count") * 100.0, F.col("n_rows")), F.lit(0.0)), 4).alias("null_pct"),
            F.when(known > 0, F.hll_sketch_estimate("values")).otherwise(0).alias("n_unique"), "low", "high", mean.alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std"), "first", "last", ranks.alias("quantiles"),
        )
