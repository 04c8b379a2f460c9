"""What the operators of this subpackage share: written intermediates, skew-safe joins, bounded batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import counted, forget, scratch_path, shared_dir, written

__all__ = ["batches_of", "counted", "forget", "join_groups", "let", "partitions", "scratch_path", "settle", "shared_dir", "slices", "table", "together", "written"]

#: No more groups than this are ever broadcast by `join_groups`.
HEAVY_GROUPS = 10_000
#: A group with fewer rows than this is never treated as heavy.
HEAVY_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settle(spark: SparkSession) -> None:
    """Collects garbage of the driver's Python, then of its JVM. Spark's cleaner drops shuffles, broadcasts and plans only when
    their last reference is collected; a loop of many small jobs makes more of these than heap pressure ever sees."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def together(frames: list[DataFrame]) -> DataFrame:
    """All rows of written frames of one schema in one scan. A union has a scan for each, and Spark pushes semi-joins into all
    of them, so in a loop plans, and what the driver keeps of them, would grow with every turn."""
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*[df.written_to for df in frames])


@contextmanager
def batches_of(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """What runs inside gives Python Arrow batches of about most_bytes, where wide rows would fill Spark's 64 MB: executors hold a
    batch several times, on both sides. Rows and results are the same. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    small = before is not None and before.rstrip("bB").isdigit() and 0 < int(before.rstrip("bB")) <= most_bytes
    if not small:
        spark.conf.set(key, str(most_bytes))
    try:
        yield
    finally:
        if not small:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once and hands it to body, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, n_groups: int | None = None) -> DataFrame:
    """Inner join of rows with one row per key, safe for keys that hold a large part of the rows.

    groups[size] is the number of rows of the key. Keys above max(HEAVY_ROWS, n_rows / HEAVY_GROUPS) rows are joined by
    broadcast; as the sizes sum to n_rows there are at most HEAVY_GROUPS of them. All others go through a sort-merge join,
    where no task gets more than that many rows of one key. If there are no more than HEAVY_GROUPS keys at all, they are
    broadcast. Null keys match each other. n_groups: rows of groups, counted if not given; groups should then be a written
    table. Its rows must be narrow.
    """
    if (groups.count() if n_groups is None else n_groups) <= HEAVY_GROUPS:
        small = groups.withColumnRenamed(key, "_key")
        return rows.join(F.broadcast(small), rows[key].eqNullSafe(small["_key"]), "inner").drop("_key")
    limit = max(HEAVY_ROWS, n_rows // HEAVY_GROUPS)
    right = groups.withColumnRenamed(key, "_key")
    heavy, light = right.where(F.col(size) > limit), right.where(F.col(size) <= limit)
    hot = rows.join(F.broadcast(heavy), rows[key].eqNullSafe(heavy["_key"]), "inner")
    cold = rows.join(F.broadcast(heavy.select("_key")), rows[key].eqNullSafe(heavy["_key"]), "left_anti")
    cold = cold.join(light.hint("merge"), cold[key].eqNullSafe(light["_key"]), "inner")
    return hot.drop("_key").unionByName(cold.drop("_key"))


def slices(texts: list, most_chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of at most most_chars in sum; a longer text is a run of its own."""
    start = total = 0
    for i, x in enumerate(texts):
        n = len(x)
        if i > start and total + n > most_chars:
            yield start, i
            start, total = i, 0
        total += n
    if len(texts) > start:
        yield start, len(texts)
