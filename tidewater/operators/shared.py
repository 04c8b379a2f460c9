"""What operators share: written intermediates, one-row statistics, order over all partitions."""

from __future__ import annotations

import math
import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master gets a folder of its own;
    a cluster raises, as no executor would see another's local files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, safe from lost executors, with short lineage, fixed ids and order of
    files. `forget` removes it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def counted(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """written(), and its row count `n` and other measures, taken while it is written: no further job."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in measures.items()]), name)
    return out, {"n": 0} | {k: v for k, v in (seen.get or {}).items() if k != "n" or v}


def forget(*frames: DataFrame) -> None:
    """Removes the files of written frames that nothing reads any more. Others are left alone."""
    for df in frames:
        if path := getattr(df, "written_to", None):
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context.hadoopConfiguration()).delete(at, True)


def strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numbers(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def q(name: str) -> Column:
    """Column of any name."""
    return F.col("`" + name.replace("`", "``") + "`")


def stats_row(df: DataFrame, items: dict[str, Column]) -> dict:
    """All aggregates of a stage in one job: name -> value."""
    if not items:
        return {}
    keys = list(items)
    row = df.agg(*[items[k].alias(f"s{i}") for i, k in enumerate(keys)]).first()
    return dict(zip(keys, row, strict=True))


#: Columns with more different values than this, by estimate, are counted in parts; and values of such columns to a part.
FEW_VALUES, PART_VALUES = 10_000, 500_000


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    """Exact numbers of different values that aren't null, by name; -0.0 is 0.0.

    One row a value and column, as many aggregates in one expand every row by the number of columns, each as wide as the table,
    and one task's part of them grows with the table. An estimate tells the two ways apart, which give the same numbers: columns
    of few values are combined before they are shuffled; the others are dealt first, over parts that grow in number with the
    rows, so that no task holds more than PART_VALUES or so.
    """
    if not values:
        return {}
    names = list(values)
    wide = {T.ByteType: "long", T.ShortType: "long", T.IntegerType: "long", T.FloatType: "double"}
    kinds = df.select(*[values[c].alias(f"v{i}") for i, c in enumerate(names)]).schema
    cast = [values[c].cast(wide.get(type(f.dataType), f.dataType)) for c, f in zip(names, kinds, strict=True)]
    cast = [v + F.lit(0.0) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else v for v, f in zip(cast, kinds, strict=True)]
    about = stats_row(df, {"n": F.count("*")} | {(i,): F.approx_count_distinct(v) for i, v in enumerate(cast)})
    groups: dict[tuple[str, bool], list[int]] = {}
    for i, (v, f) in enumerate(zip(cast, df.select(*[v.alias(f"v{i}") for i, v in enumerate(cast)]).schema, strict=True)):
        groups.setdefault((f.dataType.json(), about[i,] > FEW_VALUES), []).append(i)
    found = None
    for (_, many), members in groups.items():
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), cast[i].alias("v")) for i in members])).alias("x")).select("x.i", "x.v").where("v IS NOT NULL")
        if many:
            rows = rows.repartition(max(1, -(-about["n"] * len(members) // PART_VALUES)), "i", "v")
        each = rows.groupBy("i", "v").agg(F.lit(1)).groupBy("i").agg(F.count("*").alias("n"))
        found = each if found is None else found.unionAll(each)
    counts = {r["i"]: r["n"] for r in found.collect()}
    return {c: counts.get(i, 0) for i, c in enumerate(names)}


def rows_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-side result as a DataFrame."""
    return spark.createDataFrame(rows, schema)


def numbered(df: DataFrame, order: list[str], name: str = "_rid") -> DataFrame:
    """df with consecutive numbers from 0 in the given order. Sorted by ranges over all partitions: only the row count of
    each partition reaches the driver."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *[q(c) for c in order]).sortWithinPartitions(*[q(c) for c in order]).withColumn(name, F.monotonically_increasing_id())
    placed = written(placed, "numbered")
    part = F.shiftright(name, 33)
    counts = sorted(placed.groupBy(part.alias("p")).count().collect())
    if not counts:
        return placed
    before = zip([r[0] for r in counts], accumulate([0, *(r[1] for r in counts)]), strict=False)
    offsets = spark.createDataFrame(list(before), "_number_part long, _number_from long")  # one row a partition
    out = placed.join(F.broadcast(offsets), part == F.col("_number_part"))
    return out.select(*[q(c) for c in placed.columns if c != name], (F.col("_number_from") + F.col(name).bitwiseAND((1 << 33) - 1)).alias(name))


def quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float] | None]:
    """Exact quantiles of numeric columns, between neighbours by linear interpolation; None for a column without values.

    Values of all columns are counted, dealt by ranges and sorted, so no task holds a column; counts by range reach the driver,
    which finds the ranges that hold the ranks wanted, and then the values at those.
    """
    spark, cols = df.sparkSession, list(wanted)
    if not cols:
        return {}
    one = F.array(*[F.struct(F.lit(i).alias("c"), q(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    counts = df.select(F.explode(one).alias("x")).select("x.c", "x.v").where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    dealt = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "c", "v").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "quantile-counts")
    sizes = sorted(dealt.groupBy("c", "part").agg(F.sum("n").alias("n")).collect())
    total = {i: sum(r["n"] for r in sizes if r["c"] == i) for i in range(len(cols))}
    places = {(i, p): p * (total[i] - 1) for i, c in enumerate(cols) for p in wanted[c] if total[i]}
    ranks = {i: sorted({int(f(x)) for (j, _), x in places.items() if j == i for f in (math.floor, math.ceil)}) for i in total}
    before, targets = dict.fromkeys(total, 0), []
    for c, part, n in sizes:
        if inside := [r for r in ranks[c] if before[c] <= r < before[c] + n]:
            targets.append((c, part, before[c], inside))
        before[c] += n
    if not targets:
        return dict.fromkeys(cols)
    found = dealt.join(F.broadcast(spark.createDataFrame(targets, "c int, part int, before long, ranks array<long>")), ["c", "part"])  # a few rows a column
    upto = F.sum("n").over(Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    hits = found.withColumn("upto", upto).select("c", "v", F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("r"))
    at = {(r["c"], r["r"]): r["v"] for r in hits.collect()}
    forget(dealt)

    def value(i: int, p: float) -> float:
        x = places[i, p]
        low, high = at[i, math.floor(x)], at[i, math.ceil(x)]
        return low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high

    return {c: [value(i, p) for p in wanted[c]] if total[i] else None for i, c in enumerate(cols)}


def carried(df: DataFrame, columns: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """For each column c the nearest non-null values before and after each row, itself included: c_prev, c_next, and their
    places c_prev_at, c_next_at (numbers in _rid).

    With `by`, order holds within each group. Without, rows are dealt by ranges of the order, windows stay inside a range,
    and one value a range and column is carried over on the driver.
    """
    place = numbered(df, order) if not by else df.withColumn("_rid", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)
    spark = df.sparkSession
    if by:
        keys, base = by, place
    else:
        size = max(1, -(-place.count() // max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
        base, keys = place.withColumn("_part", F.floor(F.col("_rid") / size)), ["_part"]
    # both frames begin unbounded, so each is one pass over its rows
    before = Window.partitionBy(*keys).orderBy("_rid").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc("_rid")).rowsBetween(Window.unboundedPreceding, 0)
    known = {c: F.when(q(c).isNotNull(), F.struct(q(c).alias("v"), F.col("_rid").alias("at"))) for c in columns}
    out = base.select("*", *[x for c in columns for x in (F.last(known[c], True).over(before).alias(f"{c}_p"), F.last(known[c], True).over(after).alias(f"{c}_n"))])
    if not by:
        ends = base.groupBy("_part").agg(*[x for c in columns for x in (F.max_by(known[c], F.when(q(c).isNotNull(), F.col("_rid"))).alias(f"{c}_l"), F.min_by(known[c], F.when(q(c).isNotNull(), F.col("_rid"))).alias(f"{c}_f"))])
        rows = sorted(ends.collect(), key=lambda r: r["_part"])
        carry = {r["_part"]: {} for r in rows}
        for c in columns:
            for ordered, end, to in ((rows, "l", "cp"), (rows[::-1], "f", "cn")):
                held = None
                for r in ordered:
                    carry[r["_part"]][f"{c}_{to}"] = held
                    held = r[f"{c}_{end}"] or held
        kinds = T.StructType([T.StructField("_part", T.LongType()), *[T.StructField(f"{c}_{k}", ends.schema[f"{c}_l"].dataType) for c in columns for k in ("cp", "cn")]])
        carried_ = spark.createDataFrame([(p, *(x[f.name] for f in kinds.fields[1:])) for p, x in carry.items()], kinds)  # one row a range
        out = out.join(F.broadcast(carried_), "_part", "left").drop("_part")
        for c in columns:
            out = out.withColumn(f"{c}_p", F.coalesce(f"{c}_p", f"{c}_cp")).withColumn(f"{c}_n", F.coalesce(f"{c}_n", f"{c}_cn")).drop(f"{c}_cp", f"{c}_cn")
    parts = [x for c in columns for x in (F.col(f"{c}_p.v").alias(f"{c}_prev"), F.col(f"{c}_p.at").alias(f"{c}_prev_at"), F.col(f"{c}_n.v").alias(f"{c}_next"), F.col(f"{c}_n.at").alias(f"{c}_next_at"))]
    return out.select(*[q(c) for c in df.columns], "_rid", *parts)
