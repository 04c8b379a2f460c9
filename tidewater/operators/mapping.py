"""Rewrites by distinct value: map the distinct values once, join the map back."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import fuzzy
from ..functions import text as X
from .shared import forget, numbered, q, written
from .similar import not_independent, similar_pairs

#: Maps with at most this many values are broadcast when joined back.
MOST_BROADCAST = 50_000
#: Names in the first batch of name_clusters.
BATCH = 2_048


def apply_map(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """df with column's values replaced by mapping (original, clean); values that the map lacks stay. mapping is counted: it
    is broadcast if it is small, else joined as Spark sees fit."""
    m = mapping.select(F.col("original").alias("_original"), F.col("clean").alias("_clean"))
    small = m.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    out = df.join(F.broadcast(m) if small else m, F.trim(q(column)) == F.col("_original"), "left")
    return out.select(*[F.coalesce("_clean", q(c)).alias(c) if c == column else q(c) for c in df.columns])


def _distinct(df: DataFrame, column: str) -> DataFrame:
    v = F.trim(q(column))
    return df.where(v.isNotNull() & ~v.isin("", "nan", "None", "<NA>")).select(v.alias("original")).distinct()


def categorical_map(df: DataFrame, column: str, translate: Callable[[list[str]], dict[str, str]] | None = None, chunk: int = 25) -> DataFrame:
    """(original, clean): ASCII values in title case, or upper for acronyms, values that differ by case alone being one;
    others by `translate`, which gets distinct values in chunks, else unchanged."""
    values = _distinct(df, column)
    low = F.lower(F.col("original"))
    plain = values.where(~X.has_non_ascii(F.col("original"))).select("original", F.when(F.upper("original").isin(list(K.MAPPING_ACRONYMS)), F.upper("original")).otherwise(X.title_case(low)).alias("clean"))
    return plain.unionByName(_translated(values, translate, chunk))


def name_map(df: DataFrame, column: str, translate: Callable[[list[str]], dict[str, str]] | None = None, chunk: int = 25) -> DataFrame:
    """(original, clean): ASCII names with single spaces in title case; others by `translate`, by default without accents."""
    values = _distinct(df, column)
    plain = values.where(~X.has_non_ascii(F.col("original"))).select("original", X.title_case(F.regexp_replace("original", r"\s+", " ")).alias("clean"))
    return plain.unionByName(_translated(values, translate or without_accents, chunk))


def without_accents(names: list[str]) -> dict[str, str]:
    """Offline transliteration: compatibility decomposition without marks; letters it can't resolve stay."""
    return {n: "".join(ch for ch in unicodedata.normalize("NFKD", n) if not unicodedata.combining(ch)) for n in names}


def _translated(values: DataFrame, translate: Callable[[list[str]], dict[str, str]] | None, chunk: int) -> DataFrame:
    rest = values.where(X.has_non_ascii(F.col("original")))
    if translate is None:
        return rest.select("original", F.col("original").alias("clean"))

    def run(frames):
        import pandas as pd

        for pdf in frames:
            found: dict[str, str] = {}
            items = pdf["original"].tolist()
            for i in range(0, len(items), chunk):
                found |= translate(items[i : i + chunk])
            yield pd.DataFrame({"original": items, "clean": [found.get(x, x) for x in items]})

    return rest.mapInPandas(run, "original string, clean string")


def typo_map(df: DataFrame, column: str, most: int = 100, least: int = 3, threshold: float = 85.0) -> DataFrame:
    """(original, clean): with at most `most` distinct values, each value seen less than `least` times goes to the frequent
    value with the highest token-sort similarity, if that reaches the threshold; ties go to the more frequent, then the
    lesser. Values are compared in standard case."""
    counts = written(df.select(X.standard_case(q(column)).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n")), "typo-counts")
    nothing = df.sparkSession.createDataFrame([], "original string, clean string")
    if counts.limit(most + 1).count() > most:
        return nothing
    rare, frequent = counts.where(F.col("n") < least).select(F.col("v").alias("original")), counts.where(F.col("n") >= least)
    # at most `most` values on either side
    pairs = rare.join(F.broadcast(frequent), F.length("v") > 0).withColumn("score", fuzzy.token_sort_udf("original", "v"))
    best = pairs.where(F.col("score") >= threshold).groupBy("original").agg(F.min_by("v", F.struct(-F.col("score"), -F.col("n"), "v")).alias("clean"))
    return best


def standardize_case(df: DataFrame, column: str) -> DataFrame:
    """Standard case, then typo correction."""
    cased = df.select(*[X.standard_case(q(c)).alias(c) if c == column else q(c) for c in df.columns])
    return apply_map(cased, column, typo_map(df, column))


def name_clusters(df: DataFrame, column: str, threshold: float = 80.0) -> DataFrame:
    """(name, canonical): names in sorted order open clusters; each later name joins the first open one whose opening name it
    resembles (token sort). The canonical name is the most frequent, then the longest, then the least.

    The sequential result, without a sequence: names are numbered in order and taken in batches, each as large as all before it.
    A batch is first joined with the openers so far, by similarity; only what resembles none of them is joined with itself, and
    the openers among it are the first independent set of that graph. No name and no pair reaches the driver. A cluster of very
    many names costs its size once it has an opener; only its names in the batch that opens it meet each other.
    """
    spark = df.sparkSession
    names = df.where(q(column).isNotNull()).groupBy(q(column).alias("name")).agg(F.count("*").alias("n"))
    names = written(names.withColumn("key", fuzzy.token_sort_key(F.lower("name"))), "names")
    # names of one key share a cluster: each resembles what the others do
    keys = written(numbered(names.groupBy("key").agg(F.min("name").alias("first")), ["first"], "id"), "name-keys")
    total, start, size = keys.count(), 0, BATCH
    openers, found = [], []
    schema = "id long, cluster long"
    at = lambda frames: spark.read.schema(frames[0].schema).parquet(*[f.written_to for f in frames])
    while start < total:
        batch = keys.where((F.col("id") >= start) & (F.col("id") < start + size)).select("id", "key")
        if openers:
            covered = similar_pairs(batch, at(openers), threshold)
            found.append(written(covered.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("cluster")), "name-found"))
            forget(covered)
            batch = written(batch.join(found[-1].select("id").hint("merge"), "id", "left_anti"), "name-batch")
        edges = similar_pairs(batch, None, threshold)
        joined = not_independent(edges)
        new = written(batch.join(joined.hint("merge"), "id", "left_anti"), "name-openers")
        openers.append(new)
        found.append(written(new.select("id", F.col("id").alias("cluster")), "name-found"))
        links = edges.join(new.select(F.col("id").alias("a")).hint("merge"), "a", "left_semi").join(joined.select(F.col("id").alias("b")).hint("merge"), "b", "left_semi")
        found.append(written(links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("cluster")), "name-found"))
        forget(edges, joined)
        start, size = start + size, max(size, start + size)
    if not found:
        return names.select("name", F.col("name").alias("canonical"))
    of = keys.select("id", "key").join(spark.read.schema(schema).parquet(*[f.written_to for f in found]).hint("merge"), "id").select("key", "cluster")
    members = written(names.join(of.hint("merge"), "key").select("name", "n", "cluster"), "name-members")
    best = written(members.groupBy("cluster").agg(F.min_by("name", F.struct(-F.col("n"), -F.length("name"), "name")).alias("canonical")), "name-canonical")
    small = best.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    forget(names, keys, *openers, *found)
    return members.join(F.broadcast(best) if small else best, "cluster").select("name", "canonical")


def resolve_names(df: DataFrame, column: str, threshold: float = 80.0) -> DataFrame:
    """df with each name replaced by its cluster's."""
    m = name_clusters(df, column, threshold).select(F.trim("name").alias("original"), F.col("canonical").alias("clean")).dropDuplicates(["original"])
    return apply_map(df, column, m)


def lookup(column: Column, table: dict[str, str]) -> Column:
    """A small literal map; null for what it lacks."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)


__all__ = ["apply_map", "categorical_map", "lookup", "name_clusters", "name_map", "resolve_names", "standardize_case", "typo_map", "without_accents"]
