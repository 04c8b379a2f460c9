"""Connected components by alternating large-star and small-star steps, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import counted, forget


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _round(edges: DataFrame) -> DataFrame:
    """Large star, then small star. Minima are combined before they are shuffled; the joins back are plain sort-merge joins of
    narrow rows, so Spark's skew join splits a node with very many edges, and no round leaves broadcasts on the driver."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = _clean(both.join(least.hint("merge"), "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")))
    down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _clean(down.join(least.hint("merge"), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))))


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, label) of every node of the edges (a, b long): label is the least node of its component.

    Self-links and repeated edges are allowed; an empty table gives no rows. A round is written once, with a digest of its
    edges; it ends when a round changes nothing, and raises if that takes more than most_rounds.
    """
    digest = {"digest": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now, before = counted(_clean(edges), "edges", **digest)
    for _ in range(most_rounds if before["n"] else 0):
        new, after = counted(_round(now), "stars", **digest)
        forget(now)
        now = new
        if after == before:
            break
        before = after
    else:
        if before["n"]:
            raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, label) of all links so far: `labels` were made of earlier ones. Only links between different components
    are looked at, as links of components, so what is done isn't done again."""
    if labels is None:
        return counted(components(links), "labels")[0]
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    met = links.join(of("a").hint("merge"), "a", "left").join(of("b").hint("merge"), "b", "left")
    roots = components(met.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    nodes = labels.union(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("label")))
    roots = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
    return counted(nodes.join(roots.hint("merge"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")[0]
