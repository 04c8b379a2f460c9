"""Exact similarity joins of short strings by the ratio of their longest common subsequence.

A ratio of t means a common subsequence of at least t / 200 of both lengths, so two such strings share at least as many
characters, counted with repeats. Characters are put in one order, the rare ones first. If two strings share that many, then
the beginnings of both, in that order, share at least `level` of them: strings are joined where such beginnings hold the same
`level` characters, and compared. The filter loses nothing, and a beginning holds few characters if t is high.

Classes of characters, not characters, are counted: 4,096 classes by code point. Equal characters are of one class, so shared
classes are never fewer, and the table of frequencies has a fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from .shared import forget, written

CLASSES, REPEATS = 4_096, 16
#: Characters that the beginnings of two strings must share.
LEVEL = 3


def tokens(key: str) -> list[int]:
    """A number for each character: its class and how many of the class come before it."""
    seen: dict[int, int] = {}
    out = []
    for ch in key:
        c = ord(ch) % CLASSES
        k = seen.get(c, 0)
        seen[c] = k + 1
        out.append(c + CLASSES * k)
    return out


def levels(size: int, threshold: float, level: int = LEVEL) -> dict[int, int]:
    """{level: characters of the beginning} by which a string of this size meets all those that may reach the threshold.

    Of strings of sizes m and n the longest common subsequence has at least t (m + n) / 200 characters, and m and n at most:
    that bounds n. Where so few are needed that `level` can't be asked for, all of them are.
    """
    if not size:
        return {}
    least = {}
    for n in range(math.ceil(size * threshold / (200 - threshold) - 1e-9), math.floor(size * (200 - threshold) / threshold + 1e-9) + 1):
        need = max(1, math.ceil(threshold * (size + n) / 200 - 1e-9))
        if need <= min(size, n):
            v = min(level, need)
            least[v] = min(least.get(v, need), need)
    return {v: size - need + v for v, need in least.items()}


def frequencies(keys: DataFrame) -> np.ndarray:
    """How often each token is there, of the first REPEATS of a class: a table of a fixed size, counted in tasks and added up."""
    size = CLASSES * REPEATS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                np.add.at(n, [t for t in tokens(key or "") if t < size], 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["token", "n"])

    out = np.zeros(size, np.int64)
    for r in keys.select("key").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r["token"]] = r["n"]
    return out


def _signed(rows: DataFrame, shared, threshold: float, level: int) -> DataFrame:
    """A row for each set of characters under which a string is looked up: (by, id, key, begin, sign)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size = shared.value, CLASSES * REPEATS
        known: dict[int, dict[int, int]] = {}
        for batch in batches:
            at, begins, signs = [], [], []
            for i, key in enumerate(batch.column(2).to_pylist()):
                found = sorted(tokens(key), key=lambda t: (int(n[t]) if t < size else 0, t))
                for v, length in known.setdefault(len(key), levels(len(key), threshold, level)).items():
                    begin = found[:length]
                    for sign in combinations(begin, v):
                        at.append(i)
                        begins.append(begin)
                        signs.append(list(sign))
                    if len(at) > 50_000:
                        yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(at, pa.int64())) for j in range(3)), pa.array(begins, pa.list_(pa.int32())), pa.array(signs, pa.list_(pa.int32()))], ["by", "id", "key", "begin", "sign"])
                        at, begins, signs = [], [], []
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(at, pa.int64())) for j in range(3)), pa.array(begins, pa.list_(pa.int32())), pa.array(signs, pa.list_(pa.int32()))], ["by", "id", "key", "begin", "sign"])

    return rows.select("by", "id", "key").mapInArrow(run, "by string, id long, key string, begin array<int>, sign array<int>")


def similar_pairs(left: DataFrame, right: DataFrame | None, threshold: float, level: int = LEVEL) -> DataFrame:
    """(by, a, b, ratio): all pairs of an id of left and an id of right, with the same `by`, whose keys' ratio reaches the threshold.

    Frames have id (long), key (string) and, if wanted, by (string); without by all rows meet. Without right, left meets itself,
    and a < b. Ids differ within a frame and a `by`. Exact for every threshold above 0: nothing is dropped. Empty keys resemble
    nothing; null keys are left out. The join is a plain equi-join that Spark splits where it is skewed; a pair that meets in
    several ways is compared at the first of its level only.
    """
    one = lambda df: df.where("key IS NOT NULL").select((F.col("by") if "by" in df.columns else F.lit("")).alias("by"), F.col("id").cast("long").alias("id"), "key")
    rows = one(left)
    order = frequencies(rows if right is None else rows.unionByName(one(right)))
    shared = left.sparkSession.sparkContext.broadcast(order)  # CLASSES x REPEATS counts
    side = lambda df, p: df.select("by", "sign", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "key", "begin")])
    mine = written(_signed(rows, shared, threshold, level), "similar-left")
    other = mine if right is None else written(_signed(one(right), shared, threshold, level), "similar-right")
    both = side(mine, "a").join(side(other, "b").hint("merge"), ["by", "sign"])
    if right is None:
        both = both.where("a_id < b_id")
    m, n = F.length("a_key"), F.length("b_key")
    need = F.greatest(F.lit(1), F.ceil(threshold * (m + n) / 200 - 1e-9))
    near = (need <= F.least(m, n)) & (F.size("sign") == F.least(F.lit(level), need)) & (F.slice(F.array_intersect("a_begin", "b_begin"), 1, F.size("sign")) == F.col("sign"))
    found = both.where(near).select("by", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_key", "b_key")
    found = found.withColumn("ratio", fuzzy.ratio_udf("a_key", "b_key")).where(F.col("ratio") >= threshold).select("by", "a", "b", "ratio")
    out = written(found, "similar")
    forget(mine, *([other] if right is not None else []))
    return out


def not_independent(edges: DataFrame) -> DataFrame:
    """(id) of the nodes of edges (a < b) outside the first independent set: taking nodes in order, one is in the set unless a
    smaller neighbour is.

    The sequential result, found in rounds: nodes without undecided smaller neighbours are in, their larger neighbours are out,
    and edges of decided nodes go. Rounds grow with the longest chain of neighbours in which each decides the next.
    """
    now, out = written(edges.select("a", "b"), "independent-edges"), []
    while not now.isEmpty():
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(0).alias("waits")), F.struct(F.col("b").alias("id"), F.lit(1).alias("waits")))).alias("x")).select("x.*")
        new = written(ends.groupBy("id").agg(F.max("waits").alias("waits")).where("waits = 0").select("id"), "independent-in")
        met = written(now.join(new.select(F.col("id").alias("a")).hint("merge"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "independent-out")
        gone = new.union(met)
        kept = written(now.join(gone.select(F.col("id").alias("a")).hint("merge"), "a", "left_anti").join(met.select(F.col("id").alias("b")).hint("merge"), "b", "left_anti").select("a", "b"), "independent-edges")
        out.append(met)
        forget(now, new)
        now = kept
    if not out:
        return edges.select(F.col("a").alias("id")).limit(0)
    found = written(edges.sparkSession.read.schema(out[0].schema).parquet(*[f.written_to for f in out]), "independent-none")
    forget(now, *out)
    return found
