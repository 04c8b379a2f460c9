"""Exact k-nearest-neighbour imputation of numeric columns.

The distance of two rows is Euclidean over the columns that both have, scaled up by the share of columns that is; a gap becomes
the mean of the column in the k nearest rows that have it. Every row with a value can give it, and none is left out.

Rows are reduced to distinct vectors with their counts, and dealt into cells: rows that have the same columns, in a box of a
tree whose splits come from a bounded sample. Each gap first meets the nearest cells that hold k donors; the k-th distance found
is a radius, and only cells whose box begins within it are met after that. A box is nearer than anything in it, in doubles too, as rounding
keeps order: so nothing nearer is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import replace
from .shared import forget, q, stats_row, written

#: Distinct vectors that split the tree; leaves at most, and vectors a leaf is made for; gaps that meet a cell in one task.
SAMPLE, MOST_LEAVES, LEAF, GAPS = 20_000, 4_096, 2_048, 20_000


class Tree:
    """Splits of vectors at medians, of the widest column first. A missing value goes the way of the median."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.middle = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in sample.T])
        sample = np.where(np.isnan(sample), self.middle, sample)
        self.column, self.at, self.low, self.high, self.n = [], [], [], [], 0
        self._split(sample, leaves)

    def _split(self, rows: np.ndarray, leaves: int) -> int:
        """Number of the node; leaves are negative."""
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(len(self.middle))
        if leaves < 2 or not spread.max():
            self.n += 1
            return -self.n
        c = int(spread.argmax())
        cut = float(np.median(rows[:, c]))
        cut = cut if (rows[:, c] < cut).any() else float(np.nextafter(cut, np.inf))
        node = len(self.column)
        self.column.append(c), self.at.append(cut), self.low.append(0), self.high.append(0)
        left = rows[:, c] < cut
        self.low[node] = self._split(rows[left], leaves // 2)
        self.high[node] = self._split(rows[~left], leaves - leaves // 2)
        return node

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers from 0."""
        x = np.where(np.isnan(x), self.middle, x)
        at = np.zeros(len(x), np.int64) if self.column else np.full(len(x), -1)
        column, cut, low, high = (np.array(v) for v in (self.column, self.at, self.low, self.high))
        while (todo := np.flatnonzero(at >= 0)).size:
            node = at[todo]
            at[todo] = np.where(x[todo, column[node]] < cut[node], low[node], high[node])
        return -at - 1


def _bits(x: np.ndarray) -> np.ndarray:
    return (~np.isnan(x)) @ (1 << np.arange(x.shape[1], dtype=np.int64))


class Boxes:
    """Cells with the least and greatest value of each column, and how far they are from vectors."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray):
        self.cells, self.low, self.high, self.n = cells, low, high, n
        self.there = ~np.isnan(low)

    def distances(self, x: np.ndarray, f: int) -> np.ndarray:
        """(vectors, cells): least squared distance to what a cell can hold; infinite where it can't give column f."""
        total, common = np.zeros((len(x), len(self.cells))), np.zeros((len(x), len(self.cells)), np.int64)
        for c in range(x.shape[1]):
            both = ~np.isnan(x[:, c, None]) & self.there[None, :, c]
            gap = np.maximum(np.maximum(self.low[None, :, c] - x[:, c, None], x[:, c, None] - self.high[None, :, c]), 0.0)
            total += np.where(both, gap * gap, 0.0)
            common += both
        return np.where((common > 0) & self.there[None, :, f], total * x.shape[1] / np.maximum(common, 1), np.inf)


def _asks(boxes: Boxes, k: int, d: int, second: bool):
    """Rows (r, f, v, cell): for each gap the nearest cells that hold k donors; or, with what those gave (found: the k-th
    distance, null if there are fewer than k), the others within it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                x, fs = np.array(part["v"].tolist(), float).reshape(-1, d), part["f"].to_numpy()
                rows, cells = [], []
                for f in np.unique(fs):
                    mine = np.flatnonzero(fs == f)
                    far = boxes.distances(x[mine], int(f))
                    order = np.argsort(far, axis=1, kind="stable")
                    sorted_far = np.take_along_axis(far, order, 1)
                    before = np.cumsum(boxes.n[order], axis=1) - boxes.n[order]
                    first = np.isfinite(sorted_far) & (before < k)
                    if second:
                        radius = part["found"].fillna(np.inf).to_numpy(float)[mine]
                        first = np.isfinite(sorted_far) & ~first & (sorted_far <= radius[:, None])
                    i, j = np.nonzero(first)
                    rows.append(mine[i])
                    cells.append(boxes.cells[order[i, j]])
                rows = np.concatenate(rows) if rows else np.zeros(0, int)
                out = part.iloc[rows][["r", "f", "v"]]
                yield out.assign(cell=np.concatenate(cells) if cells else np.zeros(0, np.int64))

    return run


def _met(k: int, d: int):
    """The k nearest donors of each gap in one cell: (r, f, near): pairs of squared distance and value, a donor as often as it is there."""

    def run(asks: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(donors):
            x, y, n = np.array(asks["v"].tolist(), float).reshape(-1, d), np.array(donors["v"].tolist(), float).reshape(-1, d), donors["n"].to_numpy()
            fs, step = asks["f"].to_numpy(), max(1, 2_000_000 // len(y))
            for at in range(0, len(x), step):
                part = x[at : at + step]
                total, common = np.zeros((len(part), len(y))), np.zeros((len(part), len(y)), np.int64)
                for c in range(d):
                    both = ~np.isnan(part[:, c, None]) & ~np.isnan(y[None, :, c])
                    gap = np.where(both, part[:, c, None] - y[None, :, c], 0.0)
                    total += gap * gap
                    common += both
                far = np.where(common > 0, total * d / np.maximum(common, 1), np.inf)
                for i in range(len(part)):
                    values, own = y[:, fs[at + i]], far[i]
                    m = min(k, len(own)) - 1
                    close = np.flatnonzero(own <= np.partition(own, m)[m])
                    close = close[np.isfinite(own[close])]
                    close = close[np.lexsort((values[close], own[close]))]
                    close = np.repeat(close, np.minimum(n[close], k))[:k]
                    out.append((int(asks["r"].iat[at + i]), int(fs[at + i]), [{"d": float(own[j]), "v": float(values[j])} for j in close]))
        return pd.DataFrame(out, columns=["r", "f", "near"])

    return run


def _meet(asks: DataFrame, donors: DataFrame, k: int, d: int) -> DataFrame:
    """(r, f, near) by cell. A cell that very many gaps ask is copied to a task for each GAPS of them."""
    sizes = asks.groupBy("cell").agg(F.ceil(F.count("*") / GAPS).cast("int").alias("copies"))
    left = asks.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("r", "f"), F.col("copies")).cast("int")).select("cell", "part", "r", "f", "v")
    right = donors.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), "v", "n")
    return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInPandas(_met(k, d), "r long, f int, near array<struct<d: double, v: double>>")


def _vector(columns: list[str]) -> Column:
    return F.array(*[F.when(~F.isnan(q(c).cast("double")), q(c).cast("double")) for c in columns])


def knn(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """df with the gaps (null or NaN) of numeric columns filled, as doubles: the mean of the column in the k nearest rows that have it.

    Distances by what both rows have, in the columns' own units; of equal distances the lesser value goes first. A row with
    nothing in these columns, or none in common with any donor, gets the column's mean; a column without values stays empty.
    All rows count and give, repeated ones as often as they are there; an empty table stays so. At most 40 columns.
    """
    d, vec = len(columns), _vector(columns)
    if d > 40:
        raise ValueError("at most 40 columns")
    keyed = df.withColumn("_vec", vec)
    there = F.exists("_vec", lambda x: x.isNotNull())
    donors = written(keyed.where(there).groupBy(F.col("_vec").alias("v")).agg(F.count("*").alias("n")), "knn-donors")
    total = donors.count()
    gaps = donors.where(F.exists("v", lambda x: x.isNull())).select(F.monotonically_increasing_id().alias("r"), "v")
    gaps = written(gaps, "knn-gaps")
    if not total or gaps.isEmpty():
        return replace(df, {c: q(c).cast("double") for c in columns})
    sample = np.array([r["v"] for r in donors.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()], float)
    tree = Tree(sample, max(1, min(MOST_LEAVES, total // LEAF)))
    leaves = tree.n

    @F.pandas_udf("long")
    def cell_of(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), float).reshape(-1, d)
        return pd.Series(_bits(x) * leaves + tree.leaf(x))

    donors = written(donors.withColumn("cell", cell_of("v")), "knn-cells")
    # a row for each leaf and set of columns that rows have
    edges = donors.groupBy("cell").agg(F.sum("n").alias("n"), *[F.min(F.get("v", F.lit(i))).alias(f"low{i}") for i in range(d)], *[F.max(F.get("v", F.lit(i))).alias(f"high{i}") for i in range(d)]).toPandas()
    side = lambda s: edges[[f"{s}{i}" for i in range(d)]].to_numpy(float)
    boxes = Boxes(edges["cell"].to_numpy(), side("low"), side("high"), edges["n"].to_numpy())
    places = F.array(*[F.when(F.get("v", F.lit(i)).isNull(), i) for i in range(d)])
    each = gaps.select("r", "v", F.explode(F.array_compact(places)).alias("f")).select("r", "f", "v")
    asks = "r long, f int, v array<double>, cell long"
    first = written(_meet(each.mapInPandas(_asks(boxes, k, d, False), asks), donors, k, d), "knn-first")
    near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    kth = first.groupBy("r", "f").agg(near.alias("near")).select("r", "f", F.when(F.size("near") == k, F.element_at("near", -1)["d"]).alias("found"))
    more = _meet(each.join(kth, ["r", "f"], "left").select("r", "f", "v", "found").mapInPandas(_asks(boxes, k, d, True), asks), donors, k, d)
    # a gap has k pairs a cell it met, and cells are bounded
    best = first.union(written(more, "knn-more")).groupBy("r", "f").agg(near.alias("near")).where(F.size("near") > 0)
    value = F.aggregate("near", F.lit(0.0), lambda s, x: s + x["v"]) / F.size("near")
    fills = best.select("r", F.struct("f", value.alias("value")).alias("fill")).groupBy("r").agg(F.map_from_entries(F.collect_list("fill")).alias("fills"))
    key = lambda v: F.md5(F.to_json(v, {"ignoreNullFields": "false"}))
    fills = written(gaps.join(fills, "r").select(key("v").alias("_key"), "fills"), "knn-fills")
    means = stats_row(df, {c: F.avg(F.when(~F.isnan(q(c).cast("double")), q(c).cast("double"))) for c in columns})
    out = keyed.withColumn("_key", key("_vec")).join(fills.hint("merge"), "_key", "left")
    filled = lambda i, c: F.coalesce(F.get("_vec", F.lit(i)), F.try_element_at("fills", F.lit(i)), F.lit(means[c]).cast("double")).alias(c)
    forget(gaps, first)
    return out.select(*[filled(columns.index(c), c) if c in columns else q(c) for c in df.columns])
