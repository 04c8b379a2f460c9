"""Clusters vectors around centroids by exact integers, screened by float32 matrix products.

Vectors become integers, floor(scale * x), and are written once. A round gives every vector its nearest centroid and replaces
each centroid by the floor of its vectors' mean. Distances to all centroids come from one float32 matrix product a block, each
with an interval that provably holds the true value; a centroid whose interval lies above another's end is out. Where more than
one is left, and only there, distances are computed in exact integers, and equal ones go to the lowest number.

A task sums its own vectors by cluster, Spark adds the sums, and k x (dims + 1) totals reach the driver: k and dims are
parameters, so that is a bound. No vector is shuffled, and a vector that a third of the table repeats is work like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import counted, forget, written

#: Components up to this size have squared distances that a 64-bit integer holds (64 dims: below 2 ** 60); others are computed
#: with Python's integers.
NARROW = 2**26
#: Elements of a block's matrix of distances, and pairs computed exactly at a time.
BLOCK, PAIRS = 2**21, 2**14
LIMB = 32


class Screen:
    """Finds the nearest of a set of centroids (lists of integers), exactly."""

    def __init__(self, centroids: list[list[int]]):
        self.exact, self.dims = centroids, len(centroids[0])
        self.wide = np.array([max(map(abs, c)) > NARROW for c in centroids])
        self.doubles = np.array([[float(x) for x in c] for c in centroids])
        self.ints = np.where(self.wide[:, None], 0, self.doubles).astype(np.int64)
        self.singles = self.ints.astype(np.float32)
        self.squares = (self.ints * self.ints).sum(1).astype(np.float64)
        self.norms = np.sqrt(self.squares) * (1 + 2.0**-40)

    def intervals(self, v: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of each vector's squared distance to each centroid, less the vector's own square.

        Float32 has the unit roundoff u = 2^-24. A product of two rounded inputs, summed in any order, with or without fused
        steps, is off by at most g = m u / (1 - m u) times the sum of |v_i c_i|, m = dims + 2, and that sum is at most |v| |c|.
        What doubles add is below 2^-50 of the terms. Integers of this size neither overflow nor vanish in float32.
        """
        squares = (v * v).sum(1)
        norms = np.sqrt(squares) * (1 + 2.0**-40)
        m = (self.dims + 2) * 2.0**-24
        both = norms[:, None] * self.norms[None, :]
        about = self.squares[None, :] - 2.0 * (np.where(wide[:, None], 0, v).astype(np.float32) @ self.singles.T).astype(np.float64)
        off = 2.0 * (m / (1 - m)) * both + 2.0**-50 * (self.squares[None, :] + 2.0 * both)
        low, high = about - off, about + off
        for rows, cols in ((np.flatnonzero(wide), np.arange(len(self.exact))), (np.flatnonzero(~wide), np.flatnonzero(self.wide))):
            for c in cols if len(rows) else ():  # beyond NARROW: a sum of squares in doubles is right to (dims + 4) 2^-53 of itself
                d = ((v[rows] - self.doubles[c]) ** 2).sum(1)
                off1 = (d + squares[rows]) * ((self.dims + 8) * 2.0**-52)
                low[rows, c], high[rows, c] = d - squares[rows] - off1, d - squares[rows] + off1
        return low, high

    def distances(self, v: np.ndarray, wide: np.ndarray, c: np.ndarray) -> list[int] | np.ndarray:
        """Squared distance of each vector to its centroid, exact."""
        if not (wide.any() or self.wide[c].any()):
            gap = v.astype(np.int64) - self.ints[c]
            return (gap * gap).sum(1)
        return np.array([sum((int(x) - y) ** 2 for x, y in zip(row, self.exact[k], strict=True)) for row, k in zip(v.tolist(), c.tolist(), strict=True)], object)

    def nearest(self, v: np.ndarray) -> np.ndarray:
        """Numbers of the nearest centroids of the rows of v (integers as doubles)."""
        out, step = np.empty(len(v), np.int64), max(1, BLOCK // len(self.exact))
        for at in range(0, len(v), step):
            part = v[at : at + step]
            wide = np.abs(part).max(1, initial=0) > NARROW
            low, high = self.intervals(part, wide)
            left = low <= high.min(1)[:, None]
            found = left.argmax(1)
            open_rows = np.flatnonzero(left.sum(1) > 1)
            size = max(1, PAIRS // len(self.exact))
            for i in range(0, len(open_rows), size):
                rows = open_rows[i : i + size]
                r, c = np.nonzero(left[rows])
                d = self.distances(part[rows[r]], wide[rows[r]], c)
                starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                best = np.minimum.reduceat(d, starts)
                same = d == np.repeat(best, np.diff(np.r_[starts, len(r)]))
                found[rows] = np.minimum.reduceat(np.where(same, c, len(self.exact)), starts)
            out[at : at + step] = found
        return out


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def prepared(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: float = 1024.0) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of all vectors with exactly dims components, none null or non-finite."""
    v, x = F.col(vec_col).cast("array<double>"), f"`{vec_col}`"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.floor(scale * matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), dims).cast(pa.list_(pa.float64()))], ["vec_id", "v"])

    rows = vectors.where((F.size(F.col(vec_col)) == dims) & F.expr(f"forall({x}, x -> x IS NOT NULL AND abs(double(x)) < double('infinity'))")).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.mapInArrow(run, "vec_id long, v array<double>")


def seeds(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of `<salt>:<vec_id>`, in its order; equal ids by components; null ids last."""
    first = rows.select(F.coalesce(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256), F.lit("~")).alias("h"), "v").orderBy("h", "v").limit(k)
    return [[int(x) for x in r["v"]] for r in first.collect()]


def _limbs(total: int) -> list[tuple[int, int]]:
    """(place, part): total = the sum of part * 2 ** (LIMB * place), parts that a long holds in sums of 2 ** 31 rows at least."""
    out, sign, place = [], -1 if total < 0 else 1, 0
    total = abs(total)
    while total:
        out.append((place, sign * (total & (2**LIMB - 1))))
        total, place = total >> LIMB, place + 1
    return out


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floors of their vectors' means; one without vectors stays."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, k = Screen(centroids), len(centroids)
        sums, sizes, big = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), {}
        for batch in batches:
            v = matrix(batch.column(0), dims)
            c = screen.nearest(v)
            sizes += np.bincount(c, minlength=k)
            wide = np.abs(v).max(1, initial=0) > NARROW
            for j in np.unique(c[~wide]).tolist():
                sums[j] += v[~wide & (c == j)].astype(np.int64).sum(0)
            for row, j in zip(v[wide].tolist(), c[wide].tolist(), strict=True):
                for i, x in enumerate(row):
                    big[j, i] = big.get((j, i), 0) + int(x)
        out = [(j, -1, 0, int(n)) for j, n in enumerate(sizes) if n]
        out += [(j, i, p, x) for j in range(k) for i in range(dims) for p, x in _limbs(int(sums[j, i]) + big.get((j, i), 0))]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "i", "place", "part"])

    parts = rows.select("v").mapInArrow(run, "cluster int, i int, place int, part long")
    totals = parts.groupBy("cluster", "i", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    sums: dict[tuple[int, int], int] = {}
    for r in totals.collect():  # k x (dims + 1) places of a few limbs
        sums[r["cluster"], r["i"]] = sums.get((r["cluster"], r["i"]), 0) + (int(r["s"]) << (LIMB * r["place"]))
    return [[sums.get((j, i), 0) // sums[j, -1] for i in range(dims)] if (j, -1) in sums else c for j, c in enumerate(centroids)]


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance): distance is null where a long can't hold it."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for batch in batches:
            v = matrix(batch.column(1), dims)
            c = screen.nearest(v)
            wide = np.abs(v).max(1, initial=0) > NARROW
            d = [x if x < 2**63 else None for x in screen.distances(v, wide, c).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


@dataclass(frozen=True)
class Clusters:
    """centroids: lists of integers by number. rows: a written table (vec_id, cluster, distance)."""

    centroids: list[list[int]]
    rows: DataFrame


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, salt: str = "3", id_col: str = "vec_id", vec_col: str = "embedding") -> Clusters:
    """Clusters the vectors of exactly dims components, none null or non-finite; others have no row.

    Vectors with fewer than k rows in all give as many centroids as rows; an empty table gives none, and no rows. Equal
    distances go to the lower number, so of equal centroids the later ones stay empty, and as they are. Repeated rows count and
    are returned each; a null id is a row like others, and a seed only if ids run out; other columns play no part. It ends
    before `rounds` when a round moves nothing, as the next ones would move nothing either. Components may be as large as
    doubles are.
    """
    rows, seen = counted(prepared(vectors, id_col, vec_col, dims, scale), "vectors")
    if not seen["n"]:
        return Clusters([], written(rows.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), "clusters"))
    now = seeds(rows, k, salt)
    for _ in range(rounds):
        new = moved(rows, now)
        if new == now:
            break
        now = new
    out = written(assigned(rows, now), "clusters")
    forget(rows)
    return Clusters(now, out)


def op11_centroids(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector kept: 8 centroids, 10 rounds.
    Nulls, ties, repeats, empty tables and other columns as in cluster(); a sum that a long can't hold is null."""
    found = cluster(vectors)
    sums = {r["cluster"]: r for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()}
    fits = lambda x: x if x is not None and x < 2**63 else None
    each = {c: None if r["lost"] else int(r["s"]) for c, r in sums.items()}
    whole = None if None in each.values() else sum(each.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    by = [(c, fits(x), fits(whole), digest(found.centroids[c])) for c, x in each.items()]
    info = vectors.sparkSession.createDataFrame(by, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return found.rows.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3") -> str:
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, unnest(range({dims})) AS i, unnest(v) AS x FROM v)",
        f"c0 AS MATERIALIZED (SELECT n, unnest(range({dims})) AS i, unnest(v) AS x FROM (SELECT v, row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) - 1 AS n FROM v) WHERE n < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(n, struct_pack(d := d, n := n)) AS n, min(d) AS d FROM (SELECT r, c.n, sum((p.x - c.x) * (p.x - c.x)) AS d FROM p JOIN c{i} c ON p.i = c.i GROUP BY r, c.n) GROUP BY r)")
        if i < rounds:
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT n, i, CAST((s - ((s % k) + k) % k) // k AS BIGINT) AS x FROM (SELECT a.n, p.i, sum(p.x) AS s, count(*) AS k FROM a{i} a JOIN p ON a.r = p.r GROUP BY a.n, p.i) UNION ALL SELECT n, i, x FROM c{i} WHERE n NOT IN (SELECT n FROM a{i}))")
    return (
        f"WITH {', '.join(parts)}, s AS (SELECT n, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY n) "
        f"SELECT v.vec_id, CAST(a.n AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, s.centroid_sha256 FROM a{rounds} a JOIN v ON a.r = v.r JOIN s ON a.n = s.n"
    )


ORACLE = _sql()
