"""Importance resampling towards a target distribution of hashed word features.

Every document becomes a bag of bucket numbers, two bytes a word, written once; all later passes read bags, not texts. Counts of
buckets over both tables give a bucket's gain, an array of a fixed size; a document's weight is the sum of the array at its
buckets. A score adds noise from a hash of the id, so drawing the highest scores is a weighted draw without replacement.

The cutoff comes from an exact histogram of the integer scores: counts by score, added up from the highest score down, tell how
many documents lie above each score. Only documents at or above the cutoff are dealt by ranges, numbered by doc_id within their
score, and ranked from the score's offset. No task or driver holds all scores; a score that very many documents share is dealt
over several ranges.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import counted, forget, partitions, slices, written

BUCKETS = 10_000
#: Words whose buckets a task remembers at a time; only speed depends on it.
REMEMBERED = 500_000
#: Bytes of words: digits, letters and all beyond ASCII; A-Z become a-z, all else a space.
_WORD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


class Hasher:
    """Bucket numbers of a text's features: runs of 1 to n_grams consecutive words joined by one space."""

    def __init__(self, buckets: int, n_grams: int):
        if not 0 < buckets <= 65_536:
            raise ValueError("buckets: 1 to 65536")
        self.buckets, self.n_grams, self.known = buckets, n_grams, {}

    def bags(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets of all texts one after another, features by text, words by text)."""
        found, n_features, n_words, known = [], [], [], self.known
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []
            features = list(words)
            for n in range(2, self.n_grams + 1):
                features += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(features).difference(known):
                known[w] = zlib.crc32(w) % self.buckets
            found.append(np.fromiter(map(known.__getitem__, features), np.uint16, len(features)))
            n_features.append(len(features))
            n_words.append(len(words))
        return np.concatenate([*found, np.zeros(0, np.uint16)]), np.array(n_features, np.int64), np.array(n_words, np.int64)


def bags(texts: DataFrame, id_col: str | None, text_col: str = "text", buckets: int = BUCKETS, n_grams: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, bag binary) of every row; null texts have empty bags. bag: uint16, little-endian. Without
    id_col doc_id is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets, n_grams)
        for batch in batches:
            ids, all_texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices([x or "" for x in all_texts]):
                flat, sizes, words = hasher.bags(all_texts[a:b])
                ends = np.r_[0, np.cumsum(sizes * 2)].astype(np.int64)
                raw = flat.astype("<u2").tobytes()
                bag = pa.array([raw[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(words), pa.array(sizes), bag], ["doc_id", "n_words", "n_features", "bag"])

    key = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return texts.select(key.alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, "doc_id long, n_words long, n_features long, bag binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket: a task counts its own, Spark adds up, `buckets` totals at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for bag in batch.column(0):
                n += np.bincount(np.frombuffer(bag.as_buffer() or b"", "<u2"), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("bag").where("n_features > 0").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """rows with weight instead of their bags: the sum of gains at the bag's buckets."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # one long a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            weight = np.zeros(len(sizes), np.int64)
            if sizes.sum():
                full = np.flatnonzero(sizes)
                starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
                bag = batch.column(3)
                flat = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in (bag[i] for i in full.tolist())])
                weight[full] = np.add.reduceat(g[flat], starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return rows.select("doc_id", "n_words", "n_features", "bag").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def above(scores: DataFrame) -> DataFrame:
    """(score, n, above) of scores (score, n), one row a score: above is the sum of n over all higher scores.

    Scores are dealt by ranges from the highest down; sums stay inside a range, and one total a range goes over the driver.
    """
    spark = scores.sparkSession
    dealt = written(scores.repartitionByRange(partitions(spark), F.desc("score")).withColumn("part", F.spark_partition_id()), "score-ranges")
    totals = sorted(dealt.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before = list(zip([r[0] for r in totals], accumulate([0, *(r[1] for r in totals)]), strict=False))
    offsets = spark.createDataFrame(before, "part int, before long")  # a row a range
    upto = F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    out = written(dealt.withColumn("upto", upto - F.col("n")).join(F.broadcast(offsets), "part").select("score", "n", (F.col("before") + F.col("upto")).alias("above")), "score-offsets")
    forget(dealt)
    return out


def drawn(scored: DataFrame, draws: int) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of the `draws` highest scores, ties by doc_id (null last); rank from 1."""
    spark = scored.sparkSession
    offsets = above(scored.groupBy("score").agg(F.count("*").alias("n")))
    cutoff = offsets.where(F.col("above") < draws).agg(F.min("score")).first()[0]
    over = scored.where(F.lit(False) if cutoff is None else F.col("score") >= cutoff)
    # equal ids are ordered by what else tells rows apart, then by where they were read: rows alike in all get ranks in any order
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    over = over.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id())
    over = written(over, "survivors")
    parts = over.groupBy("score", "part").agg(F.count("*").alias("m"))
    ahead = F.coalesce(F.sum("m").over(Window.partitionBy("score").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a score has at most as many rows here as there are ranges
    starts = parts.withColumn("ahead", ahead).join(offsets.where(F.lit(False) if cutoff is None else F.col("score") >= cutoff).hint("merge"), "score").select("score", "part", (F.col("above") + F.col("ahead")).alias("start"))
    place = F.row_number().over(Window.partitionBy("score", "part").orderBy(*order[1:]))
    out = over.withColumn("place", place).join(starts.hint("merge"), ["score", "part"]).withColumn("rank", (F.col("start") + F.col("place")).cast("long"))
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= draws, F.col("rank")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, buckets: int = BUCKETS, n_grams: int = 1, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document: rank 1, 2, ... of those drawn, null for the others.

    Of the N documents of at least least_words words, floor(share * N) are drawn. A null or empty text has no features, weight
    0 and isn't drawn (if least_words > 0); very long texts are read whole; equal scores go to the smaller doc_id, rows alike
    in id and features are drawn one by one. A null id hashes like an empty one and comes after all others; repeated rows count
    each. An empty table gives no rows; an empty target makes common words weigh little. Other columns play no part.
    """
    rows = written(bags(docs, id_col, text_col, buckets, n_grams), "bags")
    wanted = written(bags(target, None, target_col, buckets, n_grams), "target-bags")
    gain = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000.0 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    eligible = F.col("n_words") >= least_words
    scored = weighted(rows, gain).select("doc_id", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), eligible.alias("eligible"))
    scored, seen = counted(scored, "scored", able=F.count_if("eligible"))
    forget(rows, wanted)
    draws = share[0] * (seen.get("able") or 0) // share[1]
    able = scored.where("eligible").drop("eligible")
    if not draws:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    top = written(drawn(able, draws), "drawn")
    cutoff = top.agg(F.min("score")).first()[0]
    rest = scored.where(~F.col("eligible") | (F.col("score") < cutoff)).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return top.unionByName(rest)


def op12_resampling(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """resample() of all documents towards all benchmark texts. Odd inputs as there."""
    return resample(docs, benchmark)


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(encode(w))) // 2), lambda j: CAST('0x' || substr(hex(encode(w)), 2 * j + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, table_of[(xor(c, b) & 255) + 1]))"
_BIT = "list_transform({0}, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)"


def _table() -> str:
    out = "range(256)"
    for _ in range(8):
        out = _BIT.format(out)
    return out


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH crc AS MATERIALIZED (SELECT {_table()} AS table_of),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
dw AS MATERIALIZED (SELECT r, unnest(ws) AS w FROM d), bw AS MATERIALIZED (SELECT unnest({_WORDS}) AS w FROM benchmark),
k AS MATERIALIZED (SELECT w, xor({_CRC}, 4294967295::BIGINT) % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
n AS (SELECT b, sum(s) AS s, sum(t) AS t FROM (SELECT b, count(*) AS s, 0 AS t FROM dw JOIN k ON dw.w = k.w GROUP BY b UNION ALL SELECT b, 0, count(*) FROM bw JOIN k ON bw.w = k.w GROUP BY b) GROUP BY b),
g AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM n) + {BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM n) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain FROM n),
x AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN k ON dw.w = k.w JOIN g ON k.b = g.b GROUP BY r),
s AS (SELECT doc_id, coalesce(len(ws), 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN x ON d.r = x.r),
o AS (SELECT *, n_features >= 20 AS able FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS i FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND i <= 10 * (SELECT count(*) FROM o WHERE able) // 100 THEN i END AS rank FROM p
"""
