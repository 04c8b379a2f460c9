"""Exact deduplication against a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest, in a folder that outlives the session. A batch of
documents is reduced to one row per digest by a grouped aggregate, joined to the index by a sort-merge anti-join, and what is
new is appended as the batch's own part of the index. The join needs no exchange of the index; Spark sorts what it reads of a
bucket, as a bucket has one sorted file for each batch until `compacted`. Only DataFrame operations; texts are read once and
never shuffled.

A batch's part is written whole under the batch's name, by Spark's commit (a staging folder, then renames), and a batch is
never compared with its own part. So a batch that is run again after a failure, at whatever point, gives the same rows and
replaces what it wrote.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import counted, forget, join_groups, partitions, scratch_path, together


def digest_of(text: Column) -> Column:
    """32 bytes; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class DigestIndex:
    """Digests of all texts seen so far: (digest binary, keep_id long, batch string), a part for each batch, each of `buckets`
    buckets sorted by digest.

    path: a folder all executors can write. An index that is there already is opened; buckets must then be as it was made.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            spark.catalog.recoverPartitions(self.name)

    def read(self, but: str | None = None) -> DataFrame:
        """All digests, without those of one batch."""
        rows = self.spark.table(self.name)
        return rows if but is None else rows.where(F.col("batch") != but)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Writes (digest, keep_id) as the batch's part, in place of what an earlier run of it left; a bucket is one file."""
        if not re.fullmatch(r"\w+", batch):
            raise ValueError("a batch's name is letters, digits and underscores")
        rows = groups.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        view = f"rows_{uuid.uuid4().hex[:12]}"
        rows.createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{batch}') SELECT digest, keep_id FROM {view}")
        self.spark.catalog.dropTempView(view)

    def compacted(self, path: str) -> DigestIndex:
        """A copy of the index in another folder, all batches in one part: one sorted file a bucket."""
        out = DigestIndex(self.spark, path, self.buckets)
        out.append(self.read(), "compacted")
        return out

    def close(self) -> None:
        """Forgets the name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicates a batch against the index and itself, and adds what is new to the index as the batch's part.

    Returns one row per row of docs: doc_id, keep_id, group_size (rows of this batch with the text), kept, text_sha256.
    keep_id is the index's if another batch had the text (then no row of this one is kept), else the batch's largest id. Of
    rows that repeat an id and text, one is kept. A null text equals the empty text; a null id sorts below all others and can
    be kept; very long texts are only hashed. An empty batch gives no rows. Other columns of docs play no part.

    batch: the batch's name; by default a digest of its ids and texts, so the same rows are the same batch, run again.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))
    return dedup_digests(rows, index, batch)


def dedup_digests(rows: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """exact_dedup() of rows (doc_id, digest)."""
    rows, seen = counted(rows.withColumn("row", F.monotonically_increasing_id()), "dedup-rows", sign=F.sum(F.xxhash64("doc_id", "digest").cast("decimal(38,0)")))
    batch = batch or f"b{seen['n']}_{seen.get('sign') or 0}".replace("-", "m")
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.max_by("row", order).alias("keep_row"), F.count("*").alias("group_size"))
    groups, _ = counted(groups.repartition(index.buckets, "digest").sortWithinPartitions("digest"), "dedup-groups")
    before = index.read(but=batch).select("digest", "keep_id")
    fresh, _ = counted(groups.join(before.select("digest").hint("merge"), "digest", "left_anti"), "dedup-fresh")
    known = groups.drop("keep_id", "keep_row").join(before.groupBy("digest").agg(F.max("keep_id").alias("keep_id")).hint("merge"), "digest").withColumn("keep_row", F.lit(None).cast("long"))
    decided, n_groups = counted(fresh.unionByName(known), "dedup-decided")
    index.append(fresh, batch)
    forget(groups, fresh)
    out = join_groups(rows, decided, "digest", "group_size", seen["n"], n_groups["n"])
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.coalesce("keep_row", F.lit(-1))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


#: Batches in which op1 feeds the index.
BATCHES = 3


def op1_exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of all rows, which enter a new index in BATCHES batches, the largest ids first:
    so a later batch's texts that the index has are dropped by its anti-join, and what stays of equal texts has the largest id.

    Texts are read and hashed once. Ids are cut at their approximate quantiles; a null id is in the last batch. Group sizes are
    of all batches. Odd inputs as in exact_dedup().
    """
    index = DigestIndex(spark, scratch_path(spark, "digest-index"), buckets=max(8, partitions(spark)))
    rows, seen = counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest")), "dedup-digests")
    cuts = rows.agg(F.percentile_approx("doc_id", [1 - (i + 1) / BATCHES for i in range(BATCHES - 1)])).first()[0] or []
    cuts, found, top = sorted(set(cuts), reverse=True), [], F.lit(True)
    for i in range(len(cuts) + 1):
        low = F.col("doc_id") >= cuts[i] if i < len(cuts) else F.lit(True)
        part = rows.where(low & top) if i < len(cuts) else rows.where(F.coalesce(top, F.lit(True)))
        found.append(counted(dedup_digests(part, index, f"part{i}").select("doc_id", "keep_id", "kept", F.unhex("text_sha256").alias("digest")), "dedup-part")[0])
        top = F.col("doc_id") < cuts[i] if i < len(cuts) else top
    forget(rows)
    every = together(found)
    sizes, n_sizes = counted(every.groupBy("digest").agg(F.count("*").alias("group_size")), "dedup-sizes")
    out = join_groups(every, sizes, "digest", "group_size", seen["n"], n_sizes["n"])
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
