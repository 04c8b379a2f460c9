"""Deduplication and entity resolution with guarded merge rules and golden records.

Rows are nodes. Candidate pairs come from equal identifiers; a rule expression says merge, block or skip for each pair; verified
pairs make clusters by connected components; a cluster becomes a golden record, or enriches its rows. Everything is a join, an
expression or a grouped aggregate; only name similarity runs in Python, in Arrow batches, over candidate pairs.

Clusters are those of all pairs, whatever number of rows shares an identifier. Rows alike in all that rules look at are one
profile. Few profiles under an identifier are all paired; many meet by an exact similarity join of their names, and by what
else they must agree in, through one representative each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import constants as K
from ..functions import fuzzy
from ..functions import text as X
from .classify import Tiers, tiers
from .graph import components
from .impute import sensitive
from .profile import primary_like
from .shared import numbered, numbers, q, written
from .similar import similar_pairs

#: Identifiers with up to so many profiles have all of them paired; those with up to MANY_PROFILES are looked at one by one, in
#: one row each; the others meet by joins. All ways give the same clusters.
FEW_PROFILES, MANY_PROFILES = 6, 128
#: Similarities of names that a worker remembers.
KNOWN_NAMES = 500_000
MASTER_DOMAINS = ("Retail", "Finance", "Healthcare", "Education", "HR", "CRM", "Insurance", "Government", "Real Estate")


def _compatible(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """No column differs that both have."""
    return all(x == y or not x or not y for x, y in zip(a, b, strict=True))


def is_master_data(intent: str, domain: str) -> bool:
    """Business data, and domains about persons, get one row per cluster; others keep all rows, enriched."""
    return intent == "Non-Predictive Business" or domain in MASTER_DOMAINS


def resolve_intent(intent: str, t: Tiers) -> str:
    if intent and intent != "Auto-Detect":
        return intent
    return "Non-Predictive Business" if t.gov or t.email or t.phone or t.name else "Predictive"


def low_quality(df: DataFrame, t: Tiers) -> DataFrame:
    """Rows without any valid identifier, contact or address; none if there are no such columns."""
    if not t.contacts:
        return df.limit(0)
    return df.where(~reduce(Column.__or__, (X.is_valid(q(c)) for c in t.contacts)))


def completeness(df: DataFrame) -> Column:
    return reduce(Column.__add__, (q(c).isNotNull().cast("int") for c in df.columns if c != "_rid"), F.lit(0))


def full_pairs(df: DataFrame, key: str, most: int = 500) -> DataFrame:
    """(rid_a, rid_b) of all pairs of rows with a key, for small tables only: more than `most` rows raise an error."""
    rows = df.where(X.is_valid(q(key))).select("_rid")
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: use sorted_neighbourhood")
    a, b = rows.select(F.col("_rid").alias("rid_a")), rows.select(F.col("_rid").alias("rid_b"))
    return a.join(F.broadcast(b), F.col("rid_a") < F.col("rid_b"))


def sorted_neighbourhood(df: DataFrame, key: str, window: int = 11, block: str | None = None) -> DataFrame:
    """(rid_a, rid_b): rows whose keys are at most (window - 1) / 2 places apart among the distinct keys in sorted order (of
    their block); rows with the same key are each paired with the first of them, which also stands for them elsewhere.

    Distinct keys are numbered over all partitions, each number is joined with the numbers before it: equi-joins only.
    """
    fields = [F.lit("").alias("block") if block is None else X.dedup_key(q(block)).alias("block"), X.dedup_key(q(key)).alias("key"), F.col("_rid")]
    rows = written(df.select(*fields).where("key != ''"), "neighbour-rows")
    first = rows.groupBy("block", "key").agg(F.min("_rid").alias("first"))
    ranked = numbered(first, ["block", "key"], "rank")
    ahead = ranked.select("block", F.col("first").alias("a"), F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + (window - 1) // 2)).alias("rank"))
    near = ahead.join(ranked.select("block", "rank", F.col("first").alias("b")), ["block", "rank"]).select("a", "b")
    same = rows.join(first, ["block", "key"]).where("_rid != first").select(F.col("first").alias("a"), F.col("_rid").alias("b"))
    return near.union(same).select(F.least("a", "b").alias("rid_a"), F.greatest("a", "b").alias("rid_b")).distinct()


def star_pairs(df: DataFrame, columns: list[str], normal=X.dedup_key) -> DataFrame:
    """(rid_a, rid_b): of rows with the same valid value in all columns, the most complete (then first) with each other."""
    keys = [normal(q(c)).alias(f"_k{i}") for i, c in enumerate(columns)]
    rows = df.select("_rid", completeness(df).alias("_c"), *keys)
    rows = rows.where(reduce(Column.__and__, (F.col(f"_k{i}") != "" for i in range(len(columns)))))
    names = [f"_k{i}" for i in range(len(columns))]
    top = rows.groupBy(*names).agg(F.min_by("_rid", F.struct(-F.col("_c"), F.col("_rid"))).alias("rid_a"), F.count("*").alias("_n")).where("_n > 1")
    return rows.join(top, names).where("_rid != rid_a").select("rid_a", F.col("_rid").alias("rid_b"))


@dataclass(frozen=True)
class Engine:
    """Deduplication of a table with `_rid`."""

    tiers: Tiers
    config: Config = Config()

    def facts(self, df: DataFrame) -> DataFrame:
        """What the rules need of each row: _rid, name (first valid), gov, email, phone, address (arrays of normal values)."""
        t = self.tiers
        arr = lambda cols, f: (F.array(*[f(q(c)) for c in cols]) if cols else F.array().cast("array<string>"))
        name = F.coalesce(*[F.nullif(X.dedup_key(q(c)), F.lit("")) for c in t.name]) if t.name else F.lit(None).cast("string")
        return df.select("_rid", name.alias("name"), arr(t.gov + t.other, X.dedup_key).alias("gov"), arr(t.email, X.dedup_key).alias("email"), arr(t.phone, X.dedup_phone).alias("phone"), arr(t.address, X.dedup_key).alias("address"))

    def candidates(self, facts: DataFrame) -> DataFrame:
        """(rid_a, rid_b): pairs whose links make the same clusters as the links of all pairs of rows.

        Every link needs an equal identifier. Rows with equal facts are each paired with their first, which stands for them.
        """
        keys = ["name", "gov", "email", "phone", "address"]
        rows = written(facts.withColumn("profile", F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)), "dedup-rows")
        first = written(rows.groupBy("profile").agg(F.min("_rid").alias("pid"), *[F.first(k).alias(k) for k in keys]), "dedup-profiles")
        copies = rows.select("_rid", "profile").join(first.select("profile", "pid").hint("merge"), "profile").where("_rid != pid").select(F.col("pid").alias("a"), F.col("_rid").alias("b"))
        kinds = ("gov", "email", "phone") if self.tiers.name else ("gov",)
        tagged = lambda k: F.transform(F.filter(F.col(k), lambda x: x != ""), lambda x: F.concat(F.lit(f"{k}:"), x))
        ids = F.concat(*map(tagged, kinds))
        # rows without a name link to nothing, if there are names at all
        named = first.where("name IS NOT NULL") if self.tiers.name else first
        values = F.concat(F.col("gov"), F.col("email"), F.col("phone"))
        entries = written(named.select(F.explode(F.array_distinct(ids)).alias("id"), "pid", F.coalesce("name", F.lit("")).alias("name"), values.alias("values")), "dedup-entries")
        pairs = self.paired(entries)
        return written(copies.union(pairs).select(F.least("a", "b").alias("rid_a"), F.greatest("a", "b").alias("rid_b")).distinct(), "dedup-candidates")

    def paired(self, entries: DataFrame) -> DataFrame:
        """(a, b): pairs that connect what may link under the identifiers of entries (id, pid, name, values), a written frame."""
        sizes = written(entries.groupBy("id").agg(F.count("*").alias("profiles")).where("profiles > 1"), "dedup-sizes")
        some = sizes.where((F.col("profiles") > FEW_PROFILES) & (F.col("profiles") <= MANY_PROFILES)).select("id")
        few = entries.join(sizes.where(F.col("profiles") <= FEW_PROFILES).select("id"), "id").select("id", "pid")
        pairs = few.select("id", F.col("pid").alias("a")).join(few.select("id", F.col("pid").alias("b")), "id").where("a < b").select("a", "b")
        pairs = pairs.union(self._spanned(entries.join(some, "id")))
        many = sizes.where(F.col("profiles") > MANY_PROFILES).select("id")
        if not many.isEmpty():
            pairs = pairs.union(self._crowded(written(entries.join(many, "id"), "dedup-crowded")))
        return pairs

    def _spanned(self, entries: DataFrame) -> DataFrame:
        """(a, b): pairs that connect what may link under identifiers with at most MANY_PROFILES profiles, by the terms of _crowded.

        Profiles with the same name and values are one node. A node is compared with one of each set of connected nodes after
        the other until it meets one that links, so pairs grow with profiles, not with their square. Where the rules still have
        to see the pair itself, all pairs of two nodes that are not connected anyway are given.
        """
        govs, named = len(self.tiers.gov + self.tiers.other), bool(self.tiers.name)
        sure = max(85.0, float(self.config.dedup_threshold))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[tuple[str, str], float] = {}

            def alike(x: str, y: str) -> float:
                if x == y or not named:
                    return 100.0
                at = (x, y) if x < y else (y, x)
                if at not in known:
                    if len(known) >= KNOWN_NAMES:
                        known.clear()
                    known[at] = fuzzy.name_similarity(*at)
                return known[at]

            for batch in batches:
                a, b = [], []
                for i in range(batch.num_rows):  # one identifier's profiles at a time become objects
                    key, profiles = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    gov = key.startswith("gov:")
                    least, settled = (70.0, 75.0) if gov else (85.0, sure)
                    nodes: dict[tuple, list[int]] = {}
                    for p in sorted(profiles, key=lambda p: p["pid"]):
                        nodes.setdefault((p["name"], tuple(p["values"])), []).append(p["pid"])
                    sets: list[list[tuple]] = []
                    asked: list[tuple[tuple, tuple]] = []
                    for x, rows in nodes.items():
                        a += [rows[0]] * (len(rows) - 1)
                        b += rows[1:]
                        apart, joined = [], [x]
                        for members in sets:
                            for y in members:
                                if not _compatible(x[1], y[1]):
                                    continue
                                similarity = alike(x[0], y[0])
                                if similarity >= settled:
                                    a.append(nodes[y][0])
                                    b.append(rows[0])
                                    joined += members
                                    break
                                if similarity >= least:
                                    asked.append((y, x))
                            else:
                                apart.append(members)
                        sets = [*apart, joined]
                    place = {x: i for i, members in enumerate(sets) for x in members} if asked else {}
                    for x, y in asked:
                        if place[x] != place[y]:
                            a += [i for i in nodes[x] for _ in nodes[y]]
                            b += [j for _ in nodes[x] for j in nodes[y]]
                    if len(a) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                        a, b = [], []
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        values = F.when(F.col("id").startswith("gov:"), F.slice("values", 1, govs)).otherwise(F.col("values")) if govs else F.col("values")
        # dealt by hand, as what an identifier costs shows in pairs of names, not in bytes
        dealt = entries.repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
        rows = dealt.groupBy("id").agg(F.collect_list(F.struct("pid", "name", values.alias("values"))).alias("profiles"))
        return rows.mapInArrow(run, "a long, b long")

    def _crowded(self, entries: DataFrame) -> DataFrame:
        """(a, b): pairs that connect what may link under identifiers with many profiles.

        Under an e-mail or phone, rows link if their names are 85 alike and no identifier column says otherwise; under a gov id,
        if names are 70 alike (75, if addresses can be equal) and no gov column does. Whether columns agree depends on the columns
        that both rows have, so profiles are keyed by that: for each pair of sets of present columns under an identifier, by the
        values of those in both. All profiles of two similar names under one key are compatible, so each is paired with the
        first of one similar name, and the first of a name with those of all: rows don't grow with rows times names. Where the rules still have to see the pair itself, all are paired.
        """
        govs, gov = len(self.tiers.gov + self.tiers.other), F.col("id").startswith("gov:")
        sure = max(85.0, float(self.config.dedup_threshold))
        names = written(entries.select("id", "name").distinct().withColumn("n", F.monotonically_increasing_id()), "crowded-names")
        alike = names.select("id", F.col("n").alias("n1"), F.col("n").alias("n2"), F.lit(100.0).alias("similarity"))
        if self.tiers.name:
            met = []
            # a name similarity of s needs at least 2 s - 100 of its half, the ratio of sorted words
            for some, least in ((names.where(~gov), 70.0), (names.where(gov), 40.0)):
                if not some.isEmpty():
                    met.append(similar_pairs(some.select(F.col("id").alias("by"), F.col("n").alias("id"), fuzzy.sorted_words_udf("name").alias("key")), None, least))
            for found in met:
                text = lambda i: names.select(F.col("n").alias(f"n{i}"), F.col("name").alias(f"name{i}"))
                both = found.select(F.col("by").alias("id"), F.col("a").alias("n1"), F.col("b").alias("n2")).join(text(1).hint("merge"), "n1").join(text(2).hint("merge"), "n2")
                both = both.withColumn("similarity", fuzzy.name_udf("name1", "name2")).where(F.col("similarity") >= F.when(gov, 70.0).otherwise(85.0))
                alike = alike.union(both.select("id", "n1", "n2", "similarity")).union(both.select("id", F.col("n2").alias("n1"), F.col("n1").alias("n2"), "similarity"))
        alike = written(alike, "crowded-alike")
        there = F.transform("values", lambda v, i: (v != "") & (~gov | (i < govs)))
        rows = entries.join(names.hint("merge"), ["id", "name"]).select("id", "n", "pid", "values", there.alias("there"))
        rows = written(rows, "crowded-rows")
        others = rows.select("id", F.col("there").alias("other")).distinct()
        agreed = F.transform("values", lambda v, i: F.when(F.get("there", i) & F.get("other", i), v).otherwise(""))
        nodes = written(rows.join(others.hint("merge"), "id").select("id", "there", "other", agreed.alias("agreed"), "n", "pid"), "crowded-nodes")
        turned = ["id", F.col("other").alias("there"), F.col("there").alias("other"), "agreed", F.col("n").alias("n2")]
        first = nodes.groupBy("id", "there", "other", "agreed", "n").agg(F.min("pid").alias("first"))
        on = ["id", "there", "other", "agreed", "n2"]
        settled = F.col("similarity") >= F.when(gov, 75.0).otherwise(sure)
        lead = ["id", "there", "other", "agreed", "n"]
        met = first.join(alike.where(settled).withColumnRenamed("n1", "n").hint("merge"), ["id", "n"]).join(first.select(*turned, F.col("first").alias("b")).hint("merge"), on)
        met = written(met.select(*lead, F.col("first").alias("a"), "b"), "crowded-met")
        star = nodes.join(met.groupBy(*lead).agg(F.min("b").alias("b")).hint("merge"), lead).select(F.col("pid").alias("a"), "b").union(met.select("a", "b")).where("a != b")
        mine = nodes.join(alike.where(~settled).withColumnRenamed("n1", "n").hint("merge"), ["id", "n"])
        full = mine.join(nodes.select(*turned, F.col("pid").alias("b")).hint("merge"), on).where("pid < b").select(F.col("pid").alias("a"), "b")
        return star.union(full)

    def judged(self, facts: DataFrame, pairs: DataFrame) -> DataFrame:
        """Pairs with decision (merge, block, skip), link, reason, and the similarity of names: null without, and where what the
        rows' identifiers say blocks the pair whatever the names."""
        side = lambda p: facts.select(*[F.col(c).alias(f"{p}_{c}") for c in facts.columns])
        both = pairs.join(side("a"), F.col("rid_a") == F.col("a__rid")).join(side("b"), F.col("rid_b") == F.col("b__rid"))
        named = F.col("a_name").isNotNull() & F.col("b_name").isNotNull()
        def any_pair(kind: str, test) -> Column:
            return F.exists(F.arrays_zip(F.col(f"a_{kind}").alias("x"), F.col(f"b_{kind}").alias("y")), lambda z: (z["x"] != "") & (z["y"] != "") & test(z["x"], z["y"]))

        equal = {k: any_pair(k, lambda x, y: x == y) for k in ("gov", "email", "phone", "address")}
        apart = {k: any_pair(k, lambda x, y: x != y) for k in ("gov", "email", "phone")}
        blocked = apart["gov"] | (~equal["gov"] & ((equal["phone"] & ~apart["phone"] & apart["email"]) | (equal["email"] & ~apart["email"] & apart["phone"])))
        # pairs are marked first, so that only those that names decide reach Python
        both = both.withColumn("asked", named & ~blocked)
        asked = both.where("asked").withColumn("similarity", fuzzy.name_udf("a_name", "b_name"))
        both = asked.unionByName(both.where("NOT asked").withColumn("similarity", F.lit(None).cast("double")))
        valid = lambda p: reduce(Column.__or__, (F.exists(F.col(f"{p}_{k}"), lambda x: x != "") for k in ("gov", "email", "phone", "address")))
        sim, has_names = F.col("similarity"), F.lit(bool(self.tiers.name))
        gov = equal["gov"] & ~apart["gov"]
        decision = F.when(~valid("a") | ~valid("b"), "skip")
        for k in ("phone", "email"):
            shared = equal[k] & ~apart[k] & ~gov
            decision = decision.when(shared & has_names & (sim.isNull() | (sim < 85)), "block")
        decision = decision.when(equal["address"] & (sim < 75), "block").when(apart["gov"], "block")
        decision = decision.when(equal["gov"] & ~has_names, "merge").when(equal["gov"] & (sim >= 70), "merge").when(equal["gov"] & (sim < 40), "block").when(equal["gov"], "skip")
        decision = decision.when((sim >= 85) & (apart["phone"] | apart["email"]), "block").otherwise("skip")
        threshold = self.config.dedup_threshold
        parts = [(0.60, sim)]
        parts += [(w, F.when(equal[k], 100.0).when(apart[k], 0.0)) for k, w in (("email", 0.20), ("phone", 0.15))]
        at = lambda p: F.nullif(F.get(F.col(f"{p}_address"), F.lit(0)), F.lit(""))
        parts.append((0.05, F.when(at("a").isNotNull() & at("b").isNotNull(), fuzzy.ratio_udf(at("a"), at("b")))))
        weight = reduce(Column.__add__, (F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for w, v in parts))
        score = F.try_divide(reduce(Column.__add__, (F.coalesce(v * w, F.lit(0.0)) for w, v in parts)), weight)
        close = F.coalesce((sim >= threshold) | ((sim >= threshold - 10) & (score >= threshold)), F.lit(False))
        proof = gov | (equal["email"] & ~apart["email"]) | (equal["phone"] & ~apart["phone"])
        out = both.withColumn("decision", decision).withColumn("link", (F.col("decision") == "merge") | ((F.col("decision") == "skip") & close & proof))
        why = F.when(F.col("decision") == "merge", "same identifier").when(F.col("link"), F.concat(F.lit("similar name, same "), F.when(gov, "identifier").when(equal["email"], "email").otherwise("phone")))
        return out.select("rid_a", "rid_b", "similarity", "decision", "link", F.coalesce(why, F.col("decision")).alias("reason"))

    def links(self, df: DataFrame) -> DataFrame:
        """Judged candidate pairs. Tables without contacts and identifiers merge rows with exactly the same name."""
        facts = written(self.facts(df), "dedup-facts")
        t = self.tiers
        if t.name and not (t.gov or t.other or t.email or t.phone or t.address):
            first = facts.where("name IS NOT NULL").groupBy("name").agg(F.min("_rid").alias("rid_a"))
            pairs = facts.join(first, "name").where("_rid != rid_a")
            return pairs.select("rid_a", F.col("_rid").alias("rid_b"), F.lit(100.0).alias("similarity"), F.lit("merge").alias("decision"), F.lit(True).alias("link"), F.lit("same name").alias("reason"))
        return written(self.judged(facts, self.candidates(facts)), "dedup-judged")

    def clusters(self, df: DataFrame) -> DataFrame:
        """df with _cid, the least _rid of the row's cluster."""
        found = components(self.links(df).where("link").select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b")))
        return df.join(found, df["_rid"] == found["node"], "left").select(*[df[c] for c in df.columns], F.coalesce("label", "_rid").alias("_cid"))


def golden_records(clustered: DataFrame, t: Tiers, compat_keys: bool = False) -> DataFrame:
    """One row per cluster (_cid), in the columns of the table: the most complete row's valid value, else the first valid one;
    emails and phones all distinct ones in row order, joined by a comma; numbers the median, but keys and sensitive columns as
    text columns. cluster_size counts the rows."""
    columns = [c for c in clustered.columns if c not in ("_rid", "_cid")]
    gaps = reduce(Column.__add__, (q(c).isNull().cast("int") for c in columns))
    rank, golden_words = F.struct(gaps, F.col("_rid")), tuple(w for w in K.SENSITIVE_WORDS if w not in K.NOT_GOLDEN_SENSITIVE)
    contacts = [*t.email, *t.phone]
    aggs = [F.count("*").alias("cluster_size")]
    for c in columns:
        key = primary_like(c) or c.lower().endswith("key") or c in t.gov + t.other
        if c in numbers(clustered) and not sensitive(c, golden_words) and (compat_keys or not key):
            aggs.append(F.median(q(c)).alias(c))
        elif c not in contacts:
            valid = X.is_valid(q(c)) if c not in numbers(clustered) else q(c).isNotNull()
            aggs.append(F.coalesce(F.when(F.min_by(valid, rank), F.min_by(q(c), rank)), F.min_by(q(c), F.when(valid, F.col("_rid")))).alias(c))
    out = clustered.groupBy("_cid").agg(*aggs)
    for c in contacts:
        normal = X.dedup_phone(q(c)) if c in t.phone else X.dedup_key(q(c))
        values = clustered.where(normal != "").groupBy("_cid", normal.alias("_v")).agg(F.min_by(q(c), "_rid").alias("_x"), F.min("_rid").alias("_r"))
        joined = values.groupBy("_cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_x"))), lambda s: s["_x"]), ", ").alias(c))
        out = out.join(joined, "_cid", "left")
    return out.select("_cid", *[q(c) for c in columns], "cluster_size")


def backfill(clustered: DataFrame, columns: list[str]) -> DataFrame:
    """Invalid values take the first valid one of their cluster."""
    first = clustered.groupBy("_cid").agg(*[F.min_by(q(c), F.when(X.is_valid(q(c)), F.col("_rid"))).alias(f"_f{i}") for i, c in enumerate(columns)])
    out = clustered.join(first, "_cid")
    return out.select(*[F.when(X.is_valid(q(c)), q(c)).otherwise(F.coalesce(F.col(f"_f{columns.index(c)}"), q(c))).alias(c) if c in columns else q(c) for c in clustered.columns])


def enrich(clustered: DataFrame, t: Tiers) -> DataFrame:
    """All rows, names replaced by their cluster's golden name and invalid text cells filled from the golden record; rows that
    are alone stay as they are."""
    gold = golden_records(clustered, t)
    text = [c for c, kind in clustered.dtypes if kind == "string"]
    gold = gold.where("cluster_size > 1").select(F.col("_cid"), *[q(c).alias(f"_g{i}") for i, c in enumerate(text)])
    out = clustered.join(gold, "_cid", "left")

    def cell(c: str) -> Column:
        g = F.col(f"_g{text.index(c)}")
        return F.coalesce(g, q(c)).alias(c) if c in t.name else F.when(X.is_valid(q(c)), q(c)).otherwise(F.coalesce(g, q(c))).alias(c)

    return out.select(*[cell(c) if c in text else q(c) for c in clustered.columns])


def cluster_report(clustered: DataFrame, name: str | None = None) -> DataFrame:
    """cluster, cluster_size, canonical_name, first_row, last_row of clusters of more than one row; cluster_rows() has the rows."""
    named = F.min_by(q(name), F.when(X.is_valid(q(name)), F.col("_rid"))) if name else F.lit(None).cast("string")
    out = clustered.groupBy("_cid").agg(F.count("*").alias("cluster_size"), named.alias("canonical_name"), F.min("_rid").alias("first_row"), F.max("_rid").alias("last_row"))
    return out.where("cluster_size > 1").withColumnRenamed("_cid", "cluster")


def cluster_rows(clustered: DataFrame) -> DataFrame:
    """cluster, place (from 1), row_number: a row for each row of clusters of more than one. Places are counted over all rows in
    ranges of the order, so a cluster that holds most of a table is no one task's."""
    sizes = clustered.groupBy("_cid").agg(F.count("*").alias("n"), F.min("_rid").alias("_first")).where("n > 1")
    rows = numbered(clustered.select("_cid", "_rid").join(sizes.select("_cid"), "_cid"), ["_cid", "_rid"], "_at")
    starts = rows.groupBy("_cid").agg(F.min("_at").alias("_from"))
    return rows.join(starts, "_cid").select(F.col("_cid").alias("cluster"), (F.col("_at") - F.col("_from") + 1).alias("place"), F.col("_rid").alias("row_number"))


def changes(clustered: DataFrame, t: Tiers, links: DataFrame | None = None) -> DataFrame:
    """cluster, original, corrected, cluster_size, variants (distinct names) of clusters of more than one row: the first name
    that is not the golden one (else the first name), and the golden name. With judged links, reasons: links by reason."""
    name = t.name[0]
    gold = golden_records(clustered.select("_rid", "_cid", q(name)), Tiers(name=t.name[:1])).where("cluster_size > 1").select("_cid", q(name).alias("corrected"), "cluster_size")
    key = lambda c: F.coalesce(X.dedup_key(c), F.lit(""))
    rows = clustered.select("_cid", "_rid", q(name).alias("_name")).join(gold, "_cid")
    there = F.when(F.col("_name").isNotNull(), F.col("_rid"))
    other = F.when(key(F.col("_name")) != key(F.col("corrected")), there)
    out = rows.groupBy(F.col("_cid").alias("cluster"), "corrected", "cluster_size").agg(F.coalesce(F.min_by("_name", other), F.min_by("_name", there)).alias("original"), F.count_distinct("_name").alias("variants"))
    out = out.select("cluster", "original", "corrected", "cluster_size", "variants")
    if links is None:
        return out
    by_reason = links.where("link").join(clustered.select(F.col("_rid").alias("rid_a"), F.col("_cid").alias("cluster")), "rid_a").groupBy("cluster", "reason").agg(F.count("*").alias("n"))
    return out.join(by_reason.groupBy("cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons")), "cluster", "left")


def conflicts(df: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (rid_a, rid_b) with conflict: some identifier column has different valid values in both rows."""
    side = lambda p: df.select(F.col("_rid").alias(f"rid_{p}"), *[F.coalesce(X.dedup_key(q(c)), F.lit("")).alias(f"{p}{i}") for i, c in enumerate(columns)])
    both = pairs.join(side("a"), "rid_a").join(side("b"), "rid_b")
    differ = [(F.col(f"a{i}") != "") & (F.col(f"b{i}") != "") & (F.col(f"a{i}") != F.col(f"b{i}")) for i in range(len(columns))]
    return both.select("rid_a", "rid_b", reduce(Column.__or__, differ, F.lit(False)).alias("conflict"))


def health_clusters(clustered: DataFrame, t: Tiers) -> DataFrame:
    """cluster, cluster_size, kind of clusters: exact (all columns the same), contacts agree, or contacts differ."""
    columns = [c for c in clustered.columns if c not in ("_rid", "_cid") and not primary_like(c)]
    whole = F.count_distinct(F.struct(*[F.coalesce(X.profile_key(q(c)), F.lit("")) for c in columns]))
    differ = [F.count_distinct(F.when(X.is_valid(q(c)), X.dedup_key(q(c)))) > 1 for c in t.email + t.phone]
    out = clustered.groupBy("_cid").agg(F.count("*").alias("cluster_size"), (whole == 1).alias("e"), (reduce(Column.__or__, differ) if differ else F.lit(False)).alias("d"))
    return out.where("cluster_size > 1").select(F.col("_cid").alias("cluster"), "cluster_size", F.when(F.col("e"), "exact").when(F.col("d"), "contacts differ").otherwise("contacts agree").alias("kind"))


def deduplicate(df: DataFrame, order: list[str], strategies: dict[str, str] | None = None, keep_all_rows: bool = False, config: Config = Config(), in_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """(result, report): golden records in order of their first row, or all rows enriched, and the cluster report. in_order: rows are
    merged one after the other (see replay.replayed), so what comes first decides."""
    base = numbered(df, order)
    t = tiers(df.columns, strategies, config.compat_gov_id)
    if in_order:
        from .replay import replayed

        clustered = written(replayed(base, Engine(t, config)), "dedup-clustered")
    else:
        clustered = written(Engine(t, config).clusters(base), "dedup-clustered")
    report = cluster_report(clustered, t.name[0] if t.name else None)
    if keep_all_rows:
        return enrich(clustered, t).drop("_rid", "_cid"), report
    return golden_records(clustered, t, config.compat_numeric_keys).orderBy("_cid").drop("_cid", "cluster_size"), report
