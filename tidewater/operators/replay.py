"""Deduplication in sequence: decisions depend on what was merged before, as each looks at the records that lead the clusters so far.

The order-free engine judges pairs of rows, once each. Here pairs are taken in order, and a pair is judged by the leaders of both
rows' clusters; the more complete leader leads the union.

Groups of rows are replayed apart, as sorted streams of pairs through a union-find a group. To begin with every row is a group. A
pair between groups is judged by the leaders that its rows have in their groups' replays at its place in the order; where it
would join them, the groups become one, and it all runs again until no pair between groups joins any more. Up to the first pair
where the replay of the whole table did otherwise, all leaders would be the same, and so its decision: there is no such pair.
Groups are as large as clusters, or little larger, whatever number of rows shares an identifier; a task holds the rows of one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as X
from .dedup import KNOWN_NAMES, Engine, completeness, sorted_neighbourhood
from .graph import merged
from .shared import counted, forget, q, written


class Leaders:
    """Union-find whose roots are the most complete rows; a union of equals makes the root count for one more."""

    def __init__(self, ranks: dict[int, int]):
        self.parent, self.rank = {i: i for i in ranks}, dict(ranks)

    def of(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.of(i), self.of(j)
        if self.rank[a] < self.rank[b]:
            a, b = b, a
        self.parent[b] = a
        self.rank[a] += self.rank[a] == self.rank[b]


def _same(a: list[str], b: list[str]) -> bool:
    return any(x == y != "" for x, y in zip(a, b, strict=True))


def _apart(a: list[str], b: list[str]) -> bool:
    return any(x and y and x != y for x, y in zip(a, b, strict=True))


def decide(a: dict, b: dict, has_names: bool, similarity: float | None) -> str:
    """merge, block or skip for two rows' facts; similarity: of their names, None if one has none."""
    if not all(any(x for k in ("gov", "email", "phone", "address") for x in r[k]) for r in (a, b)):
        return "skip"
    low = lambda least: similarity is not None and similarity < least
    gov = _same(a["gov"], b["gov"]) and not _apart(a["gov"], b["gov"])
    for k in ("phone", "email"):
        if _same(a[k], b[k]) and not _apart(a[k], b[k]) and not gov and has_names and (similarity is None or similarity < 85):
            return "block"
    if _same(a["address"], b["address"]) and low(75) or _apart(a["gov"], b["gov"]):
        return "block"
    if gov:
        return "merge" if not has_names or similarity is not None and similarity >= 70 else "block" if low(40) else "skip"
    return "block" if similarity is not None and similarity >= 85 and (_apart(a["phone"], b["phone"]) or _apart(a["email"], b["email"])) else "skip"


def _score(a: dict, b: dict, similarity: float) -> float:
    """Weighted score of names, first e-mails, first phones and first addresses; what is missing weighs nothing."""
    parts = [(0.60, similarity)]
    for k, w in (("email", 0.20), ("phone", 0.15), ("address", 0.05)):
        x, y = (r[k][0] if r[k] else "" for r in (a, b))
        if x and y:
            parts.append((w, fuzzy.ratio(x, y) if k == "address" else 100.0 * (x == y)))
    return sum(w * v for w, v in parts) / sum(w for w, _ in parts)


class Names:
    """Similarities of names, of which so many are remembered."""

    def __init__(self, most: int = KNOWN_NAMES):
        self.known: dict[tuple[str, str], float] = {}
        self.most = most

    def __call__(self, x: str | None, y: str | None) -> float | None:
        if not x or not y:
            return None
        if (x, y) not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[x, y] = fuzzy.name_similarity(x, y)
        return self.known[x, y]


def joins(step: int, a: dict, b: dict, own: tuple[str | None, str | None], alike: Names, has_names: bool, threshold: float) -> bool:
    """Whether a pair of this pass joins the clusters led by a and b. own: the names of the pair's rows."""
    similarity = alike(a["name"], b["name"])
    if step == 2:
        mine = alike(*own)
        if mine is None or mine < threshold:
            return False
    elif step == 3 and (similarity is None or similarity < threshold - 10 or _score(a, b, similarity) < threshold):
        return False
    decision = decide(a, b, has_names, similarity)
    proof = step > 1 and not _apart(a["gov"], b["gov"]) and any(_same(a[k], b[k]) for k in ("gov", "phone", "email"))
    return decision == "merge" or decision == "skip" and proof


def replay(rows: dict[int, dict], pairs: Iterable[tuple[int, int, int]], has_names: bool, threshold: float) -> dict[int, int]:
    """Leader of each row. rows: facts and rank by number; pairs: (pass, a, b) in order. Pass 1 has rows with one identifier, pass 2
    names in sorted order, pass 3 the same by score."""
    leaders, alike = Leaders({i: r["rank"] for i, r in rows.items()}), Names()
    for step, i, j in pairs:
        a, b = leaders.of(i), leaders.of(j)
        if a != b and joins(step, rows[a], rows[b], (rows[i]["name"], rows[j]["name"]), alike, has_names, threshold):
            leaders.union(i, j)
    return {i: leaders.of(i) for i in rows}


def ordered_pairs(df: DataFrame, engine: Engine) -> DataFrame:
    """(step, at, a, b): what is replayed, in the order of step, at (an array), a, b. df has _rid and _rank."""
    t, out = engine.tiers, []
    for i, c in enumerate(t.gov + t.other):
        rows = df.select("_rid", "_rank", X.dedup_key(q(c)).alias("k")).where("k != ''")
        lead = rows.groupBy("k").agg(F.min_by("_rid", F.struct(-F.col("_rank"), F.col("_rid"))).alias("a"), F.min("_rid").alias("first"))
        out.append(rows.join(lead, "k").where("_rid != a").select(F.lit(1).alias("step"), F.array(F.lit(i).cast("long"), F.col("first"), -F.col("_rank").cast("long")).alias("at"), "a", F.col("_rid").alias("b")))
    if t.name:
        for step, window in ((2, 11), (3, 5)):
            near = sorted_neighbourhood(df, t.name[0], window)
            out.append(near.select(F.lit(step).alias("step"), F.array().cast("array<long>").alias("at"), F.col("rid_a").alias("a"), F.col("rid_b").alias("b")))
    pairs = out[0]
    for x in out[1:]:
        pairs = pairs.unionAll(x)
    return pairs


_FACTS = ["name", "rank", "gov", "email", "phone", "address"]
_FACT_TYPES = "name string, rank long, gov array<string>, email array<string>, phone array<string>, address array<string>"


def _proven(a: str, b: str) -> Column:
    """What any pair that joins clusters needs of their leaders' facts (structs), as joins() says: an identifier that both have in one
    column, in pass 1 a government's, and none of these apart."""
    both = lambda k, f: F.exists(F.zip_with(F.col(f"{a}.{k}"), F.col(f"{b}.{k}"), f), lambda x: x)
    same = lambda k: both(k, lambda x, y: (x == y) & (x != ""))
    return (same("gov") | (F.col("step") > 1) & (same("phone") | same("email"))) & ~both("gov", lambda x, y: (x != "") & (y != "") & (x != y))


def _joining(met: DataFrame, facts: DataFrame, has_names: bool, threshold: float) -> DataFrame:
    """(a, b) of the pairs (step, a, b, name_a, name_b, lead_a, lead_b) that join the clusters of these leaders."""
    side = lambda s: facts.select(F.col("_rid").alias(f"lead_{s}"), F.struct(*_FACTS).alias(f"facts_{s}")).hint("merge")
    found = met.join(side("a"), "lead_a").join(side("b"), "lead_b").where(_proven("facts_a", "facts_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alike = Names()
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("step", "facts_a", "facts_b", "name_a", "name_b")), strict=True)
            fit = pa.array([joins(step, x, y, (m, n), alike, has_names, threshold) for step, x, y, m, n in rows], pa.bool_())
            yield batch.select(["a", "b"]).filter(fit)

    return found.select("step", "a", "b", "name_a", "name_b", "facts_a", "facts_b").mapInArrow(run, "a long, b long")


def _replays(has_names: bool, threshold: float):
    """Replays a stream of groups (label), each its rows (kind 0) and then its pairs in order. A pair within the group (kind 1) is
    judged and may join; of one with a row elsewhere (kinds 2 and 3: its a or b is here), the leader of the row here at that time
    is told. Out: (pair, kind, node, lead); for rows, at the end, without a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, leaders, alike = None, {}, Leaders({}), Names()
        out: list[tuple] = []

        def ended() -> None:
            least: dict[int, int] = {}
            for i in sorted(rows):
                least.setdefault(leaders.of(i), i)
            out.extend((None, 0, i, least[leaders.of(i)]) for i in rows)

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["pair", "kind", "node", "lead"])

        for batch in batches:
            for part in range(0, batch.num_rows, 2_000):
                piece = batch.slice(part, 2_000)
                for label, kind, step, pair, a, b, facts in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if label != now:
                        ended()
                        now, rows, leaders = label, {}, Leaders({})
                    if kind == 0:
                        rows[a] = facts
                        leaders.parent[a], leaders.rank[a] = a, facts["rank"]
                    elif kind == 1:
                        x, y = leaders.of(a), leaders.of(b)
                        if x != y and joins(step, rows[x], rows[y], (rows[a]["name"], rows[b]["name"]), alike, has_names, threshold):
                            leaders.union(a, b)
                    else:
                        node = a if kind == 2 else b
                        out.append((pair, kind, node, leaders.of(node)))
                yield told()
        ended()
        yield told()

    return run


def replayed(df: DataFrame, engine: Engine) -> DataFrame:
    """df with _cid, the least _rid of the row's cluster, by replay in order. Rows that share no identifier stay alone; an empty
    table stays so. df has _rid; names are paired with their next ones in sorted order, as sorted_neighbourhood() does."""
    t, has_names, threshold = engine.tiers, bool(engine.tiers.name), float(engine.config.dedup_threshold)
    alone = df.withColumn("_cid", F.col("_rid"))
    if not (t.gov or t.other or t.email or t.phone):
        return alone
    ranked = df.withColumn("_rank", completeness(df))
    facts = written(engine.facts(df).join(ranked.select("_rid", F.col("_rank").cast("long").alias("rank")), "_rid"), "replay-facts")
    name = lambda side: facts.select(F.col("_rid").alias(side), F.col("name").alias(f"name_{side}")).hint("merge")
    pairs = ordered_pairs(ranked, engine).join(name("a"), "a").join(name("b"), "b").withColumn("pair", F.monotonically_increasing_id())
    pairs = written(pairs, "replay-pairs")
    links, more = counted(_joining(pairs.withColumn("lead_a", F.col("a")).withColumn("lead_b", F.col("b")), facts, has_names, threshold), "replay-links")
    labels, told = None, None
    while more["n"]:
        before, labels = labels, merged(labels, links)
        forget(*filter(None, [before, links, told]))
        label = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")).hint("merge")  # noqa: B023, E731
        placed = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where("a_label IS NOT NULL OR b_label IS NOT NULL")
        ends = F.when(F.col("a_label") == F.col("b_label"), F.array(F.struct(F.col("a_label").alias("label"), F.lit(1).alias("kind"))))
        ends = F.coalesce(ends, F.array(F.struct(F.col("a_label").alias("label"), F.lit(2).alias("kind")), F.struct(F.col("b_label").alias("label"), F.lit(3).alias("kind"))))
        events = placed.select(F.explode(ends).alias("e"), "step", "at", "pair", "a", "b").where("e.label IS NOT NULL").select("e.*", "step", "at", "pair", "a", "b", F.lit(None).cast(f"struct<{_FACT_TYPES.replace(' ', ':').replace(',:', ',')}>").alias("facts"))
        rows = facts.join(labels.hint("merge"), facts["_rid"] == labels["node"]).select("label", F.lit(0).alias("kind"), F.lit(0).alias("step"), F.array().cast("array<long>").alias("at"), F.lit(None).cast("long").alias("pair"), F.col("_rid").alias("a"), F.lit(None).cast("long").alias("b"), F.struct(*_FACTS).alias("facts"))
        dealt = rows.unionAll(events).repartition("label").sortWithinPartitions("label", "step", "at", "a", "b").select("label", "kind", "step", "pair", "a", "b", "facts")
        told = written(dealt.mapInArrow(_replays(has_names, threshold), "pair long, kind int, node long, lead long"), "replay-told")
        leads = told.where("pair IS NOT NULL").groupBy("pair").agg(F.max(F.when(F.col("kind") == 2, F.col("lead"))).alias("lead_a"), F.max(F.when(F.col("kind") == 3, F.col("lead"))).alias("lead_b"))
        met = pairs.join(leads.hint("merge"), "pair").withColumn("lead_a", F.coalesce("lead_a", "a")).withColumn("lead_b", F.coalesce("lead_b", "b"))
        links, more = counted(_joining(met, facts, has_names, threshold), "replay-links")
    forget(*filter(None, [labels, pairs, facts, links]))
    if told is None:
        return alone
    found = told.where("pair IS NULL").select("node", F.col("lead").alias("cid"))
    return df.join(found, df["_rid"] == found["node"], "left").select(*[df[c] for c in df.columns], F.coalesce("cid", "_rid").alias("_cid"))
