"""Exact similarity joins, clusters of names and deduplication against plain Python over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import fuzzy
from tidewater.operators import classify, dedup, mapping
from tidewater.operators.shared import numbered
from tidewater.operators.similar import levels, not_independent, similar_pairs, tokens


def strings(n, seed, letters="abcdé ß漢😀", sizes=(0, 1, 3, 12, 40, 63, 64, 65, 130)):
    rng = random.Random(seed)
    return [None if rng.random() < 0.03 else "".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n)]


@pytest.mark.parametrize(("one", "many", "longest"), [("ratio", "ratios", 200), ("token_sort_ratio", "token_sort_ratios", 200), ("token_set_ratio", "token_set_ratios", 200), ("partial_ratio", "partial_ratios", 70), ("name_similarity", "name_similarities", 70)])
def test_batches_equal_single_values(one, many, longest):
    a, b = strings(600, 1), strings(600, 2)
    b[::7] = a[::7]
    a, b = [x and x[:longest] for x in a], [x and x[:longest] for x in b]
    assert getattr(fuzzy, many)(a, b).tolist() == [getattr(fuzzy, one)(x, y) for x, y in zip(a, b, strict=True)]
    assert getattr(fuzzy, many)([], []).tolist() == []


def test_batched_lcs_of_long_strings():
    a, b = ["ab" * 700, "", "x" * 1500, "abc"], ["ba" * 900, "abc", "xy" * 1000, "abc" * 800]
    assert fuzzy.lcs_lengths(a, b).tolist() == [fuzzy.lcs_length(x, y) for x, y in zip(a, b, strict=True)]


def test_beginnings_of_similar_strings_share_enough():
    rng = random.Random(6)
    for _ in range(3000):
        t = rng.choice([40.0, 62.5, 80.0, 95.0])
        x = "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 14)))
        y = "".join(c for c in x if rng.random() < 0.85) + rng.choice(["", "a", "zz"])
        if not y or fuzzy.ratio(x, y) < t:
            continue
        a, b = sorted(tokens(x)), sorted(tokens(y))
        assert any(v in levels(len(y), t) and len(set(a[:n]) & set(b[: levels(len(y), t)[v]])) >= v for v, n in levels(len(x), t).items()), (x, y, t)


@pytest.mark.parametrize("threshold", [35.0, 70.0, 85.0])
def test_similar_pairs_are_all_pairs(spark, threshold):
    keys = sorted({k for k in strings(220, 3, "abcdé", (0, 1, 2, 3, 4, 5, 7, 9, 12)) if k is not None})
    rows = spark.createDataFrame([(i, k, str(i % 2)) for i, k in enumerate(keys)] + [(9999, None, "0")], "id long, key string, by string")
    alike = lambda i, j: keys[i] and keys[j] and fuzzy.ratio(keys[i], keys[j]) >= threshold
    n = len(keys)
    assert {(r["a"], r["b"]) for r in similar_pairs(rows.drop("by"), None, threshold).collect()} == {(i, j) for i in range(n) for j in range(i + 1, n) if alike(i, j)}
    got = similar_pairs(rows, None, threshold).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) and {(r["a"], r["b"]) for r in got} == {(i, j) for i in range(n) for j in range(i + 2, n, 2) if alike(i, j)}
    some = rows.where("id < 40").drop("by")
    assert {(r["a"], r["b"]) for r in similar_pairs(some, rows.drop("by"), threshold).collect()} == {(i, j) for i in range(40) for j in range(n) if alike(i, j)}
    assert similar_pairs(rows.limit(0), None, threshold).count() == 0


def test_first_independent_set_is_the_sequential_one(spark):
    for seed, size in ((1, 60), (2, 200)):
        rng = random.Random(seed)
        edges = {tuple(sorted(rng.sample(range(size), 2))) for _ in range(size)} | {(i, i + 1) for i in range(12)}
        open_, out = set(), set()
        for b in range(size):
            (out if any((a, b) in edges for a in open_) else open_).add(b)
        frame = spark.createDataFrame(sorted(edges), "a long, b long")
        assert {r["id"] for r in not_independent(frame).collect()} == out
    assert not_independent(spark.createDataFrame([], "a long, b long")).count() == 0


def test_name_clusters_equal_the_sequential_rule(spark, monkeypatch):
    monkeypatch.setattr(mapping, "BATCH", 16)  # so that openers of earlier batches count
    rng = random.Random(5)
    base = ["anna mueller", "john smith", "maria garcia lopez", "li wei", "peter o'connor", "", " "]
    names = []
    for _ in range(220):
        n = rng.choice(base)
        if n.strip() and rng.random() < 0.7:
            i = rng.randrange(len(n))
            n = n[:i] + rng.choice("abcxyz ") + n[i + 1 :]
        names.append(rng.choice([n, n.title(), n.upper()]))
    counts = {n: names.count(n) for n in set(names)}
    key = lambda n: " ".join(sorted(n.lower().split()))
    groups = {}
    for n in counts:
        groups.setdefault(key(n), []).append(n)
    opened, cluster = [], {}
    for k in sorted(groups, key=lambda k: min(groups[k])):
        found = next((o for o in opened if fuzzy.ratio(k, o) >= 80 and (k or o == k)), None)
        if found is None:
            opened.append(found := k)
        cluster.setdefault(found, []).extend(groups[k])
    want = {n: min(ns, key=lambda x: (-counts[x], -len(x), x)) for ns in cluster.values() for n in ns}
    got = mapping.name_clusters(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), "name").collect()
    assert {r["name"]: r["canonical"] for r in got} == want
    assert mapping.name_clusters(spark.createDataFrame([], "name string"), "name").count() == 0


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def engine_and_all_pairs(spark, df, config=None):
    """Clusters by the engine, and by judging every pair of rows."""
    base = numbered(df, ["record_id"])
    engine = dedup.Engine(classify.tiers(df.columns), *([config] if config else []))
    ids = [r[0] for r in base.select("_rid").collect()]
    facts = engine.facts(base)
    pairs = facts.select(F.col("_rid").alias("rid_a")).crossJoin(facts.select(F.col("_rid").alias("rid_b"))).where("rid_a < rid_b")
    every = engine.judged(facts, pairs).where("link").select("rid_a", "rid_b").collect()
    mine = engine.links(base).where("link").select("rid_a", "rid_b").collect()
    return components(ids, mine), components(ids, every)


@pytest.mark.parametrize("others", [20, 60, 150])
def test_no_link_is_lost_under_a_crowded_identifier(spark, others):
    rng = random.Random(others)
    rows = [(0, "catherine smith", "9800000001"), (1, "katherine smith", "9800000001"), (2, "jon doe", "9800000001"), (3, "john doe", "9800000001")]
    rows += [(10 + i, "".join(rng.choice("abcdefghijklmnop") for _ in range(12)), "9800000001") for i in range(others)]
    got, want = engine_and_all_pairs(spark, spark.createDataFrame(rows, "record_id long, full_name string, phone string"))
    assert got == want and got[1] == got[0] and got[3] == got[2]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_clusters_are_those_of_all_pairs(spark, seed):
    """A phone that most rows share, with conflicting and missing e-mails and identifiers."""
    rng, rows = random.Random(seed), []
    names = ["catherine smith", "katherine smith", "john doe", "jon doe", "maria garcia lopez", "maria garcia", "maria g lopez", "li wei", "wei li", "anna mueller", "ana mueller"]
    for i in range(200):
        n = rng.choice(names) if rng.random() < 0.85 else rng.choice([None, "".join(rng.choice("abcdefgh ") for _ in range(9))])
        if n and rng.random() < 0.3:
            j = rng.randrange(len(n))
            n = n[:j] + rng.choice("abcxyz") + n[j + 1 :]
        pan = rng.choice([None, None, None, "ABCPQ1234K", "ABCPQ9999Z"]) if seed else rng.choice(["ABCPQ1234K", "ABCPQ1234K", None])
        rows.append((i, n, rng.choice([None, None, "x@a.b", "y@a.b", "z@a.b"]), rng.choice([None, *["9999999999"] * 3, "8888888888"]), rng.choice([None, "7777777777"]), pan, rng.choice([None, "delhi", "rome"])))
    got, want = engine_and_all_pairs(spark, spark.createDataFrame(rows, "record_id long, full_name string, email string, phone string, mobile string, pan string, city string"))
    assert got == want and 1 < len(set(got.values())) < 200


def test_cluster_rows(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([0, 0, 2, 0, 4, 4])], "_rid long, _cid long")
    assert sorted(map(tuple, dedup.cluster_rows(df).collect())) == [(0, 1, 0), (0, 2, 1), (0, 3, 3), (4, 1, 4), (4, 2, 5)]
    assert {(r["cluster"], r["first_row"], r["last_row"]) for r in dedup.cluster_report(df).collect()} == {(0, 0, 3), (4, 4, 5)}
