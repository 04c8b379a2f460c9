"""Identifiers that many rows share: pairs grow with rows, not with their square."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import classify, dedup
from tidewater.operators.graph import components
from tidewater.operators.shared import numbered

SCHEMA = "record_id long, full_name string, email string, phone string, pan string, city string"


def people(spark, seed, n=120):
    rng, first, last = random.Random(seed), ["raj", "anna", "liam", "maria"], ["sharma", "kowalski", "chen"]
    rows = [(i, rng.choice([None, *(f"{a} {m} {b}" for a in first for m in "abc" for b in last)]), rng.choice([None, "nomail", f"u{i % 30}@a.b"]), rng.choice([None, "9999999999", f"98000000{i % 40:02d}"]), rng.choice([None, *(f"ABCPQ{k}234K" for k in range(3))]), rng.choice([None, "rome"])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("few", "many"), [(10_000, 10_000), (1, 10_000), (1, 1), (6, 20)])
def test_all_ways_give_the_clusters_of_all_pairs(spark, monkeypatch, few, many):
    base = numbered(people(spark, 7), ["record_id"])
    engine = dedup.Engine(classify.tiers(base.columns))
    facts = engine.facts(base).cache()
    every = base.select(F.col("_rid").alias("rid_a")).crossJoin(base.select(F.col("_rid").alias("rid_b"))).where("rid_a < rid_b")
    wanted = {r["node"]: r["label"] for r in components(engine.judged(facts, every).where("link").select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))).collect()}
    monkeypatch.setattr(dedup, "FEW_PROFILES", few)
    monkeypatch.setattr(dedup, "MANY_PROFILES", many)
    got = {r["_rid"]: r["_cid"] for r in engine.clusters(base).collect()}
    assert got == {i: wanted.get(i, i) for i in got} and len(set(got.values())) < len(got)


def test_pairs_under_an_identifier_grow_with_rows(spark):
    rows = [(i, f"raj {chr(97 + i % 26)}{chr(97 + i // 26)} sharma", f"u{i}@a.b", None, "ABCPQ1234K", None) for i in range(60)]
    base = numbered(spark.createDataFrame(rows, SCHEMA), ["record_id"])
    engine = dedup.Engine(classify.tiers(base.columns))
    assert engine.candidates(engine.facts(base)).count() < 3 * 60  # 1,770 pairs of rows
    assert {r["_cid"] for r in engine.clusters(base).collect()} == {0}
