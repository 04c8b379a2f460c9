"""Profiles merged from parts against the whole table."""

import random

import pytest

from tidewater.operators import profile
from tidewater.operators.shared import scratch_path
from tidewater.operators.sketches import ProfileStore


def test_merged_profile_is_near_the_whole(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "N/A", f"v{rng.randrange(900)}"]), rng.choice([None, float("nan"), rng.gauss(10, 3)])) for i in range(6000)]
    df = spark.createDataFrame(rows, "i int, s string, x double")
    store = ProfileStore(spark, scratch_path(spark, "profile"))
    for k in range(4):
        store.add(df.where(f"i % 4 = {k}"), f"p{k}")
    store.add(df.where("i % 4 = 2"), "p2")  # run again: replaces itself
    exact = {r["column"]: r for r in profile.profile_columns(df).collect()}
    got = {r["column"]: r for r in store.profile().collect()}
    for c, r in got.items():
        assert (r["n_rows"], r["null_count"], r["null_pct"]) == (exact[c]["n_rows"], exact[c]["null_count"], exact[c]["null_pct"])
        assert abs(r["n_unique"] - exact[c]["n_unique"]) <= 0.05 * exact[c]["n_unique"] + 1
    values = sorted(x for _, _, x in rows if x is not None and x == x)
    assert abs(got["x"]["mean"] - sum(values) / len(values)) < 1e-9 and got["x"]["low"] == values[0] and got["i"]["high"] == 5999
    for p, v in zip((0.25, 0.5, 0.75), got["x"]["quantiles"], strict=True):
        assert abs(sum(x <= v for x in values) / len(values) - p) < 0.02
    assert got["s"]["quantiles"] is None and got["s"]["first"] == "v0"


def test_profiles_of_odd_parts(spark):
    df = spark.createDataFrame([(1, None, None)], "i int, s string, x double")
    store = ProfileStore(spark, scratch_path(spark, "profile"))
    store.add(df, "a")
    store.add(df.limit(0), "b")
    store.add(spark.createDataFrame([(2, 5)], "i int, later int"), "c")
    got = {r["column"]: r for r in store.profile().collect()}
    assert (got["s"]["n_rows"], got["s"]["null_count"], got["s"]["n_unique"], got["x"]["quantiles"]) == (1, 1, 0, None)
    assert got["i"]["n_rows"] == 2 and got["later"]["n_rows"] == 1
    with pytest.raises(ValueError):
        store.add(df, "a/b")
