"""Exact numbers of different values, counted in parts."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import profile, shared


def test_distinct_counts_are_exact_both_ways(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "CAST(id % 700 AS STRING) AS s", "CASE id % 4 WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D WHEN 2 THEN CAST('NaN' AS DOUBLE) END AS x", "CAST(NULL AS STRING) AS nothing", "CAST(id % 3 AS TINYINT) AS t", "CAST('2024-01-01' AS DATE) AS d", "array(id % 5) AS a")
    wanted = {"id": 3000, "s": 700, "x": 2, "nothing": 0, "t": 3, "d": 1, "a": 5}
    for few, part in ((10_000, 500_000), (2, 100)):
        monkeypatch.setattr(shared, "FEW_VALUES", few)
        monkeypatch.setattr(shared, "PART_VALUES", part)
        assert shared.distinct_counts(df, {c: F.col(c) for c in df.columns}) == wanted
        assert set(shared.distinct_counts(df.limit(0), {c: F.col(c) for c in df.columns}).values()) == {0}


def test_profile_does_not_expand_rows(spark):
    """One aggregate of many exact distinct counts makes a row for each column, all as wide as the table."""
    df = spark.range(50).selectExpr("id", "CAST(id AS STRING) AS s", "id % 7 AS m")
    plans = []
    collect = type(df).collect
    first = type(df).first
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().toString()) or collect(self))
        m.setattr(type(df), "first", lambda self: plans.append(self._jdf.queryExecution().toString()) or first(self))
        got = {r["column"]: r["n_unique"] for r in profile.profile_columns(df).collect()}
    assert got == {"id": 50, "s": 50, "m": 7} and plans and not any("Expand" in p for p in plans)
