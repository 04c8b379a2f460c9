"""A cleaning run uses all cores, however few files its table comes from."""

from __future__ import annotations

import pytest

from tidewater.plans import pipeline


class _Enough(Exception):
    pass


def test_texts_of_one_file_are_cleaned_by_all_cores_and_once(spark, monkeypatch):
    parts = {}

    def written(df, name, write=pipeline.written):
        parts[name] = df.rdd.getNumPartitions()
        if name == "clean-filtered":
            # what is filtered is a written table, not the cleaning once more
            parts["cleaning"] = df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
            raise _Enough
        return write(df, name)

    monkeypatch.setattr(pipeline, "written", written)
    rows = [(i, f" <b>Anna {i}</b> ", f"anna{i}@mail.org", float(i)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "record_id long, full_name string, email string, salary double").coalesce(1)
    with pytest.raises(_Enough):
        pipeline.clean(df, ["record_id"], domain="HR", intent="Non-Predictive Business")
    assert parts["clean-loaded"] >= spark.sparkContext.defaultParallelism
    assert parts["cleaning"] == 0
