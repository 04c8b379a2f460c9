"""Replay in order by groups that grow until none joins another, where a placeholder links most of the table."""

from pyspark.sql import functions as F

from test_replay import table
from tidewater.operators import classify, dedup, replay
from tidewater.operators.shared import numbered


def watched(monkeypatch):
    """Sizes of the largest group of rows that a task got, by round."""
    sizes = []
    for name in ("merged", "components"):
        found = getattr(replay, name, None)

        def sized(*args, found=found):
            labels = found(*args)
            sizes.append(labels.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
            return labels

        if found:
            monkeypatch.setattr(replay, name, sized)
    return sizes


def test_a_placeholder_makes_no_large_group(spark, monkeypatch):
    sizes = watched(monkeypatch)
    names = ["anna mueller", "wei chen", "omar hassan", "lucia rossi", "noah brown", "priya patel"]
    rows = [(i, f"{names[i // 2 % 6]} {chr(97 + i // 12) * 6}", "no@mail.org", f"98000{i // 2:05d}", None, "delhi") for i in range(240)]
    df = spark.createDataFrame(rows, "record_id long, full_name string, email string, phone string, pan string, city string")
    got = {r["record_id"]: r["_cid"] for r in replay.replayed(numbered(df, ["record_id"]), dedup.Engine(classify.tiers(df.columns))).collect()}
    assert got == {i: i - i % 2 for i in range(240)} and sizes and max(sizes) <= 8


def test_groups_under_placeholders_equal_one_replay(spark, monkeypatch):
    rounds = []
    for seed in (5, 6, 7):
        sizes = watched(monkeypatch)
        df = table(spark, seed).withColumn("email", F.when(F.col("record_id") % 3 > 0, "no@mail.org"))
        base, engine = numbered(df, ["record_id"]), dedup.Engine(classify.tiers(df.columns))
        ranked = base.withColumn("_rank", dedup.completeness(base))
        facts = {r["_rid"]: r.asDict() for r in engine.facts(base).collect()}
        for r in ranked.collect():
            facts[r["_rid"]]["rank"] = r["_rank"]
        pairs = sorted((r["step"], list(r["at"]), r["a"], r["b"]) for r in replay.ordered_pairs(ranked, engine).collect())
        leads = replay.replay(facts, [(s, a, b) for s, _, a, b in pairs], True, 82.0)
        least = {}
        for i in sorted(leads):
            least.setdefault(leads[i], i)
        assert {r["_rid"]: r["_cid"] for r in replay.replayed(base, engine).collect()} == {i: least[leads[i]] for i in leads}
        rounds.append(len(sizes))
        monkeypatch.undo()
    assert max(rounds) > 1, "no table here takes a second round"
