"""Cell-level audit, date formats by column, nearest-neighbour imputation, the advisor's protocol."""

import math
import random

import pytest

from tidewater.config import ColumnSchema
from tidewater.operators import audit, classify, dates, impute
from tidewater.operators.neighbours import Boxes, Tree
from tidewater.plans import advisor, console, pipeline


def test_cell_changes(spark):
    before = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "c", 3.0), (4, "d", None)], "id int, s string, x double")
    after = spark.createDataFrame([(1, "A", 1.0), (2, "b", 2.0), (4, None, None), (9, "z", 9.0)], "id int, s string, x double")
    assert sorted(map(tuple, audit.cell_changes(before, after, ["id"]).collect())) == [(1, "s", "a", "A"), (2, "s", None, "b"), (4, "s", "d", None)]
    assert tuple(audit.row_changes(before, after, ["id"]).first()) == (1, 1)
    assert audit.change_counts(before, before, ["id"], 1, "x").count() == 0 and tuple(audit.row_changes(before.limit(0), before.limit(0), ["id"]).first()) == (0, 0)
    counts = audit.change_counts(before, after, ["id", "x"], 3, "fix", ["s"])
    assert {(r["original"], r["cleaned"], r["n"], r["example"]) for r in counts.collect()} == {("a", "A", 1, "1,1.0"), (None, "b", 1, "2,2.0"), ("d", None, 1, "4")}


def test_top_changes_and_totals(spark):
    rows = [(1, "s", "c", f"o{i}", None if i % 3 else f"n{i}", 1 + i % 7, "k") for i in range(300)]
    frame = spark.createDataFrame(rows, audit.CHANGES)
    want = sorted(rows, key=lambda r: (-r[5], r[3], r[4] or ""))[:5]
    assert [(r["original"], r["place"]) for r in audit.top_changes(frame).orderBy("place").collect()] == [(r[3], i + 1) for i, r in enumerate(want)]
    t = audit.column_totals(frame).first()
    assert (t["cells"], t["kinds"], t["emptied"], t["filled"]) == (sum(r[5] for r in rows), 300, sum(r[5] for r in rows if r[4] is None), 0)


def test_tracked_run(spark):
    rows = [(1, " raj sharma ", "Raj at mail.com", "+91 9876543210"), (2, "Raj Sharma", "raj@mail.com", "9876543210"), (3, "Meera Patel", "m@x.co", "N/A")]
    r = pipeline.clean(spark.createDataFrame(rows, "record_id int, name string, email string, phone string"), ["record_id"], track=True)
    got = {(x["step"], x["column"], x["original"], x["cleaned"]) for x in r.changes.collect()}
    assert {("load", "phone", "N/A", None), ("text", "name", " raj sharma ", "raj sharma"), ("standard", "name", "raj sharma", "Raj Sharma"), ("standard", "email", "Raj at mail.com", "raj@mail.com")} <= got
    assert pipeline.clean(spark.createDataFrame(rows, "record_id int, name string, email string, phone string"), ["record_id"]).changes is None


def test_dates_follow_their_column(spark):
    rows = [(1, "03/04/2021", "03-04-2021"), (2, "25/12/2020", "12-25-2020"), (3, " 1/2/2021 10:00", "2021-05-06"), (4, "31/02/2021", "soon"), (5, None, "13-01-2021")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    assert dates.decide(dates.votes(df, ["a", "b"])) == {"a": {"/": True}, "b": {"-": True}}  # b: one each way, so the default
    got = {r["i"]: (r["a"], r["b"]) for r in dates.parse(df, ["a", "b"]).collect()}
    assert got == {1: ("2021-04-03", "2021-04-03"), 2: ("2020-12-25", "2020-12-25"), 3: ("2021-02-01", "2021-05-06"), 4: (None, None), 5: (None, "2021-01-13")}
    # votes of parts add up
    parts = dates.votes(df.where("i < 3"), ["a"]).union(dates.votes(df.where("i >= 3"), ["a"]))
    assert dates.decide(parts) == dates.decide(dates.votes(df, ["a"]))
    assert dates.parse(df.limit(0), ["a"]).count() == 0


def plain_knn(rows, k):
    """rows of floats or None; brute force."""
    d, out = len(rows[0]), [list(r) for r in rows]
    for i, r in enumerate(rows):
        for f in range(d):
            if r[f] is not None:
                continue
            near = []
            for s in rows:
                both = [c for c in range(d) if r[c] is not None and s[c] is not None]
                if s[f] is not None and both:
                    near.append((sum((r[c] - s[c]) ** 2 for c in both) * d / len(both), s[f]))
            near = sorted(near)[:k]
            have = [s[f] for s in rows if s[f] is not None]
            out[i][f] = sum(v for _, v in near) / len(near) if near else sum(have) / len(have) if have else None
    return out


@pytest.mark.parametrize("leaf", [4, 2048])
def test_knn_equals_brute_force(spark, monkeypatch, leaf):
    from tidewater.operators import neighbours

    monkeypatch.setattr(neighbours, "LEAF", leaf)  # many cells, or one for each set of columns
    monkeypatch.setattr(neighbours, "GAPS", 7)
    rng = random.Random(leaf)
    rows = [tuple(None if rng.random() < 0.15 else float(rng.randrange(12) * (10 if c == 2 else 1)) for c in range(3)) for _ in range(160)]
    rows += [(5.0, None, 20.0)] * 9 + [(None, None, None)] * 2
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "i int, a double, b double, c double, s string")
    got = {r["i"]: [r["a"], r["b"], r["c"]] for r in impute.knn(df, ["a", "b", "c"], 3).collect()}
    for i, want in enumerate(plain_knn(rows, 3)):
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(got[i], want, strict=True)), (i, rows[i], got[i], want)


def test_knn_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), None)], "i int, a double, b double")
    assert [(r["a"], r["b"]) for r in impute.knn(df, ["a", "b"]).orderBy("i").collect()] == [(1.0, None), (1.0, None)]
    assert impute.knn(df.limit(0), ["a", "b"]).count() == 0
    filled = impute.apply_statistical(spark.createDataFrame([(i, float(i), float(i) if i % 5 else None) for i in range(40)], "i int, x double, y double"), {"y": "fill_knn"}, near=["x"])[0]
    assert all(abs(r["y"] - r["i"]) <= 3.5 for r in filled.collect())


def test_boxes_are_nearer_than_what_they_hold():
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    leaf = Tree(x, 16).leaf(x)
    assert len(set(leaf.tolist())) > 8
    low, high = (np.array([f(x[leaf == c], axis=0) for c in range(leaf.max() + 1)]) for f in (np.min, np.max))
    boxes = Boxes(np.arange(len(low)), low, high, np.bincount(leaf))
    ask = np.array([[0.3, np.nan, -1.0]])
    near = boxes.distances(ask, 1)[0]
    for i, v in enumerate(x):
        assert near[leaf[i]] <= ((v[0] - 0.3) ** 2 + (v[2] + 1.0) ** 2) * 3 / 2


def test_advisor_protocol(spark):
    assert advisor.parse_reply('<think>x</think>```json\n{"a": [1, 2,],}\n```') == {"a": [1, 2]}
    assert advisor.parse_reply("{'a': 'b'") == {"a": "b"} and advisor.parse_reply("no json") is None
    before = {"a": ColumnSchema("Name"), "b": ColumnSchema("Name")}
    assert advisor.gated(before, {"a": ColumnSchema("Email", confidence=0.9), "b": ColumnSchema("Email", confidence=0.1), "c": ColumnSchema("Email", confidence=1.0)}) == before | {"a": ColumnSchema("Email", confidence=0.9)}

    class Guess:
        def refine_schema(self, profile, schema):
            return {c: ColumnSchema("Email", "fill_mode", 0.2) for c in schema}

        def rules(self, profile, schema):
            return []

        def translate(self, values):
            return {}

        def sql(self, question, tables):
            return ""

        def spot_check(self, rows):
            return [f"{len(rows)} rows seen"]

    r = pipeline.clean(spark.createDataFrame([(1, "Ann", "a@b.co"), (2, "Bo", "b@b.co")], "record_id int, name string, email string"), ["record_id"], advisor=Guess())
    assert r.schema["name"].semantic_type == "Name"  # not confident enough
    assert "2 rows seen" in {x["explanation"] for x in r.audit.collect()}


def test_fill_audit_and_vocabulary(spark):
    df = spark.createDataFrame([(1, None), (2, 2.0), (3, 4.0)], "i int, x double")
    _, values = impute.apply_statistical(df, {"x": "fill_mean"})
    assert tuple(impute.fill_audit(df, {"x": "fill_mean"}, values).first()) == ("x", "fill_mean", "3", 1, 33.33)
    words = classify.domain_words()
    assert "telecommunications" in words["Telecommunications"] and "tracking_id" in words["Logistics"] and words["Sports"] == ["sports"]
    scores = {r["domain"]: r["score"] for r in classify.domain_scores(spark.createDataFrame([(1, 2.0)], "tracking_id int, bmi double"), ["tracking_id"]).collect()}
    assert scores["Logistics"] == 1.0 and scores["Healthcare"] == 1.0 and scores["Retail"] == 0.0


def test_console_answers(spark):
    spark.createDataFrame([(1, "a"), (2, "a")], "id int, s string").createOrReplaceTempView("answers_t")
    c = console.Console(spark)
    assert c.run(c.ask("how many rows in answers_t", {"answers_t": ["id", "s"]})).first()[0] == 2


def test_tables_by_the_parser(spark):
    names = lambda sql: console.tables_in(spark, sql)
    assert names("WITH c AS (SELECT * FROM a) SELECT * FROM c JOIN db.b ON c.x = b.x WHERE y = 'FROM z' -- FROM w") == ["a", "db.b"]
    assert names("SELECT (SELECT max(x) FROM inner_t) FROM outer_t WHERE k IN (SELECT k FROM third)") == ["inner_t", "outer_t", "third"]
    assert names("DROP TABLE gone") == ["gone"] and names("INSERT INTO target SELECT * FROM `odd name`") == ["odd name", "target"]
    assert names("UPDATE t SET x = 1") == ["t"] and names("not sql FROM t") == ["t"]


def test_split_bounds_are_asked_of_the_database(spark):
    from tidewater.sources import jdbc

    class Fake(jdbc.Connector):
        asked = None

        def query(self, sql):
            self.asked = sql
            return self.spark.createDataFrame([(3, 90)], "low_ int, high_ int")

    seen = {}

    class Reader:
        def format(self, _):
            return self

        def options(self, **o):
            seen.update(o)
            return self

        def load(self):
            return None

    class Session:
        read, createDataFrame = Reader(), spark.createDataFrame

    c = Fake(Session(), "SQLite", "f")
    c.load_table("t", split="k")
    assert "MIN(k)" in c.asked and (seen["lowerBound"], seen["upperBound"], seen["partitionColumn"]) == ("3", "91", "k")
