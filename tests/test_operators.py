"""Operators on hand-written frames, and properties."""

import random

from pyspark.sql import functions as F

from tidewater.config import ImputationRule
from tidewater.functions import fuzzy
from tidewater.operators import classify, currency, dedup, filters, graph, impute, mapping, outliers, profile, rules, validate
from tidewater.operators.shared import numbered


def test_profile_counts_markers_and_duplicates(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (2, " a ", 1.0), (3, "NA", None), (4, "b", float("nan"))], "id int, name string, x double")
    got = {r["column"]: (r["null_count"], r["n_unique"]) for r in profile.profile_columns(df).collect()}
    assert got == {"id": (0, 4), "name": (1, 3), "x": (2, 1)}
    assert profile.exact_duplicate_count(df).first()[0] == 1


def test_profile_of_empty_table(spark):
    df = spark.createDataFrame([], "id int, name string, x double")
    assert profile.quality_score(df).first()["quality_score"] == 100.0
    assert profile.exact_duplicate_count(df).first()[0] == 0
    assert profile.completeness(df).first()["completeness"] == 100.0


def test_filters(spark):
    df = spark.createDataFrame([("test user", "nomail", "x"), ("Ann", "a@b.co", None), (None, None, None), ("Bo", None, None)], "name string, email string, city string")
    assert {r["name"] for r in filters.dummy_filter(df, ["name", "email"]).collect()} == {"Ann", None, "Bo"}
    assert [r["name"] for r in filters.critical_filter(df).orderBy("name").collect()] == ["Ann", "test user"]
    kept = filters.drop_exact_duplicates(spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1)], "id int, s string, n int"), ["id"])
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]


def test_conditions(spark):
    df = spark.createDataFrame([("B2B ", 5.0), (None, None), ("x", -3.0)], "kind string, n double")
    hit = lambda text: [r[0] for r in df.select(rules.condition(df, text)).collect()]
    assert hit("kind == 'b2b'") == [True, False, False]
    assert hit("kind != 'b2b'") == [False, True, True]
    assert hit("n >= 5") == [True, False, False]
    assert hit("n < -2") == [False, False, True]
    assert hit("nonsense") == hit("other == 'x'") == [False] * 3


def test_fills_never_change_what_is_there(spark):
    random.seed(3)
    rows = [(i, random.choice([None, float(i)]), random.choice([None, "a", "b", "?"])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, x double, s string")
    for how in ("fill_mean", "fill_median", "fill_forward", "fill_backward", "fill_interpolate"):
        got = {r["i"]: r["x"] for r in impute.fill(df, "x", how, ["i"]).collect()}
        assert len(got) == 200 and all(got[i] == x for i, x, _ in rows if x is not None)
        if how == "fill_interpolate":
            assert all(abs(v - i) < 20 for i, v in got.items())
    assert {r["s"] for r in impute.fill(df, "s", "fill_mode").collect()} == {"a", "b"}


def test_interpolation_at_the_edges(spark):
    df = spark.createDataFrame([(0, None), (1, 1.0), (2, None), (3, None), (4, 4.0), (5, None)], "i int, x double")
    assert [r["x"] for r in impute.fill(df, "x", "fill_interpolate", ["i"]).orderBy("i").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_rules_and_guard(spark):
    df = spark.createDataFrame([(None, "B2B", None), ("x", "B2B", "1")], "priority string, kind string, email string")
    out = impute.apply_rules(df, [ImputationRule("priority", "kind == 'b2b'", "Low", 10), ImputationRule("priority", "kind == 'b2b'", "High", 90), ImputationRule("email", "kind == 'b2b'", "made@up.com", 90)])
    assert [tuple(r) for r in out.orderBy("priority").collect()] == [("High", "B2B", None), ("x", "B2B", "1")]


def test_knn_fills(spark):
    df = spark.createDataFrame([(i, float(i), float(i) if i % 5 else None) for i in range(50)], "_rid int, x double, y double")
    got = {r["_rid"]: r["y"] for r in impute.knn(df, ["x", "y"]).collect()}
    assert all(abs(v - i) <= 5 for i, v in got.items())


def test_outliers(spark):
    df = spark.createDataFrame([(i, float(x), None if i == 3 else float(x)) for i, x in enumerate([1, 2, 3, 4, 5, 1000])], "i int, x double, age double")
    assert outliers.bounds_for("credit_score") == (300, 900) and outliers.bounds_for("credit_score", compat=True) == (0, 100) and outliers.bounds_for("language_id") is None
    out, report = outliers.treat_outliers(df, columns=["x", "age"])
    assert max(r["x"] for r in out.collect()) < 1000 and sum(r["age"] is None for r in out.collect()) == 1
    assert {r["column"]: r["method"] for r in report.collect()} == {"x": "iqr", "age": "domain_cap"}


def test_validation_counts(spark):
    df = spark.createDataFrame([("a@b.co, nomail",), ("bad",), (None,), ("",)], "email string")
    assert {r["problem"]: r["n"] for r in validate.problems(df, "email", "email").collect()} == {"placeholder": 1, "invalid": 1}
    phones = spark.createDataFrame([("1111111",), ("12-3",), ("123",), ("+1234567",), ("x",)], "phone string")
    assert {r["problem"]: r["n"] for r in validate.problems(phones, "phone", "phone").collect()} == {"same digit": 1, "characters": 1, "length": 1, "no digits": 1}


def test_classification():
    kind = lambda name, k="string", **f: classify.classify(classify.ColumnFacts(name, k, **f))[0]
    assert [kind("Email"), kind("hotel_tel"), kind("latitude"), kind("x", "numeric"), kind("x", "date")] == ["Email", "Phone", "Geospatial", "Numeric", "Temporal"]
    assert kind("x", unique=3, total=10) == "Categorical" and kind("x", unique=90, total=100, words=2.0) == "Name" and kind("x", unique=90, total=100, words=9.0) == "Free_Text"
    assert classify.is_gov_id("customer_id") and not classify.is_gov_id("customer_id", compat=True) and not classify.is_gov_id("company_name")
    assert classify.levels(["a", "b", "c"], {"b": ["a"], "c": ["b"]}) == {"a": 0, "b": 1, "c": 2}
    assert classify.relations({"users": ["id"], "orders": ["user_id", "id"]})[0][:4] == ("users", "id", "orders", "user_id")


def test_currency_detection(spark):
    df = spark.createDataFrame([("$5", "x"), ("10 EUR", "y"), ("7", "z")], "price string, note string")
    assert currency.detect(df) == ["price"]
    assert [r[0] for r in currency.convert(df).select("price").collect()] == [417.5, 901.0, 7.0]


def test_mapping(spark):
    df = spark.createDataFrame([("b2b",), ("Retail",), ("RETAIL",), (None,)], "kind string")
    assert sorted(str(r[0]) for r in mapping.apply_map(df, "kind", mapping.categorical_map(df, "kind")).collect()) == ["B2B", "None", "Retail", "Retail"]
    names = spark.createDataFrame([("Raj Sharma",), ("Raj Sharma",), ("Raj Sharam",), ("Zoe",)], "name string")
    assert {r["name"]: r["canonical"] for r in mapping.name_clusters(names, "name").collect()} == {"Raj Sharma": "Raj Sharma", "Raj Sharam": "Raj Sharma", "Zoe": "Zoe"}
    typos = spark.createDataFrame([("high",)] * 4 + [("urgent",)] * 3 + [("hgih",), ("urgnt",), ("low",)], "u string")
    assert {r[0] for r in mapping.standardize_case(typos, "u").collect()} == {"High", "Hgih", "Urgent", "Low"}


def test_name_clusters_equal_all_pairs(spark, monkeypatch):
    random.seed(8)
    base = ["Catherine Smith", "Raj Sharma", "Émile Zola", "Li", "Anne-Marie du Pont", "Ян Ким", "Zoe Ng", "Ravi  kumar"]
    names = ["Katherine Smith", " ", "", "x"] + base
    for _ in range(150):
        x = list(random.choice(base))
        for _ in range(random.randrange(4)):
            x[random.choice([0, random.randrange(len(x))])] = random.choice("abkzXé ")
        names.append("".join(x))
    names += random.choices(names, k=100)
    count = {x: names.count(x) for x in names}
    clusters = []  # of [opening name, members]
    for x in sorted(count):
        for c in clusters:
            if fuzzy.token_sort_ratio(x.lower(), c[0].lower()) >= 80:
                c[1].append(x)
                break
        else:
            clusters.append([x, [x]])
    wanted = {x: min(c[1], key=lambda y: (-count[y], -len(y), y)) for c in clusters for x in c[1]}
    assert wanted["Catherine Smith"] == wanted["Katherine Smith"]
    df = spark.createDataFrame([(x,) for x in [*names, None]], "name string")
    for batch in (7, 4096):
        monkeypatch.setattr(mapping, "BATCH", batch)
        assert {r["name"]: r["canonical"] for r in mapping.name_clusters(df, "name").collect()} == wanted
    assert mapping.name_clusters(df.limit(0), "name").count() == 0


def test_components_equal_union_find(spark):
    random.seed(5)
    for n, m in ((30, 20), (60, 80), (10, 0)):
        edges = [(random.randrange(n), random.randrange(n)) for _ in range(m)]
        parent = list(range(n))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
        got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in {v for a, b in edges if a != b for v in (a, b)}}


PEOPLE = "name string, email string, phone string, city string, pan string"


def run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row int, " + PEOPLE)
    return dedup.deduplicate(df, ["row"])[0].drop("row").collect()


def test_same_identifier_merges_and_keeps_both_contacts(spark):
    got = run(spark, [("Raj Sharma", "a@x.co", "9876543210", "delhi", "ABCDE1234F"), ("Raj Sharma", "b@x.co", None, "pune", "ABCDE1234F")])
    assert len(got) == 1 and got[0]["email"] == "a@x.co, b@x.co" and got[0]["phone"] == "9876543210"


def test_partial_duplicate_is_backfilled(spark):
    got = run(spark, [("Raj Sharma", "a@x.co", None, None, None), ("Raj Sharam", "a@x.co", "9876543210", "delhi", None)])
    assert len(got) == 1 and got[0]["phone"] == "9876543210"


def test_shared_contact_of_different_people_stays(spark):
    assert len(run(spark, [("Raj Sharma", "a@x.co", "9876543210", None, None), ("Meera Patel", "a@x.co", "9876543210", None, None)])) == 2


def test_same_name_without_other_match_stays(spark):
    assert len(run(spark, [("Raj Sharma", "a@x.co", None, "delhi", None), ("Raj Sharma", "b@y.co", None, "pune", None)])) == 2


def test_different_identifiers_block(spark):
    assert len(run(spark, [("Raj Sharma", "a@x.co", None, None, "ABCDE1234F"), ("Raj Sharma", "a@x.co", None, None, "XYZDE1234F")])) == 2


def test_result_does_not_depend_on_row_order(spark):
    rows = [(i, f"Ann {'ab'[i % 2]} Lee", f"u{i // 3}@x.co", None, None, None) for i in range(12)]
    df = spark.createDataFrame(rows, "row int, " + PEOPLE)
    a = dedup.deduplicate(df, ["row"])[0].collect()
    b = dedup.deduplicate(df.orderBy(F.desc("row")), ["row"])[0].collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_neighbourhood_makes_few_pairs(spark):
    df = numbered(spark.createDataFrame([(i, "same") for i in range(300)], "row int, name string"), ["row"])
    assert dedup.sorted_neighbourhood(df, "name").count() == 299


def test_changes_and_conflicts(spark):
    rows = [(0, 0, "Asha Rao", "P1"), (1, 0, "Asha  Raoo", "P1"), (2, 0, None, "P2"), (3, 3, "Ivan", None)]
    df = spark.createDataFrame(rows, "_rid long, _cid long, full_name string, pan string")
    links = spark.createDataFrame([(0, 1, True, "same identifier"), (0, 2, True, "same name"), (0, 3, False, "skip")], "rid_a long, rid_b long, link boolean, reason string")
    got = dedup.changes(df, classify.Tiers(name=("full_name",), gov=("pan",)), links).collect()
    assert [tuple(r) for r in got] == [(0, "Asha  Raoo", "Asha Rao", 3, 2, {"same identifier": 1, "same name": 1})]
    pairs = spark.createDataFrame([(0, 1), (0, 2), (2, 3)], "rid_a long, rid_b long")
    assert {(r["rid_a"], r["rid_b"]): r["conflict"] for r in dedup.conflicts(df, pairs, ["pan"]).collect()} == {(0, 1): False, (0, 2): True, (2, 3): False}
