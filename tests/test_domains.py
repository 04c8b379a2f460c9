"""Domain scores of all values of a table."""

from tidewater.operators import audit, classify


def test_top_domains_see_every_row(spark):
    rows = [(i, "retail" if i >= 20 else None) for i in range(30)]  # beyond the first 20 rows
    df = spark.createDataFrame(rows, "i int, note string")
    scores = classify.domain_scores(df, ["i"], first_rows=None)
    assert [tuple(r) for r in audit.top_domains(scores, 2).collect()] == [("Retail", 5.0), ("Agriculture", 0.0)]
    assert {r["score"] for r in classify.domain_scores(df.select("i"), ["i"], first_rows=None).collect()} == {0.0}
