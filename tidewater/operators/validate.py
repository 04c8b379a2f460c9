"""Validation of a cleaned table: problem counts and scores by column, and rules across columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import numbers as N
from ..functions import text as X
from .rules import date_pair
from .shared import numbers, q, rows_frame, stats_row, strings


def _parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def email_problem(x: Column) -> Column:
    """placeholder, invalid, or null for a sound address."""
    return F.when(x.rlike(K.DUMMY_EMAIL), "placeholder").when(~x.rlike(K.VALID_EMAIL), "invalid")


def phone_problem(x: Column) -> Column:
    """no digits, same digit, characters or length, the first that holds; null for a sound number."""
    d = F.regexp_replace(x, r"\D", "")
    return (
        F.when(d == "", "no digits").when(F.replace(d, F.left(d, F.lit(1)), F.lit("")) == "", "same digit").when(~x.rlike(r"^\+?\d+$"), "characters").when(~F.length(d).between(7, 15), "length")
    )


def problems(df: DataFrame, column: str, kind: str) -> DataFrame:
    """problem, n of the comma-separated parts of a column; kind: email or phone."""
    found = {"email": email_problem, "phone": phone_problem}[kind](F.col("part"))
    return df.select(F.explode(_parts(q(column))).alias("part")).select(found.alias("problem")).where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))


def _count(c: Column, kind: str) -> Column:
    test = {"email": email_problem, "phone": phone_problem}[kind]
    return F.coalesce(F.sum(F.size(F.filter(_parts(c), lambda x: test(x).isNotNull()))), F.lit(0))


def negatives(df: DataFrame) -> DataFrame:
    """column, n of negative values of numeric columns that should have none by their names."""
    cols = [c for c in numbers(df) if any(w in c.lower() for w in K.POSITIVE_WORDS)]
    s = stats_row(df, {c: F.count_if(q(c) < 0) for c in cols})
    return rows_frame(df.sparkSession, list(s.items()), "column string, n long")


def sentinels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n of values that stand for nothing."""
    s = stats_row(df, {c: F.count_if(q(c).isin(list(K.SENTINELS))) for c in columns or numbers(df)})
    return rows_frame(df.sparkSession, list(s.items()), "column string, n long")


def paradoxes(df: DataFrame, order: str, delivery: str) -> DataFrame:
    kinds = dict(df.dtypes)
    date = lambda c: q(c) if kinds[c] in ("date", "timestamp") else N.parse_date(q(c))
    return df.agg(F.count_if(date(delivery) < date(order)).alias("paradoxes"))


def excess_discounts(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(N.to_number(q(column)) > 100).alias("excess"))


def column_scores(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """column, semantic_type, score of each column, from 100 down: non-ASCII in categories and names (its share, 50 at
    most), over half missing (20), empty strings (10), bad emails or phones (5 each, 40 at most), negatives (3). One job."""
    text = strings(df)
    items: dict = {"n": F.count("*")}
    for c in df.columns:
        kind = types.get(c, "")
        items[c, "null"] = F.count_if(q(c).isNull())
        if c in text:
            items[c, "empty"] = F.count_if(F.trim(q(c)) == "")
            if kind in ("Categorical", "Name"):
                items[c, "foreign"] = F.avg(X.has_non_ascii(q(c)).cast("int"))
            if kind in ("Email", "Phone"):
                items[c, "bad"] = _count(q(c), kind.lower())
        elif c in numbers(df) and any(w in c.lower() for w in K.POSITIVE_WORDS):
            items[c, "negative"] = F.count_if(q(c) < 0)
    s = stats_row(df, items)
    rows = []
    for c in df.columns:
        get = lambda k, c=c: s.get((c, k)) or 0
        score = 100.0 - min(50.0, 100.0 * get("foreign")) - 20.0 * bool(s["n"] and get("null") / s["n"] > 0.5) - 10.0 * bool(get("empty")) - min(40.0, 5.0 * get("bad")) - 3.0 * bool(get("negative"))
        rows.append((c, types.get(c, ""), max(0.0, round(score, 4))))
    return rows_frame(df.sparkSession, rows, "column string, semantic_type string, score double")


def validate(df: DataFrame, types: dict[str, str]) -> tuple[float, DataFrame, DataFrame]:
    """(mean column score to one place, column scores, violations of rules across columns: rule, n)."""
    scores = column_scores(df, types)
    mean = scores.agg(F.avg("score")).first()[0]
    found: list[tuple[str, int]] = []
    order, delivery = date_pair([c for c in df.columns if types.get(c) == "Temporal"])
    if order and delivery:
        found.append((f"{delivery} before {order}", paradoxes(df, order, delivery).first()[0]))
    discount = next((c for c in df.columns if "discount" in c.lower() and "amount" not in c.lower()), None)
    if discount:
        found.append((f"{discount} over 100", excess_discounts(df, discount).first()[0]))
    numeric = [c for c in numbers(df) if types.get(c) == "Numeric"]
    found += [(f"sentinels in {c}", n) for c, n in stats_row(df, {c: F.count_if(q(c).isin(list(K.SENTINELS))) for c in numeric}).items()]
    return round(mean or 100.0, 1), scores, rows_frame(df.sparkSession, [x for x in found if x[1]], "rule string, n long")
