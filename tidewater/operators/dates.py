"""The order of day and month in a column of dates, by what the whole column supports.

`03/04/2021` can be read two ways; `25/04/2021` somewhere in the same column settles it. One aggregate over all columns counts,
for each separator, the values that can only have the day first and those that can only have the month first; the counts of
parts of a table add up, so votes of new data can be added to old ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from .shared import q

#: Day, separator, month (or the other way round), year.
SHAPE = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$"
#: What is first if a column doesn't tell: the day, but for slashes.
DAY_FIRST = {"/": False, "-": True, ".": True}
_TIME = r"(?<=\d)[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"


def _parts(c: Column) -> tuple[Column, Column, Column, Column]:
    """(first, separator, second, year) of texts of the shape; empty separator and nulls for others."""
    s = F.coalesce(F.regexp_replace(F.trim(c.cast("string")), _TIME, ""), F.lit(""))
    number = lambda g: F.regexp_extract(s, SHAPE, g).try_cast("int")
    return number(1), F.regexp_extract(s, SHAPE, 2), number(3), number(4)


def votes(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, separator, n (values of the shape), day_first, month_first (values that can be read only so)."""
    each = []
    for c in columns:
        a, s, b, _ = _parts(q(c))
        each.append(F.struct(F.lit(c).alias("column"), s.alias("separator"), a.alias("a"), b.alias("b")))
    rows = df.select(F.explode(F.array(*each)).alias("x")).select("x.*").where("separator != ''")
    return rows.groupBy("column", "separator").agg(F.count("*").alias("n"), F.count_if((F.col("a") > 12) & (F.col("b") <= 12)).alias("day_first"), F.count_if((F.col("b") > 12) & (F.col("a") <= 12)).alias("month_first"))


def decide(found: DataFrame) -> dict[str, dict[str, bool]]:
    """For each column and separator: does the day come first? The majority of what tells, else DAY_FIRST; a column's other
    separators that tell nothing follow its majority. A row for each column and separator reaches the driver."""
    rows = found.groupBy("column", "separator").agg(F.sum("day_first").alias("d"), F.sum("month_first").alias("m")).collect()
    out: dict[str, dict[str, bool]] = {}
    for c in {r["column"] for r in rows}:
        mine = [r for r in rows if r["column"] == c]
        lead = sum(r["d"] - r["m"] for r in mine)
        out[c] = {r["separator"]: r["d"] > r["m"] if r["d"] != r["m"] else lead > 0 if lead else DAY_FIRST[r["separator"]] for r in mine}
    return out


def parse(df: DataFrame, columns: list[str], decided: dict[str, dict[str, bool]] | None = None) -> DataFrame:
    """df with columns as ISO dates (text); what is no date is null.

    Texts of the shape are read in the order decided for their column and separator (by default from df itself), or in the only
    order that gives a date; all others by N.parse_date. decided: what decide() gave for this or an earlier part of the data.
    """
    decided = decide(votes(df, columns)) if decided is None else decided

    def read(c: str) -> Column:
        a, s, b, year = _parts(q(c))
        day_first = F.lit(None).cast("boolean")
        for sign, default in DAY_FIRST.items():
            day_first = F.when(s == sign, F.lit(decided.get(c, {}).get(sign, default))).otherwise(day_first)
        day_first = F.when((a > 12) & (b <= 12), True).when((b > 12) & (a <= 12), False).otherwise(day_first)
        text = F.format_string("%04d-%02d-%02d", year, F.when(day_first, b).otherwise(a), F.when(day_first, a).otherwise(b))
        return F.date_format(F.when(s != "", F.try_to_date(text, "yyyy-MM-dd")).otherwise(N.parse_date(q(c))), "yyyy-MM-dd")

    return df.select(*[read(c).alias(c) if c in columns else q(c) for c in df.columns])
