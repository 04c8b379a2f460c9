"""The stages of a cleaning run that look at one row at a time, on a streaming DataFrame.

Normalisation, domain rules without aggregates and fills with given values are expressions, so the same code runs on a stream. What
needs the whole table (statistics, maps by distinct value, deduplication) is decided on a batch table first and handed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import CleaningStrategy
from ..functions import text as X
from ..operators.rules import DOMAINS, replace
from ..operators.shared import q, strings
from ..plans.pipeline import normalised

#: Domains whose rules need no aggregate of the table.
ROW_LOCAL = tuple(d for d in DOMAINS if d != "E-Commerce")


def clean_stream(df: DataFrame, strategies: dict[str, CleaningStrategy], domain: str | None = None, fills: dict[str, object] | None = None) -> DataFrame:
    """Strings cleaned, columns normalised, domain rules applied, gaps filled with values decided before."""
    df = replace(df, {c: X.clean_string(q(c)) for c in strings(df)})
    kinds = dict(df.dtypes)
    df = replace(df, {c: normalised(q(c), s.normalization, c) for c, s in strategies.items() if c in df.columns and kinds[c] == "string"})
    if domain in ROW_LOCAL:
        df = DOMAINS[domain](df)
    return df.fillna({c: v for c, v in (fills or {}).items() if c in df.columns}) if fills else df


def run_available(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Cleans what there is and stops; run again, it takes up what came since."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
