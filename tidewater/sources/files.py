"""Reading and writing files."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as X
from ..operators.rules import replace
from ..operators.shared import numbered, q, strings

EXTENSIONS = (".csv", ".tsv", ".xlsx", ".xls", ".parquet", ".orc", ".json", ".jsonl")


def check_file(path: str, most_mb: int | None = None) -> str:
    """The extension of a local file that is there, is of a known kind and, if a size is given, isn't larger."""
    kind = os.path.splitext(path)[1].lower()
    if kind not in EXTENSIONS:
        raise ValueError(f"unsupported file type {kind!r}; known are {', '.join(EXTENSIONS)}")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if most_mb is not None and os.path.isfile(path) and os.path.getsize(path) > most_mb << 20:
        raise ValueError(f"{path} has more than {most_mb} MB")
    return kind


def tidy_names(df: DataFrame) -> DataFrame:
    """Column names without a byte-order mark and outer white space."""
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def missing_to_null(df: DataFrame) -> DataFrame:
    return replace(df, {c: X.load_missing(q(c)) for c in strings(df)})


def read_csv(spark: SparkSession, path: str, infer: bool = True, encoding: str = "UTF-8", multiline: bool = False, **options) -> DataFrame:
    """CSV with a header. Markers of missing values are read as null before types are inferred. multiline: values may hold line
    ends; such files can't be split, so each is one task."""
    reader = spark.read.options(header=True, inferSchema=infer, encoding=encoding, multiLine=multiline, escape='"', **options)
    return missing_to_null(tidy_names(reader.csv(path)))


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A sheet of a workbook, read on the driver (a workbook holds a million rows at most). Needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl, which is not installed") from e
    import pandas as pd

    return missing_to_null(tidy_names(spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table by its extension; a path without a known one is Parquet."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in (".csv", ".tsv"):
        return read_csv(spark, path, **({"sep": "\t"} if kind == ".tsv" else {}), **options)
    if kind in (".xls", ".xlsx"):
        return read_excel(spark, path, **options)
    if kind in (".json", ".jsonl"):
        return missing_to_null(tidy_names(spark.read.json(path, multiLine=kind == ".json", **options)))
    return missing_to_null(tidy_names(spark.read.orc(path) if kind == ".orc" else spark.read.parquet(path)))


def with_row_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """df with consecutive _rid in the order of some columns; Spark tables have no order of their own."""
    return numbered(df, order)


def timestamped(folder: str, name: str, extension: str) -> str:
    return f"{folder.rstrip('/')}/{name}_{time.strftime('%Y%m%d_%H%M%S')}{extension}"


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; single: one file, written by one task."""
    (df.coalesce(1) if single else df).write.csv(path, header=True, mode="errorifexists", escape='"')


def write_excel(df: DataFrame, path: str, most_rows: int = 1_000_000) -> None:
    """A workbook of a small result, written on the driver."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("writing workbooks needs openpyxl, which is not installed") from e
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows don't fit in a sheet")
    df.toPandas().to_excel(path, index=False)


def write_audit(audit: DataFrame, path: str) -> None:
    """The audit trail as JSON lines."""
    audit.write.json(path, mode="errorifexists")


def write_report(text: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def save_session(df: DataFrame, metadata: dict, folder: str) -> None:
    """A table and its metadata, to go on later. Anything that looks like a credential is left out."""
    df.write.mode("overwrite").parquet(f"{folder}/table")
    kept = {k: v for k, v in metadata.items() if not any(w in k.lower() for w in ("password", "secret", "token", "credential"))}
    row = [(json.dumps(kept, default=str),)]
    df.sparkSession.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def load_session(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/table"), json.loads(spark.read.text(f"{folder}/metadata").first()[0])
