"""Optional helpers a run may ask: none is needed, and none is called by default."""

from __future__ import annotations

import json
import re
from typing import Protocol

from pyspark.sql import DataFrame

from ..config import ColumnSchema, ImputationRule
from ..operators.profile import sample_rows

#: A schema that an advisor refines with less confidence than this stays as it was.
LEAST_CONFIDENCE = 0.6


class Advisor(Protocol):
    """Refines what heuristics decided, e.g. with a language model."""

    def refine_schema(self, profile: list[dict], schema: dict[str, ColumnSchema]) -> dict[str, ColumnSchema]: ...

    def rules(self, profile: list[dict], schema: dict[str, ColumnSchema]) -> list[ImputationRule]: ...

    def translate(self, values: list[str]) -> dict[str, str]: ...

    def sql(self, question: str, tables: dict[str, list[str]]) -> str: ...

    def spot_check(self, rows: list[dict]) -> list[str]: ...


def parse_reply(text: str) -> object:
    """The JSON of an advisor's reply: without reasoning tags and code fences, the first value that parses; commas before a
    closing bracket, comments, single quotes and brackets that are missing at the end are mended. None if there is none."""
    text = re.sub(r"(?s)<think(?:ing)?>.*?(?:</think(?:ing)?>|\Z)", "", text)
    text = re.sub(r"```(?:\w+)?", "", text)
    start = re.search(r"[\[{]", text)
    if not start:
        return None
    body = text[start.start() :].strip()
    for mend in (lambda x: x, _tidied, lambda x: _closed(_tidied(x)), lambda x: _closed(_tidied(re.sub(r"'", '"', x)))):
        try:
            return json.JSONDecoder().raw_decode(mend(body))[0]
        except ValueError:
            continue
    return None


def _tidied(x: str) -> str:
    return re.sub(r",\s*([\]}])", r"\1", re.sub(r"(?m)^\s*//.*$", "", x))


def _closed(x: str) -> str:
    """x with the string and brackets closed that it leaves open."""
    open_, quoted, skip = [], False, False
    for ch in x:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "[{":
            open_.append("]" if ch == "[" else "}")
        elif ch in "]}" and open_:
            open_.pop()
    return re.sub(r",\s*$", "", x + '"' * quoted) + "".join(reversed(open_))


def gated(before: dict[str, ColumnSchema], after: dict[str, ColumnSchema], least: float = LEAST_CONFIDENCE) -> dict[str, ColumnSchema]:
    """What an advisor made of a schema, where it is confident; unknown columns are ignored."""
    return before | {c: s for c, s in after.items() if c in before and s.confidence >= least}


def spot_check(df: DataFrame, key: str, advisor: Advisor | None, n: int = 5) -> list[str]:
    """Remarks of the advisor on n rows taken by digest; none without an advisor."""
    return advisor.spot_check([r.asDict() for r in sample_rows(df, key, n).collect()]) if advisor else []
