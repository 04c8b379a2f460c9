"""What columns and data sets are: semantic types, domain, intent, tiers, relations. Pure functions on small aggregates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ColumnSchema, Config
from ..functions import constants as K
from ..functions import text as X
from .impute import sensitive
from .rules import RULE_COLUMNS
from .shared import distinct_counts, numbers, q, rows_frame, stats_row, strings


@dataclass(frozen=True)
class ColumnFacts:
    """What classify() needs of a column."""

    name: str
    kind: str
    unique: int = 0
    total: int = 0
    non_ascii: float = 0.0
    words: float = 0.0
    currency: float = 0.0
    structured: float = 0.0


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    return "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string" if isinstance(t, T.StringType) else "other"


def column_facts(df: DataFrame, order: list[str]) -> list[ColumnFacts]:
    """Facts of all columns: one aggregate over the table, and the first 50 rows in the order for patterns."""
    text = strings(df)
    unique = distinct_counts(df, {c: q(c) for c in text})
    items = {(c, "n"): F.count(q(c)) for c in text} | {(c, "a"): F.avg(X.has_non_ascii(F.trim(q(c))).cast("int")) for c in text}
    s = stats_row(df, items)
    head = stats_row(
        df.orderBy(*[q(c) for c in order]).select(*[q(c) for c in text]).limit(50),
        {(c, "m"): F.avg(q(c).rlike(K.CURRENCY_SIGNS).cast("int")) for c in text} | {(c, k): F.avg(q(c).rlike(p).cast("int")) for c in text for k, p in K.STRUCTURED_IDS.items()},
    ) if text else {}
    words = stats_row(df.orderBy(*[q(c) for c in order]).select(*[q(c) for c in text]).limit(20), {c: F.avg(F.size(F.array_remove(F.split(q(c), r"\s+"), ""))) for c in text}) if text else {}
    out = []
    for f in df.schema:
        c = f.name
        if c in text:
            out.append(ColumnFacts(c, "string", unique[c], s[c, "n"], s[c, "a"] or 0.0, words[c] or 0.0, head[c, "m"] or 0.0, max(head[c, k] or 0.0 for k in K.STRUCTURED_IDS)))
        else:
            out.append(ColumnFacts(c, _kind(f.dataType)))
    return out


def classify(facts: ColumnFacts, config: Config = Config()) -> tuple[str, float, bool]:
    """(semantic type, confidence, needs translation), by words in the name, then type, then content; patterns override."""
    name = facts.name.lower().replace(" ", "_")
    foreign = facts.non_ascii > config.min_non_ascii_ratio
    if any(w in name for w in K.GEO_WORDS):
        return "Geospatial", 0.92, False
    if facts.kind == "string" and facts.currency > 0.3:
        return "Currency", 0.92, False
    if facts.kind == "string" and facts.structured > 0.5:
        return "Structured_ID", 0.92, False
    low = name.replace("-", "_")
    for kind, words in K.NAME_WORDS.items():
        if any(w in low for w in words):
            return kind, K.NAME_CONFIDENCE[kind], foreign and kind in ("Name", "Location")
    if facts.kind == "numeric":
        return "Numeric", 0.85, False
    if facts.kind == "date":
        return "Temporal", 0.85, False
    if facts.kind == "string":
        if facts.unique < config.categorical_max_unique or facts.unique < config.categorical_unique_ratio * max(facts.total, 1):
            return "Categorical", 0.80, foreign
        return ("Name", 0.60, foreign) if 1.5 <= facts.words <= 4 else ("Free_Text", 0.50, foreign)
    return "Free_Text", 0.40, foreign


def infer_schema(df: DataFrame, order: list[str], intent: str = "Non-Predictive Business", time_series: bool = False, targets: tuple[str, ...] = (), config: Config = Config()) -> dict[str, ColumnSchema]:
    """ColumnSchema of every column, with imputation defaults and guards applied."""
    out = {}
    words = tuple(w for w in K.SENSITIVE_WORDS if w not in K.NOT_SCHEMA_SENSITIVE)
    for facts in column_facts(df, order):
        kind, confidence, foreign = classify(facts, config)
        business = intent == "Non-Predictive Business"
        critical = business and (kind in K.CRITICAL_TYPES or sensitive(facts.name, words))
        target = facts.name in targets
        strategy = "fill_none" if critical or target else "fill_forward" if time_series and kind == "Numeric" else K.DEFAULT_IMPUTATION.get(kind, "leave_empty")
        out[facts.name] = guarded(ColumnSchema(kind, strategy, confidence, foreign, facts.non_ascii, critical, target))
    return out


def guarded(s: ColumnSchema) -> ColumnSchema:
    """Critical columns and targets never keep a statistical strategy."""
    if s.imputation_strategy in K.STATISTICAL and (s.is_target or s.is_critical_business):
        strategy = "leave_empty" if s.is_target else "fill_none"
        return ColumnSchema(s.semantic_type, strategy, s.confidence, s.needs_multilingual, s.non_ascii_ratio, s.is_critical_business, s.is_target, s.description)
    return s


def semantic_types(df: DataFrame, order: list[str]) -> DataFrame:
    """column, semantic_type, confidence, imputation of each column."""
    rows = [(c, s.semantic_type, s.confidence, s.imputation_strategy) for c, s in infer_schema(df, order).items()]
    return rows_frame(df.sparkSession, rows, "column string, semantic_type string, confidence double, imputation string")


def domain_words() -> dict[str, list[str]]:
    """The default vocabulary, by rule: for each domain that data can be about, the words of its name and the words of column
    names that its rules act on. Domains without rules are known by their names alone."""
    out = {}
    for domain in K.SUB_INTENT:
        if domain != "Generic":
            name = domain.lower().replace("-", "_").replace(" ", "_")
            out[domain] = sorted({name, *RULE_COLUMNS.get(domain, ())})
    return out


def domain_scores(df: DataFrame, order: list[str], words: dict[str, list[str]] | None = None, first_rows: int | None = 20) -> DataFrame:
    """domain, score: 1 for each column whose name has one of the domain's words, 0.5 for each value of a string column that has
    one, of the first rows in the order; first_rows None: of all rows, counted in one aggregate. words: a vocabulary, a list of
    words for each domain; by default domain_words()."""
    vocabulary = words or domain_words()
    names = [c.lower().replace(" ", "_") for c in df.columns]
    if first_rows is None:
        each = df.select(F.explode(F.array(*[F.lower(q(c)) for c in strings(df)])).alias("v")) if strings(df) else df.select(F.lit(None).cast("string").alias("v"))
        hits = stats_row(each, {d: F.count_if(reduce(Column.__or__, (F.contains("v", F.lit(w)) for w in ws), F.lit(False))) for d, ws in vocabulary.items()})
        return rows_frame(df.sparkSession, [(d, float(sum(any(w in n for w in ws) for n in names)) + 0.5 * hits[d]) for d, ws in vocabulary.items()], "domain string, score double")
    head = df.orderBy(*[q(c) for c in order]).select(*[F.lower(q(c)).alias(c) for c in strings(df)]).limit(first_rows).collect() if strings(df) else []
    values = [v for r in head for v in r if v is not None]
    rows = [(d, float(sum(any(w in n for w in ws) for n in names)) + 0.5 * sum(any(w in v for w in ws) for v in values)) for d, ws in vocabulary.items()]
    return rows_frame(df.sparkSession, rows, "domain string, score double")


def best_domain(scores: DataFrame) -> str:
    rows = scores.collect()
    top = max(rows, key=lambda r: r["score"]) if rows else None
    return top["domain"] if top and top["score"] > 0 else "Generic"


def intent_of(df: DataFrame) -> str:
    """Predictive or Non-Predictive Business, by names, then by numeric share and 0/1 columns."""
    low = [c.lower() for c in df.columns]
    if any(w in c for c in low for w in K.PREDICTIVE_WORDS):
        return "Predictive"
    share = len(numbers(df)) / max(len(df.columns), 1)
    contact = any(w in c for c in low for w in ("email", "phone", "mobile", "name"))
    keyed = any(w in c for c in low for w in ("customer_id", "patient_id", "employee_id"))
    if share > 0.65 and not contact and not keyed:
        return "Predictive"
    if share > 0.5 and not contact:
        s = stats_row(df, {c: F.max((~q(c).isin(0, 1)).cast("int")) for c in numbers(df)})
        if any(v is None or v == 0 for v in s.values()):
            return "Predictive"
    return "Non-Predictive Business"


def is_time_series(columns: list[str]) -> bool:
    return any(w in c.lower() for c in columns for w in K.TIME_WORDS)


def is_gov_id(column: str, compat: bool = False) -> bool:
    """Does a name hold an identifier's words in a row? compat: words that are joined by _ are never found."""
    name = column.lower().replace(" ", "_").replace("_", " ")
    return any(re.search(rf"\b{re.escape(w if compat else w.replace('_', ' '))}\b", name) for w in K.GOV_ID_WORDS)


@dataclass(frozen=True)
class Tiers:
    """Columns by what they can tell about identity."""

    gov: tuple[str, ...] = ()
    email: tuple[str, ...] = ()
    phone: tuple[str, ...] = ()
    address: tuple[str, ...] = ()
    name: tuple[str, ...] = ()
    other: tuple[str, ...] = ()

    @property
    def contacts(self) -> tuple[str, ...]:
        return self.gov + self.email + self.phone + self.address


def tiers(columns: list[str], strategies: dict[str, str] | None = None, compat: bool = False) -> Tiers:
    strategies = strategies or {}
    out: dict[str, list[str]] = {k: [] for k in ("gov", "email", "phone", "address", "name", "other")}
    for c in columns:
        low, how = c.lower().replace(" ", "_"), strategies.get(c, "")
        if "mail" in low:
            out["email"].append(c)
        elif any(w in low for w in K.PHONE_WORDS):
            out["phone"].append(c)
        elif is_gov_id(c, compat):
            out["gov"].append(c)
        elif how == "exact_match":
            out["other"].append(c)
        elif any(w in low for w in K.ADDRESS_WORDS):
            out["address"].append(c)
        elif how == "fuzzy_name" or "name" in low and how not in ("none", "blocking_key"):
            out["name"].append(c)
    return Tiers(**{k: tuple(v) for k, v in out.items()})


def question_intent(question: str) -> str:
    low = question.lower()
    return "write" if any(w in low for w in K.WRITE_WORDS) else "read"


def relations(tables: dict[str, list[str]], foreign_keys: list[tuple[str, str, str, str]] = ()) -> list[tuple[str, str, str, str, str]]:
    """(from_table, from_col, to_table, to_col, type): given foreign keys, then columns of the same key-like name, and `id`
    with `<table>_id`. An edge and its reverse count once, the first stays."""
    out: dict[frozenset, tuple[str, str, str, str, str]] = {}
    for a, x, b, y in foreign_keys:
        out.setdefault(frozenset([(a, x), (b, y)]), (a, x, b, y, "FK"))
    for a, cols in tables.items():
        singular = a.rstrip("s").lower()
        ids = {f"{n}{j}id" for n in (a.lower(), singular) for j in ("_", "")}
        for b, others in tables.items():
            for x in cols if a != b else ():
                for y in others:
                    same = x.lower() == y.lower() and any(w in x.lower() for w in K.RELATION_WORDS)
                    if same or x.lower() == "id" and y.lower() in ids:
                        out.setdefault(frozenset([(a, x), (b, y)]), (a, x, b, y, "Inferred"))
    return list(out.values())


def infer_primary_key(table: str, columns: list[str]) -> list[str]:
    wanted = {"id", f"{table.lower()}_id", f"{table.rstrip('s').lower()}_id"}
    return next(([c] for c in columns if c.lower() in wanted), [])


def levels(tables: list[str], depends: dict[str, list[str]]) -> dict[str, int]:
    """Longest chain of tables that each table depends on; a cycle counts as 0 where it closes."""
    found: dict[str, int] = {}

    def level(t: str) -> int:
        if t not in found:
            found[t] = 0
            found[t] = max((level(d) + 1 for d in depends.get(t, [])), default=0)
        return found[t]

    for t in tables:
        level(t)
    return found
