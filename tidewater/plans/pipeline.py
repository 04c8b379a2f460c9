"""The cleaning run: profile, classify, plan, clean, filter, convert, standardise, resolve, deduplicate, fill, clip, validate.

Each stage first decides (a small aggregate, then pure functions on the driver) and then applies (a lazy transformation), so
a run takes a number of jobs that depends on its stages, not on its columns. Between stages the table is written to the shared
folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..config import Audit, CleaningStrategy, ColumnSchema, Config, ImputationRule
from ..functions import numbers as N
from ..functions import text as X
from ..operators import classify, currency, dates, dedup, filters, impute, mapping, outliers, profile, rules, validate
from ..operators.audit import change_counts, trail
from ..operators.shared import forget, q, strings, written
from .advisor import Advisor, gated, spot_check
from .planner import plan


@dataclass
class Result:
    """A cleaned table with what was found out on the way. changes: if tracked, every different change of a cell by step and column
    (see audit.change_counts)."""

    table: DataFrame
    metadata: dict
    audit: DataFrame
    clusters: DataFrame | None = None
    schema: dict[str, ColumnSchema] = field(default_factory=dict)
    strategies: dict[str, CleaningStrategy] = field(default_factory=dict)
    changes: DataFrame | None = None


def normalised(c: Column, how: str, name: str) -> Column:
    """The normalisation of one column that needs no look at other rows."""
    return {
        "title_case": X.title_case, "uppercase_strip": X.upper_strip, "normalize_email": X.normalize_email, "normalize_phone": X.normalize_phone,
        "coerce_numeric": lambda x: N.coerce_numeric(x, name), "parse_dates": N.iso_date,
    }.get(how, lambda x: x)(c)


def standardise(df: DataFrame, strategies: dict[str, CleaningStrategy], advisor: Advisor | None = None) -> DataFrame:
    """Normalises all columns; those rewritten by distinct value are mapped one after the other."""
    kinds = dict(df.dtypes)
    direct = {c: normalised(q(c), s.normalization, c) for c, s in strategies.items() if c in df.columns and (kinds[c] == "string" or s.normalization == "coerce_numeric" and kinds[c] not in ("date", "timestamp", "boolean"))}
    dated = [c for c in direct if strategies[c].normalization == "parse_dates"]
    df = rules.replace(df, {c: v for c, v in direct.items() if c not in dated})
    df = dates.parse(df, dated) if dated else df
    translate = advisor.translate if advisor else None
    for c, s in strategies.items():
        if c not in df.columns or kinds[c] != "string":
            continue
        if s.normalization == "standardize_case":
            df = mapping.standardize_case(df, c)
        elif s.normalization == "translate_to_english":
            df = mapping.apply_map(df, c, mapping.categorical_map(df, c, translate))
        elif s.normalization == "transliterate_name":
            df = mapping.apply_map(df, c, mapping.name_map(df, c, translate))
    return df


def loaded(df: DataFrame) -> DataFrame:
    """Words that files write for a missing value become null."""
    return rules.replace(df, {c: X.load_missing(q(c)) for c in strings(df)})


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores, in turn. Files are read by bytes, so many rows that compress well are one task's, and so is what is
    written of them, stage after stage."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def clean_texts(df: DataFrame, order: list[str]) -> DataFrame:
    """All texts but the order's without markup, odd characters and surplus white space."""
    return rules.replace(df, {c: X.clean_string(q(c)) for c in strings(df) if c not in order})


def clean(df: DataFrame, order: list[str], domain: str | None = None, intent: str | None = None, targets: tuple[str, ...] = (), extra_rules: list[ImputationRule] | None = None, advisor: Advisor | None = None, config: Config = Config(), track: bool = False) -> Result:
    """Cleans a table. order: columns whose order counts as the rows' (ties and `first` go by it); they are kept as they are.
    track: also compares every stage with the one before, cell by cell, by the order's columns."""
    audit, spark, changes = Audit(), df.sparkSession, []

    def compared(before: DataFrame, after: DataFrame, number: int, step: str) -> DataFrame:
        if track:
            changes.append(written(change_counts(before, after, order, number, step), "clean-changes"))
        return after

    df = compared(df, written(loaded(dealt(df)), "clean-loaded"), 1, "load")
    n0 = df.count()
    score0 = profile.quality_score(df).first()["quality_score"]
    audit.add(1, "profile", task="quality score", original=str(score0), explanation=f"{n0} rows")
    domain = domain or classify.best_domain(classify.domain_scores(df, order))
    intent = intent or classify.intent_of(df)
    series = classify.is_time_series(df.columns)
    audit.add(2, "domain", task=domain, explanation=intent)
    schema = classify.infer_schema(df, order, intent, series, targets, config)
    if advisor:
        refined = gated(schema, advisor.refine_schema([r.asDict() for r in profile.column_profile(df, order).collect()], schema))
        schema = {c: classify.guarded(s) for c, s in refined.items()}
    strategies = {c: s for c, s in plan(schema, intent).items() if c not in order}
    for c, s in schema.items():
        audit.add(3, "schema", c, s.semantic_type, explanation=s.imputation_strategy)
    df = filters.drop_missing_targets(df, list(targets))
    # the filters look at all texts twice; written, they are cleaned once
    raw, df = df, (texts := written(clean_texts(df, order), "clean-texts"))
    types = {c: s.semantic_type for c, s in schema.items()}
    df = filters.quality_filter(df, types, [c for c, t in types.items() if t in ("Email", "Name", "ID_Code", "Phone")])
    df = compared(raw, written(df, "clean-filtered"), 5, "text")
    forget(texts)
    n1 = df.count()
    audit.add(5, "filter", task="rows", original=str(n0), cleaned=str(n1), severity="remove" if n1 < n0 else "info")
    money = currency.detect(df, config.min_money_share)
    for c in money:
        audit.add(6, "currency", c, "to rupees", severity="change")
    df0, df = df, standardise(currency.convert(df, money), {c: s for c, s in strategies.items() if c not in money}, advisor)
    df = compared(df0, written(rules.domain_rules(df, domain), "clean-standard"), 7, "standard")
    standard = df
    names = [c for c, s in strategies.items() if s.deduplication == "fuzzy_name" and c in df.columns]
    for c in names:
        df = mapping.resolve_names(df, c, config.entity_threshold)
    roles = {c: s.deduplication for c, s in strategies.items()}
    merge = dedup.is_master_data(intent, domain)
    resolved = compared(standard, written(df, "clean-resolved"), 7, "names")
    df, clusters = dedup.deduplicate(resolved, order, roles, not merge, config)
    df = compared(resolved, written(df, "clean-deduplicated"), 8, "dedup")
    n2 = df.count()
    audit.add(8, "dedup", task="rows", original=str(n1), cleaned=str(n2), severity="remove" if n2 < n1 else "info")
    merged = df
    df = impute.apply_rules(df, extra_rules or (advisor.rules([], schema) if advisor else []))
    fills = {c: s.imputation for c, s in strategies.items() if c in df.columns}
    df, values = impute.apply_statistical(df, fills, order, guard=intent == "Non-Predictive Business")
    for c, v in values.items():
        audit.add(9, "impute", c, fills[c], cleaned=str(v), severity="fix")
    df = compared(merged, written(df, "clean-filled"), 9, "impute")
    numeric = [c for c in df.columns if types.get(c) == "Numeric" and c not in order and c not in targets]
    treated, report = outliers.treat_outliers(df, intent, config.iqr_multiplier, config.z_threshold, config.compat_bounds, numeric)
    for r in report.collect():
        audit.add(10, "outliers", r["column"], r["method"], explanation=f"{r['lower']} to {r['upper']}")
    df = compared(df, written(filters.drop_exact_duplicates(treated, order), "clean-final"), 10, "outliers")
    score, scores, found = validate.validate(df, types)
    for r in found.collect():
        audit.add(11, "validate", task=r["rule"], explanation=str(r["n"]), severity="warning")
    metadata = {"rows_in": n0, "rows_filtered": n1, "rows_deduplicated": n2, "rows_out": df.count(), "domain": domain, "intent": intent, "sub_intent": classify.K.SUB_INTENT.get(domain, "Master Data"), "time_series": series, "quality_before": score0, "confidence": score}
    for remark in spot_check(df, order[0], advisor):
        audit.add(12, "spot check", explanation=remark, severity="warning")
    every = spark.read.schema(changes[0].schema).parquet(*[c.written_to for c in changes]) if changes else None
    return Result(df, metadata, trail(spark, audit), clusters, schema, strategies, every)


__all__ = ["Result", "clean", "clean_texts", "dealt", "loaded", "normalised", "standardise"]
