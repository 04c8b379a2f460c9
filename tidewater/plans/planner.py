"""From semantic types to a cleaning plan."""

from __future__ import annotations

from ..config import CleaningStrategy, ColumnSchema

# Normalisation and deduplication role by semantic type, and the imputation that the type imposes (none: the
# schema's own).
_PLAN = {
    "Location": (None, "title_case", "blocking_key"), "Name": ("fill_none", "title_case", "fuzzy_name"), "Email": ("fill_none", "normalize_email", "none"), "Phone": ("fill_none", "normalize_phone", "none"),
    "ID_Code": ("fill_none", "uppercase_strip", "none"), "Financial": ("fill_none", "none", "none"), "URL": ("leave_empty", "none", "none"), "Geospatial": ("leave_empty", "coerce_numeric", "none"),
    "Currency": ("fill_none", "coerce_numeric", "none"), "Structured_ID": ("fill_none", "uppercase_strip", "none"), "Categorical": (None, "standardize_case", "none"), "Temporal": (None, "parse_dates", "none"),
    "Binary_Flag": (None, "coerce_numeric", "none"), "Score_Rating": (None, "coerce_numeric", "none"), "Percentage": (None, "coerce_numeric", "none"), "Numeric": (None, "coerce_numeric", "none"),
}
_IF_EMPTY = {"Binary_Flag": "fill_mode", "Score_Rating": "fill_median", "Percentage": "fill_median"}
_FOREIGN = {"Location": "translate_to_english", "Name": "transliterate_name", "Categorical": "translate_to_english"}


def strategy_for(schema: ColumnSchema, intent: str = "Non-Predictive Business") -> CleaningStrategy:
    """The strategy of one column. Numeric gaps are left in business data and take the median otherwise, unless the schema says
    something else."""
    kind = schema.semantic_type
    imposed, normal, role = _PLAN.get(kind, ("leave_empty", "none", "none"))
    fill = imposed or schema.imputation_strategy or "leave_empty"
    if imposed is None and fill == "leave_empty" and not schema.is_target:
        fill = _IF_EMPTY.get(kind, "fill_median" if kind == "Numeric" and intent == "Predictive" else fill)
    foreign = schema.needs_multilingual and kind in _FOREIGN
    return CleaningStrategy(fill, _FOREIGN[kind] if foreign else normal, role, foreign)


def plan(schema: dict[str, ColumnSchema], intent: str = "Non-Predictive Business") -> dict[str, CleaningStrategy]:
    return {c: strategy_for(s, intent) for c, s in schema.items()}
