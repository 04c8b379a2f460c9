"""Settings and the descriptions that the stages of a cleaning run hand to one another."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """Thresholds of a run. compat_*: reproduce a known oddity instead of the corrected behaviour."""

    categorical_unique_ratio: float = 0.05
    categorical_max_unique: int = 50
    min_non_ascii_ratio: float = 0.01
    entity_threshold: int = 80
    dedup_threshold: int = 82
    typo_threshold: int = 85
    typo_max_values: int = 100
    typo_min_count: int = 3
    iqr_multiplier: float = 1.5
    z_threshold: float = 3.0
    advisor_chunk: int = 25
    min_money_share: float = 0.5
    compat_gov_id: bool = False
    compat_email_at: bool = False
    compat_numeric_keys: bool = False
    compat_bounds: bool = False


@dataclass(frozen=True)
class ColumnSchema:
    """What a column means, and how its gaps may be filled."""

    semantic_type: str
    imputation_strategy: str = "leave_empty"
    confidence: float = 0.0
    needs_multilingual: bool = False
    non_ascii_ratio: float = 0.0
    is_critical_business: bool = False
    is_target: bool = False
    description: str = ""


@dataclass(frozen=True)
class CleaningStrategy:
    imputation: str
    normalization: str
    deduplication: str
    needs_multilingual: bool = False


@dataclass(frozen=True)
class ImputationRule:
    target_column: str
    condition: str
    fill_value: str
    confidence: int = 50


@dataclass
class Audit:
    """Entries of an audit trail, in the order the steps ran."""

    entries: list[tuple] = field(default_factory=list)

    def add(self, step_number: int, step: str, column: str = "", task: str = "", original: str = "", cleaned: str = "", explanation: str = "", severity: str = "info") -> None:
        self.entries.append((step, step_number, column, task, original, cleaned, explanation, severity))
