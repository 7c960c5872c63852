"""Results on the driver: what a row of a scan holds, as objects."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from enum import StrEnum
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from glyphward.functions.severity import RANKS, SEVERITIES
from glyphward.operators.scanning import scan
from glyphward.packs.prompt_safety import CATEGORIES

Severity = StrEnum("Severity", {s.upper(): s for s in SEVERITIES})
RiskCategory = StrEnum("RiskCategory", {c.id.upper(): c.id for c in CATEGORIES})


@dataclass(frozen=True)
class Finding:
    id: str
    category: str
    severity: str
    start: int
    end: int
    excerpt: str
    message: str
    suggestion: str | None = None
    confidence: float = 0.82

    @property
    def short_category(self) -> str:
        return self.category.replace("_", " ").title()


@dataclass(frozen=True)
class ScanResult:
    text: str
    findings: list[Finding] = field(default_factory=list)
    overall_risk: str = "low"
    token_count: int = 0
    pack: str | None = None
    context: dict[str, Any] = field(default_factory=dict)
    scanned_at: datetime | None = None
    remix_suggestion: str | None = None
    remix_diff: list[str] | None = None

    def __post_init__(self) -> None:
        self.findings.sort(key=lambda f: (-RANKS[f.severity], f.category))

    @property
    def counts(self) -> dict[str, int]:
        return {s: sum(f.severity == s for f in self.findings) for s in SEVERITIES}

    @property
    def has_critical(self) -> bool:
        return self.counts["critical"] > 0

    @property
    def has_high_or_worse(self) -> bool:
        return self.has_critical or self.counts["high"] > 0

    @property
    def is_designer(self) -> bool:
        """Whether the optional rules were active."""
        return bool(self.context.get("designer_mode"))

    @property
    def status_line(self) -> str:
        shown = ", ".join(f"{n} {s}" for s, n in reversed(self.counts.items()) if n)
        return shown or "No issues detected."

    @classmethod
    def of(cls, row: Row, text_col: str = "text") -> ScanResult:
        """From a collected row of :func:`stamped`, of a plain scan, or of a rewritten one."""
        held = row.asDict()
        found = [Finding(**f.asDict()) for f in row["findings"]]
        return cls(row[text_col] or "", found, row["overall_risk"], row["token_count"], row["pack"], dict(held.get("context") or {}), held.get("scanned_at"), held.get("rewritten"), held.get("diff"))


def stamped(scanned: DataFrame) -> DataFrame:
    """``scanned`` with scanned_at, the time of the run, and context, a map of what the pack noted. Not part of a scan itself, whose rows are the same in every run."""
    designer = F.create_map(F.lit("designer_mode"), F.col("optional_rules_active"))
    return scanned.withColumns({"scanned_at": F.current_timestamp(), "context": F.when(F.col("optional_rules_active").isNotNull(), designer)})


def scan_one(df: DataFrame, pack: str | None = None, text_col: str = "text") -> ScanResult:
    """The result of the first row."""
    return ScanResult.of(stamped(scan(df, pack, text_col)).first(), text_col)
