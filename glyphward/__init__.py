"""glyphward: a Spark-native text linting, redaction and corpus engine."""

__version__ = "0.2.0"

from glyphward.operators.registry import get_pack, list_packs, pack_for_file, pack_for_text
from glyphward.operators.reports import check, rewrite, with_summary
from glyphward.operators.results import Finding, RiskCategory, ScanResult, Severity
from glyphward.operators.rules import Category, Pack, Rule, Template
from glyphward.operators.scanning import explode_findings, register_rule, scan, scan_by, scan_prompt, scan_routed, scan_text
from glyphward.sources.traces import scan_trace

PackRule = Rule
RiskLevel = Severity

__all__ = [
    "Category", "Finding", "Pack", "PackRule", "RiskCategory", "RiskLevel", "Rule", "ScanResult", "Severity", "Template", "__version__",
    "check", "explode_findings", "get_pack", "list_packs", "pack_for_file", "pack_for_text", "register_rule", "rewrite", "scan", "scan_by", "scan_prompt", "scan_routed", "scan_text", "scan_trace", "with_summary",
]
