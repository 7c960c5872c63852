"""Strings and patterns that a user has listed in a TOML file.

The file is read on the driver; its entries become literals inside the plan, so executors need no
configuration.
"""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphward.functions.text import is_blank, let, no_spans, span
from glyphward.operators.rewriting import chunks_of, from_the_end, part_of, replace_apart, replace_spans
from glyphward.operators.rules import Category, Pack, Rule, python_matches, repeats_a_group

CONFIG_VARIABLE = "GLYPHWARD_PERSONAL_CONFIG"
NOT_CONFIGURED = "personal_info_not_configured"
NOTHING_FOUND = "none of the listed strings or patterns is in the text."
SLUG_LENGTH = 32


def config_path() -> Path:
    """From the environment, else below the user's configuration folder."""
    if own := os.environ.get(CONFIG_VARIABLE):
        return Path(own).expanduser()
    base = os.environ.get("XDG_CONFIG_HOME")
    return (Path(base) if base else Path.home() / ".config") / "glyphward" / "personal.toml"


def read_config(path: Path) -> dict[str, Any] | None:
    """None for a missing, unreadable or malformed file."""
    try:
        return tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError):
        return None


def entries(config: dict[str, Any], section: str) -> list[tuple[str, str]]:
    """(category, text) of a section, blank ones left out."""
    table = config.get(section)
    lists = table.items() if isinstance(table, dict) else ()
    return [(category, x) for category, values in lists if isinstance(values, list) for x in values if isinstance(x, str) and x.strip()]


def _slug(text: str) -> str:
    return re.sub(r"\W+", "_", text.lower())[:SLUG_LENGTH]


def _literal(text: str) -> str:
    """A pattern for the text itself, whole words where it begins and ends with a letter or digit."""
    quoted = "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in text)
    return rf"\b{quoted}\b" if text[0].isalnum() and text[-1].isalnum() else quoted


# Syntax that Java reads as Python does. Anything else, and whatever can match the empty string, is left to Python.
_SHARED = re.compile(r"(?:[^\\()\[\]{}|*+?^$]|\\[dDwWsSbB.\-+*?()\[\]{}|^$/]|\((?!\?)|\(\?:|\)|\[\^?[A-Za-z0-9_.@ %+-]+\]|\{\d+(?:,\d*)?\}|[|*+?^$])*")


def runs_in_java(pattern: str) -> bool:
    compiled = re.compile(pattern, re.IGNORECASE)
    return bool(_SHARED.fullmatch(pattern)) and not repeats_a_group(pattern) and not compiled.search("") and not any(m.end() == m.start() for t in ("a", "1 a", "\n") for m in compiled.finditer(t))


def build_rules(config: dict[str, Any]) -> list[Rule]:
    """A rule for each listed string, then for each listed pattern; broken patterns are passed over."""
    rules = []
    for category, text in entries(config, "strings"):
        rules.append(Rule(f"personal_{category}_{_slug(text)}", category, "high", f"A listed string stands in the text: {category.replace('_', ' ')}.", "Redact or replace it before sharing.", pattern=_literal(text), confidence=0.99))
    for category, pattern in entries(config, "regex"):
        try:
            native = runs_in_java(pattern)
        except re.error:
            continue
        own: dict[str, Any] = {"pattern": pattern} if native else {"python": python_matches(pattern)}
        rules.append(Rule(f"personal_{category}_re_{_slug(pattern)}", category, "high", f"A listed pattern matches the text: {category.replace('_', ' ')}.", "Redact or replace it before sharing.", confidence=0.95, **own))
    return rules


def build_categories(config: dict[str, Any]) -> list[Category]:
    keys = dict.fromkeys(k for section in ("strings", "regex") if isinstance(config.get(section), dict) for k in config[section])
    return [Category(k, k.replace("_", " ").title(), f"Personal {k.replace('_', ' ')}") for k in keys]


def _first_character(text: Column) -> Column:
    return F.when(is_blank(text), no_spans()).otherwise(F.array(span(F.lit(0), F.least(F.length(text), F.lit(1)), F.lit("(no config)"))))


SETUP = Rule(NOT_CONFIGURED, "setup", "low", "No strings or patterns are listed yet.", f"List them in the file that {CONFIG_VARIABLE} names.", columns=_first_character, confidence=1.0)


@dataclass
class PersonalInfoPack(Pack):
    name: str = "personal-info"
    label: str = "Personal Info"
    description: str = "The user's own list of names, addresses and code words."
    path: Path | None = None
    config: dict[str, Any] | None = None
    configured: bool = field(default=False, init=False)

    def __post_init__(self) -> None:
        self.reload()

    def reload(self) -> None:
        """Read the file again, unless a configuration was given as a dictionary."""
        config = self.config if self.config is not None else read_config(self.path or config_path())
        self.configured = config is not None
        self.rules = build_rules(config or {}) or [SETUP]
        self.categories = build_categories(config or {}) or [Category("setup", "Setup")]

    def rewrite(self, text: Column, findings: Column, designer: Column) -> Column | None:
        """struct(rewritten, notes): each finding replaced by its category, from the last start to the first; overlaps are cut into as they come."""
        if not self.configured:
            return None
        real = F.filter(findings, lambda f: f["id"] != NOT_CONFIGURED)
        put = lambda s: F.concat(F.lit("[REDACTED:"), s["category"], F.lit("]"))

        def note(held: Column, f: Column) -> Column:
            shown = F.when(F.length(held) > 60, F.concat(F.substring(held, 1, 57), F.lit("…"))).otherwise(held)
            return F.concat(F.lit("redacted: “"), shown, F.lit("” → "), f["put"])

        def add(s: Column, f: Column) -> Column:
            held = F.substring(s["text"], f["start"] + 1, f["end"] - f["start"])
            return F.struct(replace_spans(s["text"], F.array(f)).alias("text"), F.concat(F.array(note(held, f)), s["notes"]).alias("notes"))

        def one_by_one(spans: Column) -> Column:
            start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("notes"))
            return F.aggregate(spans, start, add, lambda s: F.struct(s["text"].alias("rewritten"), s["notes"].alias("notes")))

        def at_once(spans: Column, chunks: Column) -> Column:
            """Spans apart hold what the text as scanned has there."""
            notes = F.transform(F.reverse(spans), lambda f: note(part_of(text, chunks, f["start"], f["end"] - f["start"]), f))
            return F.struct(replace_apart(text, spans, chunks).alias("rewritten"), notes.alias("notes"))

        def done(spans: Column) -> Column:
            apart = ~F.exists(F.transform(spans, lambda s, i: F.coalesce(s["end"] > F.get(spans, i - 1)["start"], F.lit(False))), lambda x: x)
            return F.when(apart, let(chunks_of(text, spans), lambda chunks: at_once(spans, chunks))).otherwise(one_by_one(spans))

        return F.when(F.size(real) > 0, let(from_the_end(real, put), done)).otherwise(F.struct(text.alias("rewritten"), F.array(F.lit(NOTHING_FOUND)).alias("notes")))
