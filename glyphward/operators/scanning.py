"""Scanning: texts in, findings and an overall severity out, in one narrow projection."""

from __future__ import annotations

import warnings
from dataclasses import fields

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphward.functions.severity import RANKS, name_of
from glyphward.functions.text import folded, is_blank, let, strip
from glyphward.operators.registry import DEFAULT, all_packs, pack_for_text, resolve
from glyphward.operators.rules import PackLike, Rule

FINDING = "struct<id:string,category:string,severity:string,start:int,end:int,excerpt:string,message:string,suggestion:string,confidence:double>"
WHITE_SPACE = "(whitespace)"
LOW, ACTIVE = "__folded", "__active"


def _found(rule: Rule, ordinal: int, text: Column, low: Column) -> Column:
    """The findings of a rule with what they are ordered by in front: severity, category, rule, place among its matches."""

    def finding(s: Column, i: Column) -> Column:
        shown = strip(s["excerpt"])
        return F.struct(
            F.lit(-RANKS[rule.severity]).alias("by_severity"),
            F.lit(rule.category).alias("category"),
            F.lit(ordinal).alias("ordinal"),
            i.alias("nth"),
            F.lit(rule.id).alias("id"),
            F.lit(rule.severity).alias("severity"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.when(shown == "", F.lit(WHITE_SPACE)).otherwise(shown).alias("excerpt"),
            F.lit(rule.message).alias("message"),
            F.lit(rule.suggestion).cast("string").alias("suggestion"),
            F.lit(float(rule.confidence)).alias("confidence"),
        )

    return F.transform(rule.spans(text, low), finding)


def _first_of_each(found: Column) -> Column:
    """Of findings of one rule id with equal starts, the first."""
    placed = F.sort_array(F.transform(found, lambda f, i: F.struct(f["start"].alias("start"), i.alias("i"), f.alias("f"))))
    first = let(placed, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["start"] != x["start"])))
    return F.transform(first, lambda x: x["f"])


def _every_match(pack: PackLike) -> bool:
    """Whether a pack keeps all findings of a rule; others keep the first of those with one start."""
    return getattr(pack, "every_match", False)


def optional_active(text: Column, pack: PackLike, force: Column) -> Column:
    return ~is_blank(text) & (force | pack.wants_optional(text))


def findings(text: Column, pack: PackLike, force: Column | bool = False, low: Column | None = None, active: Column | None = None) -> Column:
    """array of findings, most severe first, then by category, rule and place; empty for blank and null texts.

    ``low`` (see :func:`folded`) and ``active`` (see :func:`optional_active`) may be columns that hold them already.
    """
    low = folded(text) if low is None else low
    force = F.lit(force) if isinstance(force, bool) else force
    active = optional_active(text, pack, force) if active is None else active
    none = F.array().cast("array<struct<by_severity:int,category:string,ordinal:int,nth:int,id:string,severity:string,start:int,end:int,excerpt:string,message:string,suggestion:string,confidence:double>>")
    parts: dict[str, list[Column]] = {}
    for i, rule in enumerate(pack.rules):
        part = _found(rule, i, text, low)
        parts.setdefault(rule.id, []).append(F.when(active, part).otherwise(none) if rule.optional else part)
    # matches of one pattern never start at one place
    clash = set() if _every_match(pack) else {r.id for r in pack.rules if r.kind != "pattern" or len(parts[r.id]) > 1}
    every = F.concat(none, *(_first_of_each(F.concat(none, *own)) if name in clash else own[0] if len(own) == 1 else F.concat(none, *own) for name, own in parts.items()))
    shown = F.transform(F.sort_array(every), lambda f: F.struct(*(f[c].alias(c) for c in ("id", "category", "severity", "start", "end", "excerpt", "message", "suggestion", "confidence"))))
    return F.when(is_blank(text), F.array().cast(f"array<{FINDING}>")).otherwise(shown.cast(f"array<{FINDING}>"))


_built: dict[tuple, Column] = {}
MOST_BUILT = 32


def _findings_by_columns(pack: PackLike, text_col: str) -> Column:
    """:func:`findings` over the columns that a scan makes.

    Such a column is some thousand calls to the JVM and says nothing of the rows, so it is kept for
    the next scan by the same rules.
    """
    text, low, active = F.coalesce(F.col(text_col), F.lit("")), F.col(LOW), F.coalesce(F.col(ACTIVE), F.lit(False))
    try:
        key = (SparkContext._active_spark_context.applicationId, text_col, _every_match(pack), tuple(pack.rules))
        found = _built.get(key)
    except TypeError:  # rules from elsewhere need not be hashable
        return findings(text, pack, False, low, active)
    if found is None:
        while len(_built) >= MOST_BUILT:
            del _built[next(iter(_built))]
        found = _built[key] = findings(text, pack, False, low, active)
    return found


def overall(found: Column) -> Column:
    """The greatest severity; low both without findings and with low ones only."""
    ranks = F.transform(found, lambda f: F.element_at(F.create_map(*(F.lit(x) for p in RANKS.items() for x in p)), f["severity"]))
    return name_of(F.array_max(ranks))


def scan(df: DataFrame, pack: PackLike | str | None = None, text_col: str = "text", force_optional: Column | bool = False) -> DataFrame:
    """``df`` with columns pack, findings, overall_risk, token_count and optional_rules_active (null for blank texts).

    Every row is scanned by itself: no shuffle, and the same on a stream. A null text counts as blank.
    """
    pack = resolve(pack)
    text = F.coalesce(F.col(text_col), F.lit(""))
    force = F.lit(force_optional) if isinstance(force_optional, bool) else force_optional
    # what several rules ask for is computed once, in a projection below
    held = df.withColumns({LOW: folded(text), ACTIVE: F.when(~is_blank(text), optional_active(text, pack, force))})
    out = held.withColumn("findings", _findings_by_columns(pack, text_col))
    return out.withColumns(
        {
            "pack": F.lit(pack.name),
            "overall_risk": overall(F.col("findings")),
            "token_count": F.when(is_blank(text), F.lit(0)).otherwise(pack.estimate_tokens(text)),
            "optional_rules_active": F.col(ACTIVE),
        }
    ).drop(LOW, ACTIVE)


def scan_text(df: DataFrame, pack: PackLike | str | None = None, force_optional: bool = False) -> DataFrame:
    return scan(df, pack, force_optional=force_optional)


def scan_prompt(df: DataFrame, designer_mode: bool = False) -> DataFrame:
    return scan(df, DEFAULT, force_optional=designer_mode)


def scan_by(df: DataFrame, pack_col: str = "pack", text_col: str = "text", force_optional: bool = False) -> DataFrame:
    """As :func:`scan`, each row by the pack that its column names, in one pass; packs that there are not count as the default."""
    text, force = F.coalesce(F.col(text_col), F.lit("")), F.lit(force_optional)
    known = all_packs()
    name = F.when(F.col(pack_col).isin(*known), F.col(pack_col)).otherwise(DEFAULT)
    held = df.withColumn("pack", name).withColumn(LOW, folded(text))

    def each(value) -> Column:
        out = None
        for n, p in known.items():
            out = F.when(F.col("pack") == n, value(p)) if out is None else out.when(F.col("pack") == n, value(p))
        return out

    held = held.withColumn(ACTIVE, F.when(~is_blank(text), each(lambda p: optional_active(text, p, force))))
    out = held.withColumn("findings", each(lambda p: _findings_by_columns(p, text_col)))
    return out.withColumns(
        {
            "overall_risk": overall(F.col("findings")),
            "token_count": F.when(is_blank(text), F.lit(0)).otherwise(each(lambda p: p.estimate_tokens(text))),
            "optional_rules_active": F.col(ACTIVE),
        }
    ).drop(LOW, ACTIVE)


def scan_routed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row by the pack that :func:`pack_for_text` names for it."""
    return scan_by(df.withColumn("pack", pack_for_text(F.coalesce(F.col(text_col), F.lit("")))), "pack", text_col)


def explode_findings(scanned: DataFrame, *keys: str) -> DataFrame:
    """A row for each finding, with its position from 0.

    The array goes through a filter that keeps everything: of a plain column the optimizer would
    pull every field that is used out below the generator, and so scan the text once for each.
    """
    whole = F.filter("findings", lambda f: f["id"].isNotNull())
    return scanned.select(*keys, F.posexplode(whole).alias("position", "finding")).select(*keys, "position", "finding.*")


def register_rule(rule, pack: PackLike | str = DEFAULT) -> None:
    """Deprecated: add a rule to a pack at run time. Make a pack instead.

    Any object with the attributes of a rule will do; what it lacks takes a rule's defaults, and one
    without an id is passed over with a warning.
    """
    warnings.warn("register_rule is deprecated; make a pack", DeprecationWarning, stacklevel=2)
    defaults = {"category": "custom", "severity": "medium", "message": "A registered rule matches.", "suggestion": None}
    values = {f.name: getattr(rule, f.name, defaults.get(f.name, f.default)) for f in fields(Rule)}
    if not isinstance(values["id"], str) or values["severity"] not in RANKS:
        warnings.warn(f"{rule!r} is no rule", stacklevel=2)
        return
    resolve(pack).rules.append(Rule(**values))
