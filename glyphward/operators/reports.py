"""Aggregates and reports over scanned rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphward.functions.severity import GLYPHS, RANKS, SEVERITIES, rank
from glyphward.functions.text import let, strip
from glyphward.operators.registry import BUILT_IN, DEFAULT, all_packs, resolve
from glyphward.operators.rewriting import with_unified_diff
from glyphward.operators.rules import PackLike
from glyphward.operators.scanning import WHITE_SPACE, overall, scan, scan_by

MOST_GROUPS = 25
EXTRA_EXCERPTS = 4
NO_ISSUES = "No issues detected."


def _number(found: Column, severity: str) -> Column:
    return F.size(F.filter(found, lambda f: f["severity"] == severity))


def finding_counts(found: Column) -> Column:
    """map of every severity to its number of findings."""
    return F.map_from_arrays(F.array(*map(F.lit, SEVERITIES)), F.array(*(_number(found, s) for s in SEVERITIES)))


def status_line(found: Column) -> Column:
    """As in "1 critical, 2 high", the worst first; a sentence if there is nothing."""
    parts = [_number(found, s) for s in reversed(SEVERITIES)]
    shown = F.concat_ws(", ", *(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {s}"))) for n, s in zip(parts, reversed(SEVERITIES), strict=True)))
    return F.when(F.size(found) > 0, shown).otherwise(NO_ISSUES)


def with_summary(scanned: DataFrame) -> DataFrame:
    """``scanned`` with n_findings, finding_counts, has_critical, has_high_or_worse, is_designer and status_line."""
    found = F.col("findings")
    return scanned.withColumns(
        {
            "n_findings": F.size(found),
            "finding_counts": finding_counts(found),
            "has_critical": F.exists(found, lambda f: f["severity"] == "critical"),
            "has_high_or_worse": F.exists(found, lambda f: f["severity"].isin("critical", "high")),
            "is_designer": F.coalesce(F.col("optional_rules_active"), F.lit(False)),
            "status_line": status_line(found),
        }
    )


def check(scanned: DataFrame, fail_on: str = "high") -> DataFrame:
    """``scanned`` with failed: whether the overall severity reaches ``fail_on``. A row without findings is low, so low always fails."""
    if fail_on not in RANKS:
        raise ValueError(f"fail_on is one of {', '.join(SEVERITIES)}")
    return scanned.withColumn("failed", rank(F.col("overall_risk")) >= RANKS[fail_on])


def exit_code(scanned: DataFrame, fail_on: str = "high") -> int:
    """1 if any row fails, else 0."""
    return int(bool(check(scanned, fail_on).agg(F.bool_or("failed")).first()[0]))


def short_category(category: Column) -> Column:
    return F.initcap(F.translate(category, "_", " "))


def grouped_by_rule(scanned: DataFrame, *keys: str) -> DataFrame:
    """(keys, place, id, first finding's fields, n, extra_excerpts): the findings of a row by rule in order of their first, MOST_GROUPS at most, and how many more rules there are.

    Within a row of ``scanned``, so without a shuffle.
    """

    def group(ids: Column) -> Column:
        def one(i: Column) -> Column:
            own = F.filter("findings", lambda f: f["id"] == i)
            return F.struct(F.get(own, F.lit(0)).alias("first"), F.size(own).alias("n"), F.slice(F.transform(own, lambda f: f["excerpt"]), 2, EXTRA_EXCERPTS).alias("extra_excerpts"))

        return F.transform(F.slice(ids, 1, MOST_GROUPS), one)

    ids = F.array_distinct(F.transform("findings", lambda f: f["id"]))
    held = scanned.select(*keys, let(ids, group).alias("groups"), F.greatest(F.size(ids) - MOST_GROUPS, F.lit(0)).alias("n_more"))
    whole = F.filter("groups", lambda g: g["n"] > 0)  # everything; of a plain column the optimizer would pull out every field below the generator
    return held.select(*keys, "n_more", F.posexplode(whole).alias("place", "g")).select(*keys, "place", "g.first.*", "g.n", "g.extra_excerpts", "n_more")


def report(found: Column, risk: Column, tokens: Column, pack: Column) -> Column:
    """Lines of text: a head and a card for each finding."""
    glyph = F.element_at(F.create_map(*(F.lit(x) for p in GLYPHS.items() for x in p)), risk)
    status = F.when(F.size(found) > 0, status_line(found)).otherwise("no issues detected")
    head = F.concat(glyph, F.lit("  "), F.upper(risk), F.lit("   "), status, F.lit("   "), tokens.cast("string"), F.lit(" tok   pack: "), pack)

    def card(f: Column) -> Column:
        cut = F.when(F.length(f["excerpt"]) < 140, f["excerpt"]).otherwise(F.concat(F.substring(f["excerpt"], 1, 137), F.lit("…")))
        lines = F.array(
            F.concat(F.rpad(F.upper(f["severity"]), 8, " "), short_category(f["category"])),
            F.concat(F.lit("         "), f["message"]),
            F.when(f["excerpt"] != WHITE_SPACE, F.concat(F.lit("         “"), cut, F.lit("”"))),
            F.concat(F.lit("         → "), f["suggestion"]),
        )
        return F.array_join(lines, "\n")

    return F.concat_ws("\n\n", F.array(head), F.transform(found, card))


def by_pack(scanned: DataFrame, pack: PackLike | str | None, value: Callable[[PackLike], Column]) -> Column:
    """``value`` of ``pack``; without one that of the pack which the row's column pack names, or of the default where there is no such pack."""
    if pack is not None or "pack" not in scanned.columns:
        return value(resolve(pack))
    named = {name: value(p) for name, p in all_packs().items() if name != DEFAULT}
    out = None
    for name, column in named.items():
        out = F.when(F.col("pack") == name, column) if out is None else out.when(F.col("pack") == name, column)
    own = value(resolve(None))
    return own if out is None else out.otherwise(own)


def rewrite_built_in(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """``scanned`` with rewritten and notes by built-in packs only: scans by packs of other distributions go to the default one, and both are null where the pack cannot rewrite."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    designer = F.coalesce(F.col("optional_rules_active"), F.lit(False))
    done = BUILT_IN[DEFAULT].rewrite(text, F.col("findings"), designer)
    nothing = F.lit(None).cast("struct<rewritten:string,notes:array<string>>")
    for name, pack in BUILT_IN.items():
        if name != DEFAULT:
            own = pack.rewrite(text, F.col("findings"), designer)
            done = F.when(F.col("pack") == name, nothing if own is None else own).otherwise(done)
    return scanned.withColumn("__done", done).withColumns({"rewritten": F.col("__done.rewritten"), "notes": F.col("__done.notes")}).drop("__done")


def rewrite(scanned: DataFrame, pack: PackLike | str | None = None, text_col: str = "text", designer_mode: bool = False) -> DataFrame:
    """``scanned`` with rewritten and notes, by ``pack`` or by the one that made each row's scan. A pack that cannot rewrite leaves the text and says so."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    designer = F.lit(designer_mode) | F.coalesce(F.col("optional_rules_active"), F.lit(False))

    def rewritten(p: PackLike) -> Column:
        done = p.rewrite(text, F.col("findings"), designer)
        if done is None:
            done = F.struct(text.alias("rewritten"), F.array(F.lit(f"The {p.label} pack does not support rewriting.")).alias("notes"))
        return done

    done = by_pack(scanned, pack, rewritten)
    return scanned.withColumn("__done", done).withColumns({"rewritten": F.col("__done.rewritten"), "notes": F.col("__done.notes")}).drop("__done")


def with_diff(rewritten: DataFrame, pack: PackLike | str | None = None, text_col: str = "text") -> DataFrame:
    """``rewritten`` with diff, the lines of a unified diff, named by the row's pack as in :func:`rewrite`; the only step of a rewrite that runs in Python."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = by_pack(rewritten, pack, lambda p: F.lit(p.name == "personal-info"))
    rows = rewritten.withColumns({"__before": F.when(own, text).otherwise(strip(text)), "__label": F.when(own, "redacted").otherwise("safer remix")})
    return with_unified_diff(rows, "__before", "rewritten", "__label").drop("__before", "__label")


def delta(rewritten: DataFrame, pack: PackLike | str | None = None, text_col: str = "text") -> DataFrame:
    """``rewritten`` with the scan of the new text, by the same pack, beside that of the old: risk_after, n_before, n_after, rank_change and outcome."""
    # the new text is scanned as a column of its own, as any text is
    first = {c: f"__first_{c}" for c in ("findings", "overall_risk", "token_count", "optional_rules_active", "pack") if c in rewritten.columns}
    held = rewritten.withColumnsRenamed(first)
    named = pack is None and "pack" in first
    again = scan_by(held.withColumn("pack", F.col(first["pack"])), "pack", "rewritten") if named else scan(held, pack, "rewritten")
    again = again.withColumnRenamed("findings", "findings_after").drop(*(c for c in first if c != "findings"), "overall_risk", "token_count", "optional_rules_active", "pack").withColumnsRenamed({v: k for k, v in first.items()})
    changed = F.col("rewritten") != F.coalesce(F.col(text_col), F.lit(""))
    return again.withColumns(
        {
            "risk_after": overall(F.col("findings_after")),
            "n_before": F.size("findings"),
            "n_after": F.size("findings_after"),
            "rank_change": rank(overall(F.col("findings_after"))) - rank(F.col("overall_risk")),
            "outcome": F.when(changed, "changed").otherwise("unchanged"),
        }
    )


def without_findings(scanned: DataFrame) -> DataFrame:
    """The scanned rows without any finding.

    They are told by a generator: a filter would go below the scan and below the dealing of the rows
    to tasks, with all that the scan names of the text written out in it as often.
    """
    once = F.filter(F.array(F.size("findings") == 0), lambda none: none)
    return scanned.select("*", F.explode(once).alias("__none")).select(*scanned.columns)


def clean_rows(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows without any finding in a table of findings (an anti-join)."""
    return rows.join(found.select(key).distinct(), key, "left_anti")


def severity_cube(found: DataFrame, *by: str) -> DataFrame:
    """Findings counted over the rollup of ``by``."""
    return found.rollup(*by).agg(F.count("*").alias("n_findings"), F.grouping_id().alias("grouping"))


def top_rules(found: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` commonest rules of each value of ``by``, counted before they are ranked."""
    counted = found.groupBy(by, "id").agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.col("n").desc(), "id")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


