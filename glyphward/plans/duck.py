"""Pieces of DuckDB SQL that say what the operators mean, for checking them."""

from __future__ import annotations

from glyphward.functions.severity import RANKS, SEVERITIES
from glyphward.operators import rewriting as rw
from glyphward.operators.rules import Rule
from glyphward.packs import markdown as md
from glyphward.packs import prompt_safety as ps
from glyphward.plans.seeds import MARKDOWN, PROMPTS, quoted, seed_sql

SEEDED = f"seeded AS (SELECT doc_id, lang, source, text || chr(10) || {seed_sql(PROMPTS)} AS text FROM documents)"
SEEDED_MD = f"seeded_md AS (SELECT doc_id, {seed_sql(MARKDOWN)} || chr(10) || text AS text FROM documents)"


def total(xs: str) -> str:
    """Characters of a list of strings."""
    return f"CAST(coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0) AS BIGINT)"


def spans(source: str, pattern: str, ignore_case: bool = True, key: str = "doc_id") -> str:
    """SELECT of (key, k, span_start, span_end, excerpt): the matches of a pattern without lookaround."""
    p = quoted(("(?i)" if ignore_case else "") + pattern)
    return f"""(SELECT {key}, k, span_start, span_start + length(m[k]) AS span_end, m[k] AS excerpt FROM (
      SELECT {key}, k, m, {total("g[1:k]")} + {total("m[1:k - 1]")} AS span_start FROM (
        SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS k FROM (
          SELECT {key}, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM {source} WHERE regexp_matches(text, {p})))))"""


def stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def any_of(text: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(p)})" for p in parts) + ")"


GATE = any_of("lower(text)", ps.DESIGN_SIGNALS)
DETECTS = any_of("lower(text)", ps.PROMPT_SIGNALS)
MARKDOWN_DETECTS = "(starts_with(text, '#') OR starts_with(text, '```') OR " + " + ".join(f"CAST(contains(text, {quoted(m)}) AS INT)" for m in md.MARKERS) + " >= 2)"
WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
TOKENS = rf"CAST(CASE WHEN NOT regexp_matches(text, '\S') THEN 0 ELSE greatest(1, len({WORDS}) * 133 // 100, length(text) // 4) END AS BIGINT)"
KIND = r"""CASE WHEN contains(x, '@') THEN 'email' WHEN starts_with(x, 'AKIA') THEN 'aws-key' WHEN starts_with(x, 'ghp_') OR starts_with(x, 'gho_') THEN 'github-token'
  WHEN starts_with(x, 'glpat') THEN 'gitlab-token' WHEN starts_with(x, 'hf_') THEN 'hf-token' WHEN starts_with(x, 'AIza') THEN 'google-api-key'
  WHEN starts_with(x, 'sk_') OR starts_with(x, 'pk_') THEN 'stripe-key' WHEN length(regexp_replace(x, '\D', '', 'g')) >= 7 THEN 'phone' ELSE 'pii' END"""


def repetition(source: str) -> str:
    """SELECT of (doc_id, k, span_start, span_end, excerpt)."""
    sizes = ", ".join(f"({s})" for s in ps.REPEAT_SIZES)
    return rf"""(WITH w AS (
    SELECT doc_id, words, len(words) AS n, gaps FROM (SELECT doc_id, {WORDS} AS words, string_split_regex(text, '\S+') AS gaps FROM {source}) WHERE len(words) >= {ps.REPEAT_LEAST_WORDS}
  ), grams AS (SELECT doc_id, i, array_to_string(words[i + 1:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(0, n - 3)) AS i FROM w)
  ), often AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) >= 3
  ), near AS (
    SELECT w.doc_id, s.size, x.i - 1 AS i, array_to_string(words[x.i:x.i - 1 + s.size], ' ') AS chunk, array_to_string(words[x.i + s.size:n], ' ') AS rest
    FROM grams x JOIN often USING (doc_id, g) JOIN w USING (doc_id), (VALUES {sizes}) s(size) WHERE x.i >= 1 AND x.i - 1 <= n - 3 * s.size
  ), fired AS (SELECT doc_id, size, i, chunk FROM near WHERE (length(rest) - length(replace(rest, chunk, ''))) / length(chunk) >= 2
  ), firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size, i) AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY size, i) AS c FROM fired) WHERE c = 1)
  SELECT doc_id, k, {total("gaps[1:i + 1]")} + {total("words[1:i]")} AS span_start, {total("gaps[1:i + size]")} + {total("words[1:i + size]")} AS span_end, chunk || ' (repeats)' AS excerpt
  FROM firsts JOIN w USING (doc_id) WHERE k <= {ps.REPEAT_MOST})"""


def rule_spans(rule: Rule, source: str) -> str:
    if rule.id == "token_bomb":
        return repetition(source)
    if rule.id == "unknown_style_attribution":
        known = ", ".join(quoted(a.lower()) for a in ps.ARTISTS)
        name = f"lower(regexp_extract(excerpt, {quoted('(?i)' + ps.ATTRIBUTION)}, 2))"
        return f"(SELECT * FROM {spans(source, ps.ATTRIBUTION)} WHERE {name} NOT IN ({known}))"
    return spans(source, rule.pattern, rule.ignore_case)


def prompt_findings(source: str = "seeded", forced: bool = False) -> str:
    """SELECT of (doc_id, position, id, category, severity, span_start, span_end, excerpt) by the default pack."""
    parts = []
    for i, r in enumerate(ps.RULES):
        of = source if not r.optional or forced else f"(SELECT * FROM {source} WHERE {GATE})"
        parts.append(f"SELECT doc_id, {RANKS[r.severity]} AS severity_rank, {quoted(r.category)} AS category, {i} AS ordinal, k, {quoted(r.id)} AS id, {quoted(r.severity)} AS severity, span_start, span_end, {stripped('excerpt')} AS excerpt FROM {rule_spans(r, of)}")
    every = "\nUNION ALL ".join(parts)
    return f"(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY severity_rank DESC, category, ordinal, k) - 1 AS position, severity_rank, id, category, severity, span_start, span_end, excerpt FROM ({every}))"


def status(counts: dict[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN {counts[s]} > 0 THEN {counts[s]} || ' {s}' END" for s in reversed(SEVERITIES))
    return f"coalesce(nullif(concat_ws(', ', {parts}), ''), 'No issues detected.')"


def markdown_spans(rule: str, source: str = "seeded_md") -> str:
    """SELECT of (doc_id, k, span_start, span_end, excerpt), where the patterns need no lookaround."""
    if rule == "bare_url":
        p = r"(^|[^(\[<\"])https?://[^\s<>)\]]+"
        lead = f"length(regexp_extract(excerpt, {quoted(p)}, 1))"
        return f"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY span_start) AS k, span_start, span_end, excerpt FROM (
          SELECT s.doc_id, span_start + {lead} AS span_start, span_end, substr(excerpt, {lead} + 1) AS excerpt, substr(text, 1, span_start + {lead}) AS before
          FROM {spans(source, p, False)} s JOIN {source} d ON s.doc_id = d.doc_id)
          WHERE ((length(before) - length(replace(before, '`', ''))) - (length(before) - length(replace(before, '``', ''))) // 2) % 2 = 0
          QUALIFY k <= {md.MOST[rule]})"""
    if rule in ("trailing_whitespace", "heading_jump"):
        lines = f"""(SELECT doc_id, n, lines[n] AS line, {total("lines[1:n - 1]")} + n - 1 AS begins FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {source})))"""
        if rule == "trailing_whitespace":
            bare = r"regexp_replace(line, '\s+$', '')"
            return f"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, begins + length({bare}) AS span_start, begins + length(line) AS span_end, {quoted(md.TRAILING_EXCERPT)} AS excerpt
              FROM {lines} WHERE line <> {bare} QUALIFY k <= {md.MOST[rule]})"""
        return rf"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, begins AS span_start, begins + length(line) AS span_end, line AS excerpt FROM (
          SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM (SELECT *, length(regexp_extract(line, '^(#+)', 1)) AS level FROM {lines} WHERE regexp_matches(line, '^#{{1,6}}\s+.+$')))
          WHERE level > before + 1 QUALIFY k <= {md.MOST[rule]})"""
    r = next(r for r in md.RULES if r.id == rule)
    found = spans(source, md.TODO if rule == "todo_comment" else r.pattern, rule in ("todo_comment", "lazy_link_text"))
    if rule == "todo_comment":
        return f"(SELECT doc_id, k, span_start, span_end, substr(excerpt, 1, 80) AS excerpt FROM {found} WHERE k <= {md.MOST[rule]})"
    return found


def truncated(x: str, limit: int = 60) -> str:
    return f"CASE WHEN length({stripped(x)}) > {limit} THEN substr({stripped(x)}, 1, {limit - 1}) || '…' ELSE {stripped(x)} END"


def report(rules: list[Rule]) -> str:
    """CTE ``cards`` (doc_id, cards) of ``found``."""
    lines = ", ".join(f"({quoted(r.id)}, {quoted(r.severity.upper().ljust(8) + r.category.replace('_', ' ').title())}, {quoted(r.message)}, {quoted(r.suggestion)})" for r in rules)
    indent = quoted(" " * 9)
    cut = "CASE WHEN length(excerpt) < 140 THEN excerpt ELSE substr(excerpt, 1, 137) || '…' END"
    return f"""cards AS (SELECT doc_id, string_agg(chr(10) || chr(10) || head || chr(10) || {indent} || message || chr(10) || {indent} || '“' || {cut} || '”' || chr(10) || {indent} || '→ ' || suggestion, '' ORDER BY position) AS cards
      FROM found JOIN (VALUES {lines}) r(rule, head, message, suggestion) ON id = rule GROUP BY doc_id)"""


def notes(rules: list[Rule]) -> str:
    """SELECT of (doc_id, notes), after the steps of :func:`rewrite_steps`."""
    hints = {r.id: r.hint for r in rules if r.hint}

    def removed(step: str, pattern: str, hint: str | None, gate: str = "true") -> str:
        m = f"regexp_extract_all({step}.t, {quoted(pattern)})"
        shown = f"list_transform({m}, lambda x: 'removed: “' || {truncated('x')} || '”')"
        tail = f"CASE WHEN len({m}) > 0 THEN [{quoted('  ↳ ' + hint)}] ELSE [] END" if hint else "[]"
        return f"CASE WHEN {gate} THEN list_concat({shown}, {tail}) ELSE [] END"

    secrets = f"list_transform(regexp_extract_all(s0.text, {quoted('(?i)' + ps.PII)}), lambda x: 'redacted: “' || {truncated('x')} || '” → [REDACTED:' || {KIND} || ']')"
    parts = [secrets] + [removed(f"s{i}", p, hints.get(rule)) for i, (rule, p) in enumerate(rw.REMOVED)]
    at = len(rw.REMOVED)
    parts.append(removed(f"s{at}", rw.ARTIST, hints.get("copyright_artist"), "s0.designer"))
    filler = " + ".join(f"len(regexp_extract_all(s{at + 1 + i}.t, {quoted('(?i)' + p)}))" for i, p in enumerate(rw.FLUFF))
    parts.append(f"CASE WHEN {filler} > 0 THEN ['trimmed ' || ({filler}) || CASE WHEN {filler} = 1 THEN ' filler word' ELSE ' filler words' END] ELSE [] END")
    every = parts[0]
    for p in parts[1:]:
        every = f"list_concat({every}, {p})"
    joins = " ".join(f"JOIN s{i} USING (doc_id)" for i in range(1, at + 1 + len(rw.FLUFF)))
    return f"""SELECT doc_id, array_to_string(CASE WHEN rewritten = '' THEN list_append(n, {quoted(rw.NOTHING_LEFT)}) WHEN len(n) = 0 THEN [{quoted(rw.WELL_BEHAVED)}] ELSE n END, chr(10)) AS notes
      FROM (SELECT doc_id, rewritten.rewritten, {every} AS n FROM s0 {joins} JOIN rewritten USING (doc_id))"""


def routed_findings() -> str:
    """CTEs ``routed`` (doc_id, text, pack) and ``ranks`` (doc_id, pack, risk_rank) of seeded Markdown."""
    parts = [f"SELECT doc_id, {RANKS[r.severity]} AS severity_rank FROM {markdown_spans(r.id)}" for r in md.RULES]
    return f"""routed AS (SELECT doc_id, text, CASE WHEN {DETECTS} THEN 'prompt-safety' WHEN {MARKDOWN_DETECTS} THEN 'markdown' ELSE 'prompt-safety' END AS pack FROM seeded_md),
    by_prompt AS (SELECT doc_id, max(severity_rank) AS r FROM {prompt_findings('seeded_md')} GROUP BY doc_id), by_markdown AS (SELECT doc_id, max(severity_rank) AS r FROM ({" UNION ALL ".join(parts)}) GROUP BY doc_id),
    ranks AS (SELECT doc_id, pack, coalesce(CASE pack WHEN 'markdown' THEN m.r ELSE p.r END, 1) AS risk_rank FROM routed LEFT JOIN by_prompt p USING (doc_id) LEFT JOIN by_markdown m USING (doc_id))"""


def replaced(text: str, pattern: str, put: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(put.replace('$', chr(92)))}, 'g')"


def redacted(text: str) -> str:
    p = quoted("(?i)" + ps.PII)
    m, g = f"regexp_extract_all({text}, {p})", f"string_split_regex({text}, {p})"
    return f"array_to_string(list_transform({g}, lambda part, i: part || CASE WHEN i <= len({m}) THEN '[REDACTED:' || list_transform([({m})[i]], lambda x: {KIND})[1] || ']' ELSE '' END), '')"


def rewrite_steps(source: str = "seeded") -> str:
    """CTEs up to ``rewritten`` (doc_id, text, rewritten): one for each stage."""
    at = 0
    out = [f"s0 AS (SELECT doc_id, text, {GATE} AS designer, {stripped(redacted('text'))} AS t FROM {source})"]

    def step(expression: str) -> None:
        nonlocal at
        out.append(f"s{at + 1} AS MATERIALIZED (SELECT doc_id, text, designer, {expression} AS t FROM s{at})")
        at += 1

    for _, p in rw.REMOVED:
        step(replaced("t", p, ""))
    step(f"CASE WHEN designer THEN {replaced('t', rw.ARTIST, '')} ELSE t END")
    for p in rw.FLUFF:
        step(replaced("t", "(?i)" + p, " "))
    for _ in range(2):
        for p in rw.ORPHANS:
            step(replaced("t", "(?i)" + p + r"\s*([.!?,;])", "$1"))
            step(replaced("t", "(?i)" + p + r"\s+([A-Z])", "$1"))
        step(replaced(r"regexp_replace(t, '^\s+', '')", r"(?i)(\A|[.!?]\s+)(and|but|or|then|also)\s+", "$1"))
    for p, put in rw.SEAMS:
        step(replaced("t", p, put))
    starts = quoted(r"[.!?]\s+[a-z]\w*")
    first = r"length(regexp_extract(x, '^[.!?]\s+', 0)) + 1"
    raised = f"CASE WHEN regexp_matches(x, '[A-Z]') THEN x ELSE substr(x, 1, {first} - 1) || upper(substr(x, {first}, 1)) || substr(x, {first} + 1) END"
    step(f"array_to_string(list_transform(string_split_regex(t, {starts}), lambda part, i: part || coalesce(list_transform([regexp_extract_all(t, {starts})[i]], lambda x: {raised})[1], '')), '')")
    step(r"regexp_replace(t, '^\s+', '')")
    word = r"regexp_extract(t, '^\S+', 0)"
    step(rf"CASE WHEN regexp_matches(t, '^\p{{Ll}}') AND NOT regexp_matches({word}, '[@/:=\[\]<>{{}}]') AND NOT regexp_matches(substr({word}, 2), '\p{{Lu}}') THEN upper(substr(t, 1, 1)) || substr(t, 2) ELSE t END")
    out.append(f"rewritten AS (SELECT doc_id, text, {stripped('t')} AS rewritten FROM s{at})")
    return ",\n".join(out)
