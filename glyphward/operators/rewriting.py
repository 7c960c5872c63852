"""Deterministic rewriting: redaction of spans, removal of phrases, and the tidying after it."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphward.functions.text import contains_any, folded, let, lstrip, regex, strip, truncated

# What is removed, in order, with the rule whose hint goes with it.
REMOVED = (
    ("direct_injection", r"(?i:\b(ignore|disregard|forget|override)\s+(?:(?:all|previous|prior|above|earlier)\s+)+(instructions?|rules?|prompts?|directives?))"),
    ("jailbreak_dan", r"(?i:\b(DAN|jailbreak|developer mode|god mode|unrestricted mode|do anything now|you are now free|no (ethical|moral) (limits|restrictions))\b[^.]*[.]?)"),
    ("role_escalation", r"(?i:\byou are (now )?(the (ultimate|only|best|world.?s (best|top))|my personal|the sole)\s+[^.]{0,60}[.]?)"),
    ("overconfidence", r"(?i:\b(make it (?:\w+\s+){0,2}(?:perfect|best|most amazing|award.?(?:winning|level))|do not hold back|go wild|surprise me with your genius|be the most creative)\b)"),
)
# The other patterns of the rewriter, with what is put in their place.
ARTIST = r"\b(?i:in the (?:exact )?style of|like the work of|à la|in the manner of)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"
FLUFF = (
    r"\b(?:super|very|extremely|incredibly|absolutely|completely)\s+",
    r"\b(?:mind.?blowing|game.?changing|next.?level|revolutionary|stunning|beautifully crafted)\b\s*,?\s*",
    r",?\s*\b(?:please|kindly|if you would be so kind)\b",
)
# Words in small letters of which one stands in every text that a pattern changes; no removal makes such a word anew, as none begins inside one.
REMOVED_NEEDS = (
    ("ignore", "disregard", "forget", "override"),
    ("dan", "jailbreak", "developer mode", "god mode", "unrestricted mode", "do anything now", "you are now free", "no ethical ", "no moral "),
    ("you are ",),
    ("make it ", "do not hold back", "go wild", "surprise me with your genius", "be the most creative"),
)
ARTIST_NEEDS = ("style of", "like the work of", "à la", "in the manner of")
FLUFF_NEEDS = (("super", "very", "extremely", "incredibly", "absolutely", "completely"), ("blowing", "changing", "level", "revolutionary", "stunning", "crafted"), ("please", "kind"))
ORPHANS_NEED = (("you",), ("act",), ("act",), ("pretend",), ("roleplay",))
ORPHANS = (r"\byou\s+are(?:\s+now)?", r"\band\s+act\s+as", r"\bact\s+as", r"\bpretend\s+to\s+be", r"\broleplay\s+as")
# pattern, replacement, after the orphans have gone twice
SEAMS_NEED = {4: ("and",), 6: ("that",), 8: ("  ", "\t\t", " \t", "\t "), 9: ("\n\n\n",)}  # what a text that the pattern changes holds, by its place
SEAMS = (
    (r"\s+([.,;:!?])", "$1"),
    (r"([.!?])(?:\s*[.!?])+", "$1"),
    (r",\s*([.!?])", "$1"),
    (r"([.!?])\s*,", "$1"),
    (r"\b(is|are|was|were)\s+and\s+", "$1 "),
    (r"\b(is|are|was|were)\s*([.,;])", "$2"),
    (r"\bthat\s*([.!?])", "$1"),
    (r"(?m)^[.,;:!?]+\s*", ""),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
)
# The same patterns where Java needs other words for them: a repeated group that is never given back is a loop and
# takes no stack, and a run of blanks is looked at from its start only.
QUICK = {
    REMOVED[0][1]: REMOVED[0][1].replace(r"\s+)+", r"\s++)++"),
    SEAMS[0][0]: r"(?<!\s)\s++([.,;:!?])",
    SEAMS[1][0]: r"([.!?])(?:\s*+[.!?])++",
    FLUFF[2]: r"(?:,\s*+|(?<!\s)\s*+)\b(?:please|kindly|if you would be so kind)\b",
}
NOTHING_LEFT = "nothing is left: the whole text was made of risky phrases."
WELL_BEHAVED = "the text was fine already; spacing only."


def secret_kind(excerpt: Column) -> Column:
    """What a secret looks like; the letter case of its marks counts."""
    x = strip(excerpt)
    starts = lambda *marks: F.greatest(*(x.startswith(m) for m in marks)) if len(marks) > 1 else x.startswith(marks[0])
    return (
        F.when(x.contains("@"), "email")
        .when(starts("AKIA"), "aws-key")
        .when(starts("ghp_", "gho_"), "github-token")
        .when(starts("glpat"), "gitlab-token")
        .when(starts("hf_"), "hf-token")
        .when(starts("AIza"), "google-api-key")
        .when(starts("sk_", "pk_"), "stripe-key")
        .when(F.length(F.regexp_replace(x, regex(r"\D"), "")) >= 7, "phone")
        .otherwise("pii")
    )


CHUNK = 4096  # characters; to find a place in a text, all before it is read
MANY = 16  # spans from which a text is cut into chunks first


def chunks_of(text: Column, spans: Column) -> Column:
    """``text`` cut into chunks, if there are many ``spans`` to take from it; else an empty array."""
    last = F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / CHUNK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(spans) > MANY, cut).otherwise(F.array().cast("array<string>"))


def part_of(text: Column, chunks: Column, start: Column, size: Column) -> Column:
    """``size`` characters of ``text`` from ``start`` (from 0), out of its chunks where these will do."""
    i = F.floor(start / CHUNK).cast("int")
    near = F.substring(F.concat(F.get(chunks, i), F.coalesce(F.get(chunks, i + 1), F.lit(""))), start % CHUNK + 1, size)
    return F.when((i < F.size(chunks)) & (size <= CHUNK), near).otherwise(F.substring(text, start + 1, size))


def replace_apart(text: Column, spans: Column, chunks: Column) -> Column:
    """As :func:`replace_spans` for spans with the last first; where there are many that do not overlap, in time in proportion to the text."""

    def joined(xs: Column) -> Column:
        ends = lambda i: F.when(i > 0, F.get(xs, i - 1)["end"]).otherwise(F.lit(0))
        piece = lambda s, i: let(ends(i), lambda at: F.concat(part_of(text, chunks, at, s["start"] - at), s["put"]))
        tail = F.substring(text, F.element_at(xs, -1)["end"] + 1, F.length(text))
        apart = ~F.exists(F.transform(xs, lambda s, i: s["start"] < ends(i)), lambda x: x)
        return F.when((F.size(chunks) > 0) & apart, F.concat(F.array_join(F.transform(xs, piece), ""), tail))

    return F.coalesce(F.when(F.size(chunks) > 0, let(F.reverse(spans), joined)), replace_spans(text, spans))


def replace_spans(text: Column, spans: Column) -> Column:
    """``text`` with each (start, end, put) replaced, in the given order and each in what the ones before have left."""
    return F.aggregate(spans, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), s["put"], F.substring(t, s["end"] + 1, F.length(t))))


def from_the_end(spans: Column, put) -> Column:
    """Spans as (start, end, put), last start first; equal starts keep their order."""
    keyed = F.transform(spans, lambda s, i: F.struct((-s["start"]).alias("k"), i.alias("i"), s["start"].alias("start"), s["end"].alias("end"), put(s).alias("put")))
    return F.array_sort(keyed)


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every (start, end, excerpt) replaced by its kind in brackets."""
    ordered = from_the_end(spans, lambda s: F.concat(F.lit("[REDACTED:"), secret_kind(s["excerpt"]), F.lit("]")))
    return let(ordered, lambda xs: let(chunks_of(text, xs), lambda chunks: replace_apart(text, xs, chunks)))


def tidy(text: Column, low: Column | None = None, capital: Callable[[Column], Column] = F.upper) -> Column:
    """Mend what removals leave: dangling openings, connectives and punctuation, doubled spaces, small letters at sentence starts.

    ``low`` is :func:`folded` of the text, if it is at hand. What a pattern needs is looked up before the pattern is.
    ``capital`` makes the first letter of the text large.
    """
    return let(text, lambda t: let(folded(t) if low is None else low, lambda known: _tidied(t, known, capital)))


def _tidied(text: Column, low: Column, capital: Callable[[Column], Column]) -> Column:
    for _ in range(2):
        for p, needs in zip(ORPHANS, ORPHANS_NEED, strict=True):
            text = let(text, partial(_without_orphan, low, p, needs))
        text = F.regexp_replace(lstrip(text), regex(r"(\A|[.!?]\s+)(and|but|or|then|also)\s+", True), "$1")
    for i, (p, r) in enumerate(SEAMS):
        text = let(text, partial(_mended, regex(QUICK.get(p, p)), r, SEAMS_NEED.get(i)))
    return capitalised(text, capital)


def _without_orphan(low: Column, pattern: str, needs: tuple[str, ...], t: Column) -> Column:
    """``t`` without an opening that nothing or a word follows."""
    out = t
    for rest in (r"\s*([.!?,;])", r"\s+([A-Z])"):
        out = F.regexp_replace(out, regex(pattern + rest, True), "$1")
    return F.when(contains_any(low, needs) & t.rlike(regex(pattern, True)), out).otherwise(t)


def _mended(pattern: str, put: str, needs: tuple[str, ...] | None, t: Column) -> Column:
    out = F.regexp_replace(t, pattern, put)
    return F.when(contains_any(t, needs), out).otherwise(t) if needs else out


def capitalised(text: Column, capital: Callable[[Column], Column] = F.upper) -> Column:
    """Sentence starts in capitals, unless the word has capitals inside; the first word not if it looks like an identifier."""
    first = regex(r"([.!?]\s+)([a-z])(?!\w*\p{IsUppercase})")

    def starts(t: Column) -> Column:
        parts = F.zip_with(F.split(t, first, -1), F.transform(F.regexp_extract_all(t, F.lit(first), F.lit(0)), F.upper), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return lstrip(F.when(t.rlike(first), F.array_join(parts, "")).otherwise(t))

    def opening(t: Column) -> Column:
        word = F.regexp_extract(t, regex(r"\A\S+"), 0)
        identifier = word.rlike(r"[@/:=\[\]<>{}]") | F.substring(word, 2, 1 << 30).rlike(regex(r"\p{IsUppercase}"))
        return F.when(t.rlike(regex(r"\A\p{IsLowercase}")) & ~identifier, F.concat(capital(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))).otherwise(t)

    return let(let(text, starts), opening)


def with_unified_diff(df: DataFrame, before: str, after: str, label: str, out: str = "diff") -> DataFrame:
    """``df`` with array column ``out``: the lines of a unified diff of two of its columns, two lines around each change; column ``label`` names the new text."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])

    def lines(a: str | None, b: str | None, name: str) -> list[str]:
        return list(difflib.unified_diff((a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True), fromfile="original", tofile=name, n=2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(batch.column(names.index(c)).to_pylist() for c in (before, after, label)), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([lines(*p) for p in pairs], pa.list_(pa.string()))], names=[*names, out])

    return df.mapInArrow(run, schema)


NO_NOTES = "array<string>"


def _without(state: Column, pattern: str, hint: str | None, needs: tuple[str, ...], active: Column | None = None) -> Column:
    """struct(text, notes, low) with the matches of ``pattern`` removed and noted; low is :func:`folded` of the text."""

    def step(s: Column) -> Column:
        found = F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0))

        def removed(m: Column) -> Column:
            shown = F.transform(m, lambda x: F.concat(F.lit("removed: “"), truncated(x), F.lit("”")))
            notes = F.concat(s["notes"], shown, F.array(F.lit(f"  ↳ {hint}"))) if hint else F.concat(s["notes"], shown)
            return let(F.regexp_replace(s["text"], pattern, ""), lambda t: F.struct(t.alias("text"), notes.alias("notes"), folded(t).alias("low")))

        hit = contains_any(s["low"], needs) & s["text"].rlike(pattern)
        hit = hit if active is None else active & hit
        return F.when(hit, let(found, removed)).otherwise(s)

    return let(state, step)


def _without_filler(state: Column) -> Column:
    def step(low: Column, pattern: str, needs: tuple[str, ...], s: Column) -> Column:
        n = F.size(F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0)))
        out = F.struct(F.regexp_replace(s["text"], pattern, " ").alias("text"), s["notes"].alias("notes"), s["low"].alias("low"), (s["filler"] + n).alias("filler"))
        return F.when(contains_any(low, needs), out).otherwise(s)

    def all_passes(s: Column) -> Column:
        out = F.struct(s["text"].alias("text"), s["notes"].alias("notes"), s["low"].alias("low"), F.lit(0).alias("filler"))
        for p, needs in zip(FLUFF, FLUFF_NEEDS, strict=True):
            out = let(out, partial(step, s["low"], regex(QUICK.get(p, p), True), needs))
        return out

    state = let(state, all_passes)

    def noted(s: Column) -> Column:
        line = F.concat(F.lit("trimmed "), s["filler"].cast("string"), F.when(s["filler"] == 1, " filler word").otherwise(" filler words"))
        return F.struct(s["text"].alias("text"), F.when(s["filler"] > 0, F.array_append(s["notes"], line)).otherwise(s["notes"]).alias("notes"), s["low"].alias("low"))

    return let(state, noted)


def safe_rewrite(text: Column, findings: Column, designer: Column, hints: dict[str, str], capital: Callable[[Column], Column] = F.upper) -> Column:
    """struct(rewritten, notes): secrets redacted, risky phrases and filler removed, seams tidied.

    Spans are applied to the text as it was scanned, which is stripped afterwards.
    """

    def redacted(found: Column, chunks: Column) -> Column:
        held = lambda s, value: let(part_of(text, chunks, s["start"], s["end"] - s["start"]), value)
        put = lambda s: held(s, lambda x: F.concat(F.lit("[REDACTED:"), secret_kind(x), F.lit("]")))
        note = lambda s: held(s, lambda x: F.concat(F.lit("redacted: “"), truncated(x), F.lit("” → "), s["put"]))
        done = lambda xs: F.struct(strip(replace_apart(text, xs, chunks)).alias("text"), F.transform(F.reverse(xs), note).cast(NO_NOTES).alias("notes"))
        return let(from_the_end(found, put), done)

    secrets = let(F.length(text), lambda n: F.filter(findings, lambda f: (f["id"] == "pii_and_secrets") & (f["end"] <= n)))
    state = let(secrets, lambda found: let(chunks_of(text, found), lambda chunks: redacted(found, chunks)))
    state = let(state, lambda s: F.struct(s["text"].alias("text"), s["notes"].alias("notes"), folded(s["text"]).alias("low")))
    for (rule, p), needs in zip(REMOVED, REMOVED_NEEDS, strict=True):
        state = _without(state, regex(QUICK.get(p, p)), hints.get(rule), needs)
    state = _without_filler(_without(state, regex(ARTIST), hints.get("copyright_artist"), ARTIST_NEEDS, designer))
    state = let(state, lambda s: F.struct(strip(tidy(s["text"], s["low"], capital)).alias("rewritten"), s["notes"].alias("notes")))

    def closing(s: Column) -> Column:
        notes = F.when(s["rewritten"] == "", F.array_append(s["notes"], F.lit(NOTHING_LEFT))).when(F.size(s["notes"]) == 0, F.array(F.lit(WELL_BEHAVED))).otherwise(s["notes"])
        return F.struct(s["rewritten"].alias("rewritten"), notes.alias("notes"))

    return let(state, closing)
