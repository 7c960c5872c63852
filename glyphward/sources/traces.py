"""Agent traces: JSON arrays or objects of messages, scanned together with the raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphward.functions.text import is_blank, strip
from glyphward.operators.registry import DEFAULT
from glyphward.operators.rules import PackLike
from glyphward.operators.scanning import scan

# The keys that messages are taken from.
LIST_KEYS = ("content", "text", "message", "prompt")
OBJECT_KEYS = ("messages", "steps", "trace", "history")
MESSAGE_KEYS = ("content", "text")
SEPARATOR = "\n\n"


def _string(v: Column, key: str) -> Column:
    """The value of a key if it is a JSON string; numbers and other values are not taken."""
    held = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(held) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def _texts(items: Column, keys: tuple[str, ...]) -> Column:
    return F.flatten(F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda v: F.array(*(_string(v, k) for k in keys))))


def trace_text(text: Column) -> Column:
    """The raw text and the messages in it, joined by blank lines; text that is not valid JSON stands alone."""
    opening = F.substring(strip(text), 1, 1)
    parsed = F.when(opening.isin("{", "["), F.try_parse_json(text))
    listed = _texts(F.when(opening == "[", F.try_variant_get(parsed, "$", "array<variant>")), LIST_KEYS)
    named = F.concat(*(_texts(F.try_variant_get(parsed, f"$.{k}", "array<variant>"), MESSAGE_KEYS) for k in OBJECT_KEYS))
    parts = F.concat(F.array(text), F.when(opening == "[", listed).when(opening == "{", named).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda x: ~is_blank(x)), SEPARATOR)


def trace_messages(text: Column) -> Column:
    """array of (message, role, text): the parts that :func:`trace_text` joins, in its order; the raw trace is message -1, and a message with several texts has a part for each."""
    opening = F.substring(strip(text), 1, 1)
    parsed = F.when(opening.isin("{", "["), F.try_parse_json(text))
    nothing = F.array().cast("array<variant>")

    def of(items: Column, keys: tuple[str, ...]) -> Column:
        parts = lambda v, i: F.array(*(F.struct(i.alias("message"), _string(v, "role").alias("role"), _string(v, k).alias("text")) for k in keys))
        return F.flatten(F.transform(F.coalesce(items, nothing), parts))

    listed = of(F.when(opening == "[", F.try_variant_get(parsed, "$", "array<variant>")), LIST_KEYS)
    named = F.concat(*(of(F.try_variant_get(parsed, f"$.{k}", "array<variant>"), MESSAGE_KEYS) for k in OBJECT_KEYS))
    raw = F.array(F.struct(F.lit(-1).alias("message"), F.lit(None).cast("string").alias("role"), text.alias("text")))
    parts = F.concat(raw, F.when(opening == "[", listed).when(opening == "{", named).otherwise(F.slice(raw, 1, 0)))
    return F.filter(parts, lambda x: ~is_blank(x["text"]))


def looks_like_trace(text: Column) -> Column:
    """Opens with a brace or bracket, or names messages in its first 200 characters."""
    return F.substring(strip(text), 1, 1).isin("{", "[") | F.lower(F.substring(text, 1, 200)).contains('"messages"')


def scan_trace(df: DataFrame, text_col: str = "text", designer_mode: bool = False, pack: PackLike | str = DEFAULT) -> DataFrame:
    """``df`` scanned by ``pack`` over raw trace and messages; spans count in the joined text, kept as trace_text."""
    joined = df.withColumn("trace_text", trace_text(F.coalesce(F.col(text_col), F.lit(""))))
    return scan(joined, pack, "trace_text", designer_mode)
