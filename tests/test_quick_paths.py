"""What is looked up before a pattern is must be in every text that the pattern matches."""

from pyspark.sql import functions as F

from glyphward.functions.text import regex, spans
from glyphward.operators.rules import Rule
from glyphward.packs import prompt_safety as ps

SECRETS = ["ann@example.net", "A.B%c@x.org", "(555) 867-5309", "(555)8675309", "555-867-5309", "+1555 867 5309", "sk_" + "a" * 20, "GHP_" + "K" * 24, "AKIA" + "0A" * 8, "akia" + "0A" * 8, "AIza" + "-_" * 18, "sk_short", "555-86-5309", "user@", "(55) 1"]


def test_signs_are_in_every_secret(spark):
    assert ps.PII_SIGNS  # addresses and numbers are told by a quick search first
    rule = next(r for r in ps.RULES if r.id == "pii_and_secrets")
    texts = [(x + y,) for x in SECRETS for y in ("", " and (555) 867-5309", " x")]
    rows = spark.createDataFrame(texts, "text string").select("text", rule.spans(F.col("text")).alias("a"), spans(F.col("text"), regex(rule.quick, True)).alias("b")).collect()
    assert len(rows) == len(texts) and all(r.a == r.b for r in rows)
    assert sum(bool(r.a) for r in rows) > len(rows) // 2


def test_repeats_are_counted_at_the_first_places(spark):
    w = "one two three four five six seven eight nine ten eleven".split()
    at = spark.range(1).select(ps._first_places(F.array(*map(F.lit, w * 5)), F.array(*map(F.lit, [40, 9, 3, 0, 20])), 6).alias("p")).first().p
    assert [(p.at, p.size) for p in at] == [(2, 6), (8, 6), (19, 6)]


def test_an_opening_is_not_searched_for_behind_the_start(spark):
    rule = Rule("opening", "c", "low", "m", pattern=r"\A(?:\S+[ \n]+){1}\S+")
    rows = spark.createDataFrame([("one two three",), ("one",), ("",), (None,), (" one two",)], "text string").select(rule.spans(F.col("text")).alias("s"))
    assert [[tuple(x) for x in r.s] for r in rows.collect()] == [[(0, 7, "one two")], [], [], [], []]
    assert "split(" not in rows._jdf.queryExecution().optimizedPlan().toString()
