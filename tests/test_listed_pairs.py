"""Listed strings of two words are found where their pair of words stands."""

import time

from pyspark.sql import functions as F

from glyphward.operators.dictionary import find_listed, strings_of
from glyphward.operators.scanning import explode_findings, scan
from glyphward.packs.personal_info import PersonalInfoPack

PAIRS = ["la the", "the la", "la la", "a_b c", "_a b", "Customer#000000017", "straße la", "STRASSE la", "ſee kelvin", "Kelvin İx", "a  b", "a\nb", "x-y", "é à", "ⓐ ⅷ", "é a", "ok 😀 ok", "Σας ΣΑΣ", "one two three", "2 å", "2 ω"]
TEXTS = ["LA THE la the la la la", "the la\tthe  la THE LA.", "a_b c a_B C xa_b c", "_a b x_a b", "customer#000000017 CUSTOMER#000000017x customer#0000000170", "straße la STRASSE LA straẞe la", "SEE KELVIN see Kelvin ſee kelvinİ", "kelvin ix KELVIN İX kelvin İx KELVIN ıx", "a  b A  B a b a\nb A\nB", "x-y X-Y-z x--y", "É À é à", "Ⓐ Ⅷ ⓐ ⅷ", "é a É A é a", "ok 😀 ok 😀😀 OK 😀 OK", "σασ σας ΣΑΣ σασ", "one two three ONE two", "STRAẞE LA", "2 \u212b 2 \u2126", "", None, "la"]


def test_pairs_as_the_rule_finds_them(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    config = {"strings": {"pairs": PAIRS}}
    shown = lambda df: sorted(map(tuple, df.select("doc_id", "start", "end", "excerpt").collect()))
    # the pack strips excerpts, which no match here needs
    want = shown(explode_findings(scan(docs, PersonalInfoPack(config=config)), "doc_id").select("doc_id", "start", "end", "excerpt").distinct())
    got = find_listed(docs, strings_of(spark, config))
    assert shown(got.select("doc_id", "start", "end", "excerpt").distinct()) == want and len(want) > 30


def test_a_pair_listed_twice_and_texts_of_one_key(spark):
    docs = spark.createDataFrame([(1, "a la"), (1, "la A la"), (None, "a la")], "doc_id long, text string")
    strings = spark.createDataFrame([("c", "a la"), ("c", "a la"), ("d", "A LA")], "category string, value string")
    rows = sorted((r.doc_id, r.category, r.start, r.end, r.excerpt) for r in find_listed(docs, strings).collect())
    assert rows == [(1, "c", 0, 4, "a la"), (1, "c", 3, 7, "A la"), (1, "d", 0, 4, "a la"), (1, "d", 3, 7, "A la")]


def test_a_text_is_not_searched_once_for_each_string(spark):
    n = 12_000
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")
    docs = spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    strings = spark.range(n).select(F.lit("c").alias("category"), F.concat(F.lit("W"), F.col("id").cast("string"), F.lit(" w"), (F.col("id") + 1).cast("string")).alias("value"))
    find_listed(docs, strings.limit(3)).count()
    began = time.monotonic()
    assert find_listed(docs, strings).agg(F.count("*"), F.count_distinct("value")).first() == (n, n)
    assert time.monotonic() - began < 30
