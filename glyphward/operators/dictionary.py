"""Long lists of strings: an inverted index of the list is joined to the words of the texts, and places are told in what remains.

A rule for each string would be a column for each; here the list is a table and may be of any
length. Every string has an anchor that stands in each text with a match: two words that are whole
and beside each other wherever the string is found, the longest ones, else the one such word, else its
first characters. Texts give each anchor that they hold once; what meets is a candidate, and only
candidates are searched. One word of two would do too, but one that is frequent in strings and in
texts meets with the product of both.

A string that is just two words and what stands between them is found where its anchor is: the two
words of the text are the match, so the text is not searched again, however many strings it holds.
Pairs that no string has are mostly dropped before they are shuffled, by a table of bits whose size
is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphward.functions.text import let, regex, running, spans

GRAM = 3  # characters of an anchor that is no whole word, at most
PAIR = -1  # the size of an anchor of two words
WORD = regex(r"\w+")
INNER_WORD = regex(r"(?<=\W)\w+(?=\W)")
ENDS_IN_LETTERS = regex(r"\A[\p{L}\p{N}](?s:.*[\p{L}\p{N}])?\z")
TWO_WORDS = regex(r"\A(\w+)(\W+)(\w+)\z")
SLOTS = 1 << 18  # rows of 64 bits that say which anchors of two words there may be


def folded(text: Column) -> Column:
    """The same for all texts that differ by the case of letters only, as patterns see it."""
    # Spark takes the capital of a small letter for that of the letter itself, which of these it is not
    others = "ſ\u212aıİ\u03f4\u1e9e\u2126\u212b"
    return F.upper(F.lower(F.translate(text, others, "skiiθßωå")))


def literal(value: Column) -> Column:
    """A pattern for the string itself in any case, whole words where it begins and ends with a letter or digit."""
    quoted = F.regexp_replace(value, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.concat(F.lit(regex("", True)), F.when(value.rlike(ENDS_IN_LETTERS), F.concat(F.lit(r"\b"), quoted, F.lit(r"\b"))).otherwise(quoted))


def pairs_of(words: Column) -> Column:
    """(a, b) for all words that follow each other."""
    return F.filter(F.transform(words, lambda w, i: F.struct(w.alias("a"), F.get(words, i + 1).alias("b"))), lambda p: p["b"].isNotNull())


def pair_hash(pair: Column) -> Column:
    """Of a pair of folded words."""
    return F.xxhash64(F.lit(PAIR), pair["a"], pair["b"])


def listed(strings: DataFrame, value: str = "value") -> DataFrame:
    """``strings`` with size (PAIR for two words, 0 for a word, else the characters of a gram) and anchor, a hash; blank ones are left out."""
    v = F.col(value)
    every = F.regexp_extract_all(v, F.when(v.rlike(ENDS_IN_LETTERS), F.lit(WORD)).otherwise(F.lit(INNER_WORD)), F.lit(0))
    longest = F.array_max(F.transform(every, lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    pair = lambda ws: F.array_max(F.transform(pairs_of(F.transform(ws, folded)), lambda p: F.struct((F.length(p["a"]) + F.length(p["b"])).alias("n"), p.alias("p"))))["p"]
    size = F.when(F.size(every) > 1, F.lit(PAIR)).when(longest.isNull(), F.least(F.length(v), F.lit(GRAM))).otherwise(0)
    anchored = F.when(longest.isNull(), F.substring(v, F.lit(1), F.least(F.length(v), F.lit(GRAM)))).otherwise(longest)
    anchor = F.when(F.size(every) > 1, let(every, lambda ws: pair_hash(pair(ws)))).otherwise(F.xxhash64(size, folded(anchored)))
    return strings.where(v.isNotNull() & v.rlike(r"\S")).withColumns({"size": size, "anchor": anchor})


def anchors_of(text: Column, sizes: list[int]) -> Column:
    """Hashes of all pairs of words (size PAIR), words (size 0) and grams of a text, each once."""

    def of(size: int) -> Column:
        if size == PAIR:
            return let(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), folded), lambda ws: F.transform(pairs_of(ws), pair_hash))
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
        every = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)) if size == 0 else F.when(F.length(text) < 1 << 12, grams).otherwise(_grams_of_long(text, size))
        return F.transform(F.array_distinct(every), lambda x: F.xxhash64(F.lit(size), folded(x)))

    return F.array_distinct(F.concat(*map(of, sizes)))


def _grams_of_long(text: Column, size: int) -> Column:
    """Grams of a long text, from its characters: taking each by its place would read all before it."""
    letters = F.split(text, "", -1)
    return F.transform(F.arrays_zip(*(F.slice(letters, k + 1, F.size(letters)).alias(f"c{k}") for k in range(size))), lambda x: F.concat(*(F.coalesce(x[f"c{k}"], F.lit("")) for k in range(size))))


def _two_words(value: Column) -> Column:
    """Whether a string is two words, different ones whatever their case, and what parts them: it is then found at whole words only and never overlaps itself."""
    part = lambda n: F.regexp_extract(value, TWO_WORDS, n)
    return value.rlike(TWO_WORDS) & value.rlike(ENDS_IN_LETTERS) & (folded(part(1)) != folded(part(3)))


def _whole_hash(first: Column, gap: Column, second: Column) -> Column:
    return F.xxhash64(F.lit(PAIR), folded(first), gap, folded(second))


def _pairs_with_places(text: Column) -> Column:
    """array of (first, gap, second, start): the words that follow each other, with what parts them."""

    def pairs(w: Column, gaps: Column) -> Column:
        begins = running(F.zip_with(F.slice(gaps, 1, F.size(w)), w, lambda g, x: F.length(g) + F.length(x)))
        pair = lambda at: F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.struct(x.alias("first"), F.get(gaps, i + 1).alias("gap"), F.get(w, i + 1).alias("second"), (F.get(at, i) + F.length(F.get(gaps, i))).alias("start")))
        return let(begins, pair)

    kind = "array<struct<first:string,gap:string,second:string,start:int>>"
    some = lambda w: F.when(F.size(w) > 1, let(F.split(text, WORD, -1), lambda gaps: pairs(w, gaps))).otherwise(F.array().cast(kind))
    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), some)


def _find_two_words(held: DataFrame, strings: DataFrame, key: str, text_col: str, value: str) -> DataFrame:
    """:func:`find_listed` for strings of :func:`_two_words`."""
    part = lambda n: F.regexp_extract(value, TWO_WORDS, n)
    index = strings.distinct().withColumn("__anchor", _whole_hash(part(1), part(2), part(3)))
    slot, bit = F.pmod("__anchor", F.lit(SLOTS)), F.shiftrightunsigned("__anchor", 58).cast("int")
    signs = index.groupBy(slot.alias("__slot")).agg(F.expr("bit_or(shiftleft(1L, cast(shiftrightunsigned(__anchor, 58) AS int)))").alias("__bits"))
    whole = F.filter(_pairs_with_places(F.col(text_col)), lambda p: p["start"] >= 0)  # everything; of a plain column the optimizer would pull every field out
    pairs = held.select(F.col(key).alias("__key"), F.explode(whole).alias("p")).select("__key", "p.*")
    met = pairs.select("__key", "start", F.concat("first", "gap", "second").alias("excerpt"), _whole_hash(F.col("first"), F.col("gap"), F.col("second")).alias("__anchor"))
    may = met.withColumn("__slot", slot).join(F.broadcast(signs), "__slot").where(F.getbit("__bits", bit) == 1).drop("__slot", "__bits")
    found = may.withColumnsRenamed({"start": "__start", "excerpt": "__excerpt"}).join(index, "__anchor")
    same = F.when(F.col("__excerpt") == F.col(value), True).otherwise(F.rlike(F.col("__excerpt"), literal(F.col(value))))
    return found.where(same).select(F.col("__key").alias(key), *strings.columns, F.col("__start").alias("start"), (F.col("__start") + F.length("__excerpt")).alias("end"), F.col("__excerpt").alias("excerpt"))


def find_listed(docs: DataFrame, strings: DataFrame, key: str = "doc_id", text_col: str = "text", value: str = "value") -> DataFrame:
    """(key, columns of ``strings``, start, end, excerpt): a row for each place of each listed string in each text.

    Places are those of the rule for one string: without regard to case, whole words where the string
    begins and ends with a letter or digit, left to right, never overlapping places of the same
    string. Null and empty texts have none, and rows without a key are left out; texts with one key are
    searched each; a string that is listed twice is found once; null and blank ones are left out. The index is as long as the list: Spark sends it whole to all tasks
    only while its measured size is below ``spark.sql.autoBroadcastJoinThreshold``, and shuffles hashes
    beyond it; texts are read again for candidates only.
    """
    two = F.coalesce(_two_words(F.col(value)), F.lit(False))
    index = listed(strings.where(~two), value)
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())  # at most GRAM + 2
    held = docs.where(F.col(text_col).isNotNull() & F.col(key).isNotNull())
    plain = _find_two_words(held, strings.where(two), key, text_col, value)
    return plain.unionByName(_find_any(held, index, sizes, strings.columns, key, text_col, value)) if sizes else plain


def _find_any(held: DataFrame, index: DataFrame, sizes: list[int], own: list[str], key: str, text_col: str, value: str) -> DataFrame:
    """:func:`find_listed` for the strings of ``index``, by a search of each candidate."""
    words = held.select(F.col(key).alias("__key"), F.explode(anchors_of(F.col(text_col), sizes)).alias("anchor"))
    listed_there = F.struct(*own)
    candidates = words.join(index, "anchor").groupBy("__key").agg(F.collect_set(listed_there).alias("__listed"))  # of one text
    found = F.filter(F.transform("__listed", lambda s: F.struct(s.alias("s"), spans(F.col(text_col), literal(s[value])).alias("places"))), lambda x: F.size(x["places"]) > 0)
    rows = held.select(key, text_col).join(candidates, F.col(key) == F.col("__key")).select(key, F.explode(found).alias("f"))
    return rows.select(key, *(F.col(f"f.s.{c}").alias(c) for c in own), F.explode("f.places").alias("p")).select(key, *own, "p.start", "p.end", "p.excerpt")


def strings_of(spark, config: dict) -> DataFrame:
    """(category, value): the listed strings of a configuration as a table."""
    from glyphward.packs.personal_info import entries

    return spark.createDataFrame(entries(config, "strings"), "category string, value string")
