"""SimHash groups and packing against brute force."""

import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from glyphward.llm import packing
from glyphward.llm import queries as q
from glyphward.llm.components import components
from glyphward.llm.packing import WordTokens, pack, shortest_pack_first
from glyphward.llm.simhash_ball import fingerprint, near_duplicates, near_pairs


def plain_fingerprint(text):
    """Bit by bit."""
    words, now = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words, now = words + [now] * bool(now), ""
        else:
            now += c.lower() if "A" <= c <= "Z" else c
    words += [now] * bool(now)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest index reachable, by comparing all pairs."""
    top = list(range(len(prints)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            a, b = sorted((find(i), find(j)))
            top[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprint():
    for t in ["", None, "one", "Two Words", "A b\tc\x0bd  e", "é\xa0É x y z", "w " * 40000, "a b c a b c a b c d"]:
        assert fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t)


def test_links_lose_none_and_make_none(spark):
    rng = random.Random(3)
    prints = {0}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(6):
            prints.add(base)
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 4))):
                base ^= 1 << b
    low, high = 0b111, 0b111 << 61
    prints |= {low, high, low ^ (1 << 40), high ^ 0b11}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"))
    for a, b in pairs.collect():
        assert 1 <= ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3
    root = {r["node"]: r["root"] for r in components(pairs, "a", "b").collect()}
    want = brute_components(prints)
    for i, j in combinations(range(len(prints)), 2):
        same = root.get(signed[i], signed[i]) == root.get(signed[j], signed[j])
        assert same == (want[i] == want[j])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (3, 2), (500, 499), (499, 501)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 499: 499, 500: 499, 501: 499}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(9, 5), (9, 1), (8, 5), (8, 2)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            top[hi] = lo
    rows = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["root"] for r in rows} == {x: find(x) for x in top}


def test_query_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    got = q.QUERIES["op3_simhash_near_dedup"](spark, sf_dir).toPandas().sort_values("doc_id")
    prints = [plain_fingerprint(t) for t in docs.text]
    assert list(got.fingerprint) == [f"{p:016x}" for p in prints]
    ids = list(docs.doc_id)
    assert list(got.component_id) == [ids[k] for k in brute_components(prints)]
    rows = spark.createDataFrame([(5, None, 1), (4, "", 2), (4, "", 2), (None, " \n", 3), (9, "same words here twice", 4), (8, "Same words HERE twice", 5), (None, "lone row of its own", 6)], "doc_id long, text string, fp long")
    out = near_duplicates(rows).collect()
    assert len(out) == 7
    assert {r["component_id"] for r in out if r["fingerprint"] == "0" * 16} == {4}
    assert {r["component_id"] for r in out if r["doc_id"] in (8, 9)} == {8}
    assert near_duplicates(rows.limit(0)).isEmpty()


def test_pipeline_dedup_keeps_one_of_each(spark):
    import corpus_pipeline

    rows = spark.createDataFrame([(3, "a b c d e", "en", "s", 9), (1, "A B C D E", "en", "s", 9), (2, "other words in this one", "en", "s", 9), (2, "other words in this one", "en", "s", 9), (None, "no id here", None, None, None), (None, "no id here", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.simhash_near_dedup(spark, rows, "")
    assert out.columns == rows.columns and sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 2]


def test_pipeline_dedup_leads_each_group_once(spark):
    import corpus_pipeline

    rows = [
        (1, "one id on this text"), (1, "and on quite another one"), (5, "AND on quite another one"),  # leads two groups
        (7, "led by seven only here"), (7, "Led By seven only here"), (9, "led by seven only HERE"),
        (None, "no id on any of these"), (None, "NO id on any of these"), (None, "no ID on any of these"),
        (None, "a near copy of three"), (3, "A near copy of three"),
        (None, None), (None, ""), (8, "alone on its own text"),
    ]
    table = spark.createDataFrame([(d, t, "en", "s", 9) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.simhash_near_dedup(spark, table, "")
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = [(1, "one id on this text"), (1, "and on quite another one"), (7, "Led By seven only here"), (None, "NO id on any of these"), (3, "A near copy of three"), (None, None), (8, "alone on its own text")]
    assert got == sorted(want, key=str) and out.columns == table.columns
    assert corpus_pipeline.simhash_near_dedup(spark, table.limit(0), "").isEmpty()


def test_shortest_pack_first():
    rng = random.Random(1)
    for _ in range(20):
        histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        patterns = shortest_pack_first(dict(histogram), 64)
        used = {}
        for lengths, count in patterns:
            assert sum(lengths) <= 64 and count > 0
            for n in lengths:
                used[n] = used.get(n, 0) + count
        assert used == histogram and len(patterns) <= 2 * len(histogram)
    assert shortest_pack_first({}, 64) == []


@pytest.mark.parametrize("hot", [2, 100, 400, 1000, 2000])
def test_a_common_length_shares_sequences(hot):
    rng = random.Random(2)
    histogram = {n: rng.randint(1, 4) for n in rng.sample(range(1, 3000), 300)}
    histogram[hot] = histogram.get(hot, 0) + sum(histogram.values()) // 2
    patterns = shortest_pack_first(histogram, 4096)
    assert all(sum(lengths) <= 4096 for lengths, _ in patterns) and len(patterns) <= 2 * len(histogram)
    assert sum(count for _, count in patterns) <= 1.03 * sum(n * k for n, k in histogram.items()) / 4096 + 1
    assert sum(count for _, count in shortest_pack_first({hot: 10_000}, 4096)) == -(-10_000 // (4096 // hot))


def test_packing_hot_length(spark):
    rows = spark.range(500).selectExpr("id AS doc_id", "'many words here' AS text")  # 4 tokens each
    out = pack(rows, q.tokenizer_path(), 18).toPandas()
    assert len(out) == 500 and set(out.length) == {4} and sorted(set(out.sequence_id)) == list(range(125))
    assert all(sorted(part.offset) == [0, 4, 8, 12] for _, part in out.groupby("sequence_id"))


def test_word_tokens_are_those_of_the_tokenizer():
    words = WordTokens(q.tokenizer_path())
    texts = ["", "Hello, WORLD!! don't stop", "İstanbul Straße ÉTÉ été. ǅ", "x<|endoftext|>y <|startoftext|>", "a b c\x1cd\x85e", "é Å.,", "123 4.5 中文字。 😀!? ..,;", "Σίσυφος ΟΔΟΣ", "we're they'll 'tis 's", "x" * 3000, "word, word. word; word: word!?"]
    rng = random.Random(5)
    letters = "abcXYZéÉüßñİıſKΣσς'.,!?;:*&%#$<>|0129٣ \t\n\x0b\x1c\x85 \u0301中文😀ǅ’`´_-"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(3000)]
    ids, ends = words.encode(pa.array(texts, pa.large_string()), 2)
    assert len(ends) == len(texts) and ends[-1] == len(ids)
    for t, part in zip(texts, np.split(ids, ends[:-1])):
        assert part.tolist() == [*words.whole.encode(t, add_special_tokens=False).ids, 2], t
    again, _ = words.encode(pa.array(texts, pa.large_string()), 2)
    assert again.tolist() == ids.tolist()


def test_word_cache_forgets_what_is_not_used(monkeypatch):
    monkeypatch.setattr(packing, "YOUNG_WORDS", 50)
    words = WordTokens(q.tokenizer_path())
    for i in range(0, 900, 30):
        texts = [f"the word{'abcdefghij'[i % 7]} " + " ".join(f"x{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abcdefghijklmnopqrstuvwxyz'[k // 26]}" for k in range(i % 600, i % 600 + 30))]
        ids, _ = words.encode(pa.array(texts, pa.large_string()), 2)
        assert ids.tolist() == [*words.whole.encode(texts[0], add_special_tokens=False).ids, 2]
        assert len(words.young) + len(words.old) < 200


def test_packing_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(q.tokenizer_path())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = q.QUERIES["op4_packing"](spark, sf_dir).toPandas().sort_values(["doc_id", "start"])
    assert set(rows.doc_id) == set(docs)
    for doc_id, part in rows.groupby("doc_id"):
        ids = np.array([*whole.encode(docs[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert list(part.start) == list(np.cumsum([0, *part.length])[:-1]) and part.length.sum() == len(ids) and set(part.doc_tokens) == {len(ids)}
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(part.start, part.length)] == list(part.ids_crc32)
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == list(np.cumsum([0, *part.length])[:-1]) and part.length.sum() <= 4096
    assert sorted(set(rows.sequence_id)) == list(range(rows.sequence_id.nunique()))


@pytest.mark.parametrize("capacity", [8, 4096])
def test_packing_odd_rows(spark, capacity):
    rows = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "some words here", "z"), (2, "many words " * 400, "w")], "doc_id long, text string, length string")
    out = pack(rows, q.tokenizer_path(), capacity).collect()
    assert sum(r["length"] for r in out) == 1 + 1 + 4 + 801 and all(len(r["ids"]) == 4 * r["length"] for r in out)
    assert pack(rows.limit(0), q.tokenizer_path()).isEmpty()
