"""Resampling, the conversation trie and the n-gram join against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from glyphward.llm import conversation_trie as ct
from glyphward.llm import importance_resampling as ir
from glyphward.llm import prefix_tree_join as pt

DOCS = "doc_id long, text string, lang string, score int, key string"  # the last two clash with names inside


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_joined_checksums():
    texts = ["Hello, World foo2 bär über", "", "a", "a b", " x" * 50 + " " + "z" * 200 + " q " + "w" * 64 + " " + "ü" * 3000, "A-B c's"]
    bucket, of, n_words = ir.features(pa.array(["zz", *texts], pa.large_string()).slice(1), ir.Checksums())
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(t))
        grams = [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]
        assert sorted(zlib.crc32(g.encode()) % 10_000 for g in grams) == sorted(bucket[of == i].tolist())
        assert n_words[i] == len(w)


def resample_brute(docs, target, percent):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(text))
        return len(w), Counter(zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1))

    held, wanted = [grams(t) for _, t in docs], [grams(t)[1] for t in target]
    s, t = Counter(), Counter()
    for _, g in held:
        s.update(g)
    for g in wanted:
        t.update(g)
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for (doc_id, _), (n, g) in zip(docs, held, strict=True):
        weight = sum(c * math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000)))) for b, c in g.items())
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, sum(g.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_resampling(spark, percent):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words[i % 3 :: 3], k=rng.randrange(0, 60)))) for i in range(150)]
    docs += [(7, "Again and AGAIN " * 30)] * 40 + [(None, "no id " * 20), (None, None), (500, None), (501, ""), (502, "word " * 5_000)]
    target = [" ".join(rng.choices(words[::3], k=30)) for _ in range(5)] + [None, ""]
    rows = spark.createDataFrame([(*d, "x", 1, "k") for d in docs], DOCS).repartition(3)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = ir.importance_ranks(rows, wanted, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == resample_brute(docs, target, percent)
    drawn = ir.resample(rows, wanted, percent=percent)
    assert drawn.columns == rows.columns
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in got.where("rank IS NOT NULL").collect()}


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    wanted = spark.createDataFrame([], "item_id long, text string")
    assert ir.importance_ranks(none, wanted).collect() == []
    one = spark.createDataFrame([(1, "a " * 30, None, 0, None)], DOCS)
    assert [r["rank"] for r in ir.importance_ranks(one, wanted, percent=100).collect()] == [1]


def groups_brute(docs, words=3, least=90, of=100):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", small(text))
        sets.append(frozenset([" ".join(w)] if 0 < len(w) < words else (" ".join(w[i : i + words]) for i in range(len(w) - words + 1))))
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and of * len(a & sets[j]) >= least * len(a | sets[j]):
                x, y = label[i], label[j]
                label = [y if k == x else k for k in label]
    least_id = defaultdict(list)
    for (doc_id, _), k in zip(docs, label, strict=True):
        if doc_id is not None:
            least_id[k].append(doc_id)
    return sorted(((d, len(s), (min(least_id[k]) if least_id[k] else None) if s else d) for (d, _), s, k in zip(docs, sets, label, strict=True)), key=str)


def near_copies(rng, texts, n):
    out = []
    for _ in range(n):
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(["new", "other", f"x{rng.randrange(50)}"])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_jaccard_groups(spark, block):
    rng = random.Random(block)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=n)) for n in (3, 5, 12, 40, 60, 60, 200)]
    texts = base + near_copies(rng, base, 160) + [" ".join(rng.choices(words, k=30)) for _ in range(30)] + ["", None, " \n", "one", "One", "two words", "ONE", base[4].upper(), base[4] + " \t"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 5 + [(None, base[5]), (None, "nowhere else to be seen"), (None, None)]
    rng.shuffle(docs)
    rows = spark.createDataFrame([(*d, "x", 1, "k") for d in docs], DOCS).repartition(3)
    if block == 1024:
        got = pt.jaccard_groups(rows)
    else:  # groups that are cut, and compared in pairs of parts
        sets = pt.save(pt.keyed(rows), "sets")
        tree = {r.node: r.root for r in pt.set_components(pt.ordered_sets(rows, sets), block=block).collect()}
        held = [r for r in sets.collect()]
        least = {}
        for r in held:
            k = tree.get(r.key, r.key)
            if r.doc_id is not None:
                least[k] = min(least.get(k, r.doc_id), r.doc_id)
        got = None
        assert sorted(((r.doc_id, r.n, least.get(tree.get(r.key, r.key)) if r.n else r.doc_id) for r in held), key=str) == groups_brute(docs)
    if got is not None:
        assert sorted(map(tuple, got.collect()), key=str) == groups_brute(docs)


def test_groups_that_stay_apart_are_compared_over_parts(spark):
    """Sets that all share a frequent shingle but are of two kinds: every link is found though their group is cut."""
    rng = random.Random(5)
    texts = []
    for kind in range(12):
        own = [f"k{kind}w{i}" for i in range(28)]
        texts += [" ".join(["the", "same", "start", *own[:27], f"tail{kind}{i}"]) for i in range(3)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    rows = spark.createDataFrame([(*d, "x", 1, "k") for d in docs], DOCS)
    sets = pt.save(pt.keyed(rows), "sets")
    tree = pt.set_components(pt.ordered_sets(rows, sets), block=2)
    assert tree.select("root").distinct().count() == 12 and tree.count() == 36


def test_jaccard_of_nothing(spark):
    assert pt.jaccard_groups(spark.createDataFrame([], DOCS)).collect() == []
    blank = spark.createDataFrame([(1, "", "x", 1, "k"), (2, None, "x", 1, "k")], DOCS)
    assert sorted(map(tuple, pt.jaccard_groups(blank).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_frequent_shingles_are_atoms_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(pt, "FREQUENT", 3)
    rng = random.Random(9)
    base = [" ".join(rng.choices([f"w{i}" for i in range(40)], k=50)) for _ in range(4)]
    docs = list(enumerate(base + near_copies(rng, base, 60)))
    rows = spark.createDataFrame([(*d, "x", 1, "k") for d in docs], DOCS).repartition(4)
    assert len(pt.frequent_shingles(pt.keyed(rows))) > 100
    assert sorted(map(tuple, pt.jaccard_groups(rows).collect()), key=str) == groups_brute(docs)


@pytest.mark.parametrize("least, of", [(90, 100), (1, 2)])
def test_tree_links_of_random_sets(least, of):
    rng = random.Random(least)
    for _ in range(60):
        base = [set(rng.sample(range(400), rng.choice([3, 10, 60]))) for _ in range(rng.choice([1, 2, 4]))]
        sets = []
        for _ in range(rng.choice([2, 5, 30])):
            s = set(rng.choice(base))
            for _ in range(rng.choice([0, 1, 2, 5])):
                s ^= {rng.randrange(500)}
            if s and s not in sets:
                sets.append(s)
        held = Counter(x for s in sets for x in s)
        rows = [sorted(x for x in s if held[x] > 1) for s in sets]
        flat = np.array([x for r in rows for x in r], np.int64)
        links = pt.tree_links(np.array([len(s) for s in sets]), np.array([len(r) for r in rows]), flat, np.ones(len(flat), np.int32), None, least, of)
        got, true = list(range(len(sets))), list(range(len(sets)))
        for i, j in links:
            assert of * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])
            got = [got[j] if k == got[i] else k for k in got]
        for i, a in enumerate(sets):
            for j in range(i):
                if of * len(a & sets[j]) >= least * len(a | sets[j]):
                    true = [true[j] if k == true[i] else k for k in true]
        assert len(links) == len(sets) - len(set(true))
        assert len({*zip(got, true, strict=True)}) == len(set(true)) == len(set(got))


def trie_brute(rows, rebuild=True):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in turns.items()}
    convs = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        convs[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + x[h:])
    nodes = defaultdict(list)
    for c, x in convs.items():
        for d in range(len(x) + 1):
            nodes[x[:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p, members: hashlib.sha256(",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p, m)) for p, m in nodes.items()), key=str)


TURNS = "conv_id long, turn long, role string, text string, a long, depth int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS).repartition(4)


def columns(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def test_trie_of_rebuilt_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 12), *range(100, 109), 213, 214, -5, -100, 400]:
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ho", "", None, "long text"])) for t in range(rng.randrange(1, 8))]
    rows += [(400, None, "user", "first"), (400, 2, "user", "tie"), (400, 2, "user", "tie"), (400, 2, None, None), (None, 1, "user", "nobody"), (500, 0, "user", "é" * 70_000)]
    assert columns(ct.conversation_trie(turns_of(spark, rows))) == trie_brute(rows)


def test_trie_of_long_conversations(spark, monkeypatch):
    """Paths of many segments that part inside, at the ends of and below segments, and a conversation of most of the rows."""
    monkeypatch.setattr(ct, "SEGMENT", 4)
    rng = random.Random(8)
    trunk = [("user", f"t{i}") for i in range(60)]
    seqs = {1: trunk, 2: trunk[:31], 3: trunk[:8] + [("user", "other")], 4: trunk[:8], 5: trunk[:6] + [("x", "y")] * 9, 6: trunk[:6] + [("x", "y")] * 3, 7: trunk[:6] + [("x", "y")] * 3, 8: [("z", "z")], 9: trunk[:59] + [("q", "q")]}
    for c in range(10, 40):
        seqs[c] = trunk[: rng.randrange(1, 30)] + [("user", f"own {rng.randrange(4)}")] * rng.randrange(0, 12)
    rows = [(c, i, *t) for c, s in seqs.items() for i, t in enumerate(s)]
    assert columns(ct.plain_trie(turns_of(spark, rows))) == trie_brute(rows, rebuild=False)


def test_trie_of_nothing(spark):
    assert ct.conversation_trie(turns_of(spark, [])).collect() == []
    rows = [(101, 0, "user", "gone")]  # of another's opening, which is not there
    assert columns(ct.conversation_trie(turns_of(spark, rows))) == trie_brute(rows)
