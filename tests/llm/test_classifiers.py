"""Toxicity and quality: exact inference against brute force, held-out accuracy, odd rows."""

import math
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphward.llm import queries as q
from glyphward.llm.labelled import Sample, logistic, sigmoid
from glyphward.llm.quality_cnn import SEGMENT, WIDTH, Network, fit_quality, score_quality
from glyphward.llm.quality_cnn import Scorer as Net
from glyphward.llm.toxicity_crf import Field, Scorer, _Ids, _Model, _windows, copies, features, fit, fit_toxicity, score_toxicity, split_words

FIELD = Field({"wbad": 4.0, "4awfu": 3.0, "wfine": -1.0}, -2.0, (0.3, -0.3), ((0.5, -0.4), (-0.7, 0.9)), (1.0, 0.5, 0.0))


def brute_marginals(words):
    """Over all labellings."""
    e = [FIELD.bias + sum(FIELD.weights.get(f, 0) for f in features(w)) for w in words]
    total, one = 0.0, np.zeros(len(words))
    for y in product((0, 1), repeat=len(words)):
        s = FIELD.start[y[0]] + sum(e[i] for i in range(len(y)) if y[i]) + sum(FIELD.steps[a][b] for a, b in zip(y, y[1:]))
        total += math.exp(s)
        one += math.exp(s) * np.array(y)
    return one / total


def test_forward_backward_is_exact():
    docs = [["bad", "fine", "x", "awful", "bad."], ["fine"], ["x"] * 9, ["awfully", "bad"]]
    at, p, first = Scorer(FIELD).marginals(split_words(pa.array([" ".join(d) for d in docs], pa.large_string())))
    for k, words in zip(at, docs):
        assert np.allclose(p[first[k] : first[k] + len(words)], brute_marginals(words), atol=1e-9)


def test_long_texts_cross_blocks():
    words = (["x", "fine", "bad"] * 700)[:1999]
    _, p, _ = Scorer(FIELD).marginals(split_words(pa.array([" ".join(words)], pa.large_string())))
    a, m = np.exp(FIELD.start), np.exp(np.array(FIELD.steps))
    e = [np.array([1, math.exp(FIELD.bias + sum(FIELD.weights.get(f, 0) for f in features(w)))]) for w in words]
    alpha = [a * e[0] / (a * e[0]).sum()]
    for x in e[1:]:
        v = (alpha[-1] @ m) * x
        alpha.append(v / v.sum())
    beta = [np.ones(2)]
    for x in e[:0:-1]:
        v = m @ (x * beta[-1])
        beta.append(v / v.sum())
    want = [(f * b / (f * b).sum())[1] for f, b in zip(alpha, beta[::-1])]
    assert np.allclose(p, want, atol=1e-9)


def test_spans_are_offsets():
    score, spans = Scorer(FIELD).score(["é  bad fine", None, "", "ok"])
    assert [(s["start"], s["end"]) for s in spans[0]] == [(3, 6)] and spans[1:] == [[], [], []]
    assert score[0] > score[3] >= score[1] == score[2]


def test_fit_learns_words_and_prefixes():
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(60)]
    texts, y = [], []
    for i in range(400):
        words = list(rng.choice(plain, 30))
        if i % 4 == 0:
            words[5] = rng.choice(["idiot", f"zorgx{i}"])
        texts.append(" ".join(words))
        y.append(int(i % 4 == 0))
    field = fit(Sample(texts, np.array(y), 0.25))
    score, spans = Scorer(field).score(["w1 w2 IDIOT, w3", "w4 zorgxnew w5", "w6 w7 w8"])
    assert score[0] > 0.5 and score[1] > 0.5 and score[2] < 0.3 and len(spans[0]) == len(spans[1]) == 1 and not spans[2]
    assert fit(Sample([], np.array([], int), 0.5)).calibration[-1] == 0.0


def test_words_beside_count():
    field = Field({"wbad": 2.0}, -1.0, FIELD.start, FIELD.steps, (1.0, 0.0, 0.0), {"wso": 1.5}, {"wyou": -0.7})
    words = "so bad you so x".split()
    e = [-1.0, -1 + 2 + 1.5 - 0.7, -1.0, -1.0, -1 + 1.5]
    got = Scorer(field).marginals(split_words(pa.array(["  " + "\t ".join(words) + "\n", "", "bad", "you"], pa.large_string())))
    total, one = 0.0, np.zeros(5)
    for y in product((0, 1), repeat=5):
        s = math.exp(field.start[y[0]] + sum(e[i] for i in range(5) if y[i]) + sum(field.steps[a][b] for a, b in zip(y, y[1:])))
        total, one = total + s, one + s * np.array(y)
    assert list(got[0]) == [0, 2, 3] and np.allclose(got[1][:5], one / total, atol=1e-9) and list(got[2]) == [0, 5, 6]


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    words = split_words(pa.array(["a b c a d", "c c", "", "d a b"], pa.large_string()))
    table = rng.integers(0, 6, (len(words.distinct), 5)).astype(np.int32)
    ids, places = _Ids(words, table), _windows(words.counts)
    gold = np.r_[rng.integers(0, 2, len(words.codes)), 0]
    model = _Model(6)
    model.theta[:] = rng.normal(0, 0.5, len(model.theta))
    model.theta[[0, 6, 12]] = 0

    def loss():
        e, out = model.emissions(ids[np.arange(len(words.codes))]), 0.0
        for row in places:
            at = row[row >= 0]
            paths = {y: sum(e[i] for i, k in zip(at, y) if k) + model.start[y[0]] + sum(model.steps[a, b] for a, b in zip(y, y[1:])) for y in product((0, 1), repeat=len(at))}
            out += math.log(sum(map(math.exp, paths.values()))) - paths[tuple(gold[at])]
        return out / (places >= 0).sum()

    got = model._gradient(ids[places], gold[places], places >= 0)
    for k in [1, 3, 5, 7, 8, 13, 16, *range(18, 25)]:
        model.theta[k] += 1e-5
        up = loss()
        model.theta[k] -= 2e-5
        down = loss()
        model.theta[k] += 1e-5
        assert got[k] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_copies_are_told():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(300)], 80)) for _ in range(30)]
    texts += [texts[0], texts[0] + " more", texts[1].replace(texts[1].split()[40], "x"), "", "w1 w2"]
    group = copies(split_words(pa.array(texts, pa.large_string())))
    assert group[30] == group[31] == group[0] and group[32] == group[1] and len(set(group)) == 32


def brute_chunks(net, text):
    """Every filter at every place, pooled over chunks of two segments."""
    n = -(-(len(text) + WIDTH) // SEGMENT)
    data = bytes(WIDTH) + text + bytes(n * SEGMENT - len(text))
    response = np.stack([sum(net.table[j][data[i + j]] for j in range(WIDTH)) for i in range(n * SEGMENT)])
    ends = [(k * SEGMENT, min(n, k + 2) * SEGMENT) for k in range(max(1, n - 1))]
    return np.array([np.maximum(response[a:b].max(axis=0) + net.bias, 0) @ net.dense + net.dense_bias for a, b in ends])


def test_network_is_the_plain_convolution():
    rng = np.random.default_rng(1)
    net = Network(rng.normal(size=(WIDTH, 256, 16)), rng.normal(size=16), rng.normal(size=16), 0.3, np.array([1.0, 0.5, -0.5, 0.1]))
    texts = [b"", b"a", bytes(rng.integers(32, 120, 250, dtype=np.uint8)), bytes(rng.integers(32, 120, 1700, dtype=np.uint8))]
    got = Net(net).summaries(texts)
    for row, t in zip(got, texts):
        c = brute_chunks(net, t)
        assert np.allclose(row, [c.mean(), c.min(), c.max()], atol=1e-4)
    assert np.allclose(Net(net).score(texts), sigmoid(np.c_[got, np.ones(4)] @ net.calibration))


def test_logistic():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 1))
    y = (rng.random(3000) < sigmoid(2 * x[:, 0] - 1)).astype(int)
    assert np.allclose(logistic(x, y, np.ones(3000), ridge=1e-9), [2, -1], atol=0.25)


@pytest.mark.parametrize(("name", "label", "folds", "fold", "least"), [("op1_toxicity", "toxic", 4, 2, 0.93), ("op5_quality_classifier", "quality", 3, 1, 0.93)])
def test_held_out_accuracy(spark, name, label, folds, fold, least):
    sf_dir = "/root/testdata/sf0.01"
    rows = q.QUERIES[name](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(h == (zlib.crc32(str(i).encode()) % folds == fold) for i, h in zip(rows.doc_id, rows.held_out))
    assert rows.score.between(0, 1).all()
    known = rows.merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    known = known[known.held_out]
    assert (known.predicted == known[label]).mean() >= least


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "idiot text", "a"), (1, "idiot text", "a"), (2, None, "b"), (None, "", "c"), (3, "long " * 60000, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 1), (2, None, 0), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for scored in (score_toxicity(docs, fit_toxicity(docs, labels), "t").select("doc_id", "score", F.col("t.score").alias("s")), score_quality(docs, fit_quality(docs, labels), "t").select("doc_id", "score", F.col("t").alias("s"))):
        rows = scored.collect()
        assert len(rows) == 5 and all(0 <= r["s"] <= 1 for r in rows) and {r["score"] for r in rows} == set("abcd")
        assert len({r["s"] for r in rows if r["doc_id"] == 1}) == 1
    empty = docs.limit(0)
    assert score_toxicity(empty, fit_toxicity(empty, labels.limit(0))).isEmpty() and score_quality(empty, fit_quality(empty, labels.limit(0))).isEmpty()
