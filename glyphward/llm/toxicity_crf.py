"""Toxic spans by a linear-chain conditional random field over the words of a document.

The labels are of documents, so the words of the training sample get theirs in two steps. First a
word of a toxic document is labelled toxic if itself or one of its prefixes occurs in toxic
documents only, oftener than chance allows among all features tried. Then the field that these
labels gave labels the words of toxic documents anew by its own marginals, and is fitted on. The
field has an emission weight for each word and prefix and for the words beside, transitions between
the two states and start weights, fitted to the likelihood of all words of the sample.
Forward-backward gives each word's marginal; the largest marginal and the expected number of toxic
words give a document's score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphward.llm.labelled import Sample, labelled_sample, logistic, sigmoid
from glyphward.llm.tables import small_batches
from glyphward.llm.worker import give_back, held

PREFIXES = (4, 5, 6, 7)
OWN = 1 + len(PREFIXES)  # features of a word itself
WINDOW = 48  # words in a training sequence
BATCH = 2_000  # training sequences in a step
HASHED = 22  # bits of a feature's hash
MANY = 60_000  # words of the sample whose marginals are taken together
LEAST_STEPS = 12  # for each epoch asked for
BLOCK = 128  # words in a block of the scan
SLICE = 1 << 21  # characters of texts that are scanned together
YOUNG_WORDS = 100_000  # words whose emissions a Python worker keeps for sure; as many older ones may be there
SPAN_AT = 0.5  # marginal from which a word is reported
WORD = re.compile(r"[^ \t-\r]+")  # as the scan cuts words
SCHEMA = "struct<score:double,spans:array<struct<start:int,end:int,marginal:double>>>"


def features(word: str) -> list[str]:
    """The features of a lower-cased word: its letters without surrounding punctuation, and their prefixes."""
    bare = word.strip(".,!?;:\"'()[]{}<>*#%&$-_/\\|")
    return ["w" + bare, *(f"{n}{bare[:n]}" for n in PREFIXES if len(bare) > n - 1)] if bare else []


@dataclass
class Field:
    weights: dict[str, float]
    bias: float
    start: tuple[float, float]
    steps: tuple[tuple[float, float], tuple[float, float]]
    calibration: tuple[float, ...]  # of the document's measures, then the intercept
    before: dict[str, float] = field(default_factory=dict)  # what a word adds to the next one
    after: dict[str, float] = field(default_factory=dict)  # and to the one before it


@dataclass
class Words:
    """Documents as words: the distinct ones in small case, a code for each word in turn, and the number of words of each document."""

    distinct: list[str]
    codes: np.ndarray
    counts: np.ndarray

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def split_words(texts: pa.Array) -> Words:
    """``texts``: large_string without nulls, cut at ASCII white space."""
    split = pc.ascii_split_whitespace(texts)
    flat, counts = split.flatten(), split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(flat, "")
    if not pc.all(full).as_py():  # white space at either end leaves empty parts
        mask = full.to_numpy(zero_copy_only=False)
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[mask], minlength=len(counts))
        flat = flat.filter(full)
    words = flat.dictionary_encode()
    return Words([w.lower() for w in words.dictionary.to_pylist()], words.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)


def _feature_table(distinct: list[str], times: np.ndarray, toxic: np.ndarray) -> tuple[list[str], np.ndarray, int]:
    """(features, ids of the features of each word, number of features of toxic words); id 0 stands for none.

    ``times`` counts the places of each word; ``toxic`` tells whether it is in a toxic document.
    Features with a single place are left out: they are told by counts of their hashes, so that the
    strings of these, most of all features, are never held.
    """
    places, in_toxic = np.zeros(1 << HASHED, np.uint8), np.zeros(1 << HASHED, bool)
    hashes = np.full((len(distinct), OWN), -1, np.int32)
    for row, word in zip(hashes, distinct, strict=True):
        for k, f in enumerate(features(word)):
            row[k] = crc32(f.encode()) & (1 << HASHED) - 1
    for k in range(OWN):
        real = hashes[:, k] >= 0
        np.add.at(places, hashes[real, k], np.minimum(times[real], 2).astype(np.uint8))
        np.minimum(places, 2, out=places)
        in_toxic[hashes[real & toxic, k]] = True
    often = (hashes >= 0) & (places[hashes] > 1)
    del hashes
    index: dict[str, int] = {"": 0}
    table = np.zeros((len(distinct), OWN), np.int32)
    for i in np.flatnonzero(often.any(axis=1)).tolist():
        for k, f in enumerate(features(distinct[i])):
            if often[i, k]:
                table[i, k] = index.setdefault(f, len(index))
    return list(index), table, int(in_toxic.sum())


def copies(words: Words, seeds: int = 4, run: int = 5) -> np.ndarray:
    """A group number for each document: documents are copies if any of ``seeds`` least hashes of their runs of ``run`` words are equal."""
    n, codes = len(words.counts), words.codes.astype(np.uint64)
    top = np.arange(n)

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    at = np.flatnonzero(words.counts)
    begin = (np.cumsum(words.counts) - words.counts)[at]
    document = words.document
    for seed in range(seeds):
        h = np.full(len(codes), 0x9E3779B97F4A7C15 * (2 * seed + 1) & (1 << 64) - 1, np.uint64)
        for k in range(run):  # runs are cut at the end of a document
            inside = np.arange(len(codes)) + k < len(codes)
            inside[inside] = document[k:] == document[: len(codes) - k]
            following = np.zeros(len(codes), np.uint64)
            following[inside] = codes[np.flatnonzero(inside) + k] + np.uint64(1)
            h = (h ^ following) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        least = np.minimum.reduceat(h, begin) if len(at) else h
        order = np.argsort(least, kind="stable")
        for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            if least[i] == least[j]:
                a, b = sorted((root(int(at[i])), root(int(at[j]))))
                top[b] = a
    return np.array([root(i) for i in range(n)], np.int64)


def toxic_features(words: Words, table: np.ndarray, size: int, tried: int, y: np.ndarray) -> np.ndarray:
    """Which features occur in documents of label 1 only (2 % of others allowed), in more of them than chance explains at 5 % over all ``tried`` features.

    Copies count once, as they do not tell of each other.
    """
    docs, group = np.zeros((2, size), np.int64), copies(words)  # documents of each label that have a feature
    begin = np.cumsum(words.counts) - words.counts
    total = [0, 0]
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        own = own[np.argsort(group[own], kind="stable")]
        for same in np.split(own, np.flatnonzero(np.diff(group[own])) + 1) if len(own) else []:
            codes = np.unique(np.concatenate([words.codes[begin[i] : begin[i] + words.counts[i]] for i in same]))
            docs[label][np.unique(table[codes])] += 1
            total[label] += 1
    b, a = total
    if not a or not b:
        return np.zeros(size, bool)
    least = max(3.0, math.log(max(tried, 2) / 0.05) / math.log((a + b) / a))
    found = (docs[1] >= least) & (docs[0] / b <= 0.02 * docs[1] / a)
    found[0] = False
    return found


def fit(sample: Sample, seed: int = 7, epochs: int = 8, again: int = 4) -> Field:
    """Label the words of the sample, fit the field to all of them, label and fit again, and calibrate document scores."""
    words = split_words(pa.array(sample.texts, pa.large_string()))
    in_toxic = (sample.y == 1)[words.document]
    n = len(words.distinct)
    names, table, tried = _feature_table(words.distinct, np.bincount(words.codes, minlength=n), np.bincount(words.codes, in_toxic, n) > 0)
    words.distinct = []
    bad = toxic_features(words, table, len(names), tried, sample.y)
    gold = bad[table].any(axis=1)[words.codes] & in_toxic
    rng = np.random.default_rng(seed)
    model = _Model(len(names))
    places = _windows(words.counts)
    ids = _Ids(words, table)
    if gold.any():
        model.learn(ids, gold, places, epochs, rng)
        # what the field itself finds in toxic documents
        gold = in_toxic & (gold | (_marginals_of(model, words, ids) >= SPAN_AT))
        model.learn(ids, gold, places, again, rng)
    del ids, places, gold, in_toxic, words, table
    give_back()

    def kept(w: np.ndarray, first: int = 0) -> dict[str, float]:
        return {names[i][first:]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 0.02)}

    own, before, after = model.tables()
    done = Field(kept(own), float(model.bias[0]), tuple(model.start.tolist()), tuple(map(tuple, model.steps.tolist())), (0.0, 0.0, 0.0, 0.0), kept(before), kept(after))
    if len(set(sample.y)) > 1:
        scorer = Scorer(done)
        parts = [scorer.summaries(split_words(pa.array(sample.texts[at : at + 100], pa.large_string()))) for at in range(0, len(sample.texts), 100)]
        balance = np.where(sample.y == 1, sample.prior / sample.y.mean(), (1 - sample.prior) / (1 - sample.y.mean()))
        done.calibration = tuple(logistic(np.concatenate([np.stack(p, axis=1) for p in parts]), sample.y, balance).tolist())
    else:
        done.calibration = (0.0, 0.0, 0.0, math.log(max(sample.prior, 1e-6) / max(1 - sample.prior, 1e-6)))
    return done


def _windows(counts: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) places of all words, every document cut into windows; -1 behind its end."""
    each = -(-counts // WINDOW)
    document = np.repeat(np.arange(len(counts)), each)
    within = (np.arange(len(document)) - np.repeat(np.cumsum(each) - each, each)) * WINDOW
    first = (np.cumsum(counts) - counts)[document] + within
    place = first[:, None] + np.arange(WINDOW)
    return np.where(np.arange(WINDOW) < (counts[document] - within)[:, None], place, -1)


class _Ids:
    """Feature ids by places of words: those of the word itself, and the whole words before and after it in its document. Place -1 has none."""

    def __init__(self, words: Words, table: np.ndarray):
        none = len(table)
        self.table = np.concatenate([table, np.zeros((1, OWN), np.int32)])
        self.codes, self.before, self.after = (np.full(len(words.codes) + 1, none, np.int32) for _ in range(3))
        self.codes[:-1] = words.codes
        document = words.document
        same = document[1:] == document[:-1]
        self.before[1:-1] = np.where(same, words.codes[:-1], none)
        self.after[:-2] = np.where(same, words.codes[1:], none)

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        beside = np.stack([self.table[x[places], 0] for x in (self.before, self.after)], axis=-1)
        return np.concatenate([self.table[self.codes[places]], beside], axis=-1)


class _Model:
    """Parameters of the field under Adam: three tables of weights (own features, word before, word after), bias, start and transitions."""

    def __init__(self, size: int):
        self.size = size
        self.theta = np.zeros(3 * size + 7)
        self.theta[3 * size] = -2.0
        self.first, self.second = np.zeros_like(self.theta), np.zeros_like(self.theta)
        self.step = 0
        self.offset = np.array([0] * OWN + [size, 2 * size])

    @property
    def bias(self) -> np.ndarray:
        return self.theta[3 * self.size :][:1]

    @property
    def start(self) -> np.ndarray:
        return self.theta[3 * self.size + 1 :][:2]

    @property
    def steps(self) -> np.ndarray:
        return self.theta[3 * self.size + 3 :].reshape(2, 2)

    def tables(self) -> np.ndarray:
        return self.theta[: 3 * self.size].reshape(3, self.size)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return self.theta[ids + self.offset].sum(axis=-1) + self.bias

    def learn(self, ids: _Ids, gold: np.ndarray, places: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
        truth = np.r_[gold, False].astype(np.int64)
        epochs = max(epochs, epochs * LEAST_STEPS // -(-len(places) // BATCH))  # a small sample is gone over oftener
        for epoch in range(epochs):
            order = rng.permutation(len(places))
            rate = 0.15 if epoch < 0.75 * epochs else 0.04
            for at in range(0, len(order), BATCH):
                pick = places[order[at : at + BATCH]]
                self._update(self._gradient(ids[pick], truth[pick], pick >= 0), rate)

    def _update(self, g: np.ndarray, rate: float, ridge: float = 2e-5) -> None:
        self.step += 1
        g += ridge * self.theta
        self.first += 0.1 * (g - self.first)
        self.second += 0.01 * (g * g - self.second)
        self.theta -= rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.99**self.step)) + 1e-6)
        self.theta[[0, self.size, 2 * self.size]] = 0  # no feature

    def _gradient(self, ids: np.ndarray, gold: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of the mean negative log likelihood of windows, by forward-backward."""
        n, length, _ = ids.shape
        size, m = 3 * self.size, np.exp(self.steps)
        x = np.exp(np.clip(self.emissions(ids), -30, 30)) * mask + ~mask
        both = mask[:, 1:] & mask[:, :-1]
        alpha, beta = np.empty((length, n, 2)), np.ones((length, n, 2))
        alpha[0] = np.exp(self.start) * np.c_[np.ones(n), x[:, 0]]
        alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
        for t in range(1, length):
            alpha[t] = (alpha[t - 1] @ m) * np.c_[np.ones(n), x[:, t]]
            alpha[t] /= alpha[t].sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            beta[t] = np.where(mask[:, t + 1, None], (beta[t + 1] * np.c_[np.ones(n), x[:, t + 1]]) @ m.T, 1.0)
            beta[t] /= beta[t].sum(axis=1, keepdims=True)
        p = alpha * beta
        p = (p / p.sum(axis=2, keepdims=True))[:, :, 1].T
        gap = (p - gold) * mask
        pairs = np.zeros(4)
        for t in range(length - 1):
            pair = alpha[t, :, :, None] * m * (beta[t + 1] * np.c_[np.ones(n), x[:, t + 1]])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            pairs += (pair * both[:, t, None, None]).sum(axis=0).ravel()
        g = np.empty_like(self.theta)
        g[:size] = np.bincount((ids + self.offset).ravel(), np.repeat(gap.ravel(), ids.shape[2]), size)
        g[size] = gap.sum()
        g[size + 1 : size + 3] = (-gap[:, 0].sum(), gap[:, 0].sum())
        g[size + 3 :] = pairs - np.bincount((2 * gold[:, :-1] + gold[:, 1:])[both], minlength=4)
        return g / max(1, mask.sum())


def _marginals_of(model: _Model, words: Words, ids: _Ids) -> np.ndarray:
    """Marginals of all words, some documents at a time as in scoring."""
    chain = Scorer(Field({}, 0.0, tuple(model.start.tolist()), tuple(map(tuple, model.steps.tolist())), (0.0, 0.0, 0.0)))._chain
    counts = words.counts[words.counts > 0]
    ends, out, at = np.cumsum(counts), [np.zeros(0)], 0
    while at < len(counts):
        begin = int(ends[at] - counts[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + MANY)))
        e = model.emissions(ids[np.arange(begin, int(ends[to - 1]))])
        out.append(chain(e, ends[at:to] - counts[at:to] - begin))
        at = to
    return np.concatenate(out)


class Scorer:
    def __init__(self, field: Field):
        self.field = field
        self.young: dict[str, tuple[float, float, float]] = {}
        self.old: dict[str, tuple[float, float, float]] = {}

    def _weights(self, distinct: list[str]) -> np.ndarray:
        """(words, 3): what each word adds to its own emission, to that of the next word and to that of the word before."""
        f, young, old = self.field, self.young, self.old
        own, before, after = f.weights.get, f.before.get, f.after.get
        out = np.empty((len(distinct), 3))
        for row, word in enumerate(distinct):
            w = young.get(word)
            if w is None:
                w = old.get(word)
                if w is None:
                    names = features(word)
                    whole = names[0] if names else ""
                    w = (f.bias + sum([own(x, 0.0) for x in names]), before(whole, 0.0), after(whole, 0.0))
                young[word] = w
            out[row] = w
        if len(young) > YOUNG_WORDS:
            self.young, self.old = {}, young
        return out

    def marginals(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents that have words, marginals of state 1 of all words in a row, where each of these documents starts)."""
        w = self._weights(words.distinct)
        e = w[words.codes, 0]
        document = words.document
        same = document[1:] == document[:-1]
        e[1:] += np.where(same, w[words.codes[:-1], 1], 0)
        e[:-1] += np.where(same, w[words.codes[1:], 2], 0)
        at = np.flatnonzero(words.counts)
        first = (np.cumsum(words.counts) - words.counts)[at]
        return at, self._chain(e, first) if len(e) else e, first

    def summaries(self, words: Words, marginals: tuple | None = None) -> tuple[np.ndarray, ...]:
        """For each document the largest logit of a marginal, and the logarithms of one plus the expected toxic words and all words."""
        peak, count = np.full(len(words.counts), -12.0), np.zeros(len(words.counts))
        at, p, first = marginals or self.marginals(words)
        if len(at):
            top = np.clip(np.maximum.reduceat(p, first), 1e-6, 1 - 1e-6)
            peak[at] = np.maximum(np.log(top / (1 - top)), -12)
            count[at] = np.log1p(np.add.reduceat(np.where(p > 0.05, p, 0), first))
        return peak, count, np.log1p(words.counts)

    def _chain(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Forward-backward over documents in a row, as one chain that forgets its state at the start of each.

        The chain is cut into blocks. The product of the 2 x 2 steps of each block is taken for all
        blocks at once; the products hand the forward and backward messages from block to block;
        then the messages inside all blocks are taken at once. Exact for any length.
        """
        n = len(e)
        blocks = -(-n // BLOCK)
        x = np.ones(blocks * BLOCK)
        x[:n] = np.exp(np.clip(e, -30, 30))
        s, m = np.exp(self.field.start), np.exp(self.field.steps)
        fresh = np.zeros(blocks * BLOCK, bool)
        fresh[first] = True
        fresh[n:] = True
        m00, m10 = np.where(fresh, s[0], m[0, 0]), np.where(fresh, s[0], m[1, 0])
        m01, m11 = np.where(fresh, s[1], m[0, 1]) * x, np.where(fresh, s[1], m[1, 1]) * x
        m00, m01, m10, m11 = (np.ascontiguousarray(v.reshape(blocks, BLOCK).T) for v in (m00, m01, m10, m11))

        p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
        for t in range(BLOCK):
            p00, p01 = p00 * m00[t] + p01 * m10[t], p00 * m01[t] + p01 * m11[t]
            p10, p11 = p10 * m00[t] + p11 * m10[t], p10 * m01[t] + p11 * m11[t]
            if t % 8 == 7:
                z = 1 / (p00 + p01 + p10 + p11)
                p00, p01, p10, p11 = p00 * z, p01 * z, p10 * z, p11 * z
        a0, a1, b0, b1 = (np.empty(blocks) for _ in range(4))
        u, v = 1.0, 0.0
        for k, (q00, q01, q10, q11) in enumerate(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True)):
            a0[k], a1[k] = u, v
            u, v = u * q00 + v * q10, u * q01 + v * q11
            u, v = u / (u + v), v / (u + v)
        u, v = 0.5, 0.5
        for k in range(blocks - 1, -1, -1):
            b0[k], b1[k] = u, v
            u, v = p00[k] * u + p01[k] * v, p10[k] * u + p11[k] * v
            u, v = u / (u + v), v / (u + v)
        f = np.empty((BLOCK, blocks))  # forward share of state 1
        for t in range(BLOCK):
            a0, a1 = a0 * m00[t] + a1 * m10[t], a0 * m01[t] + a1 * m11[t]
            z = 1 / (a0 + a1)
            a0, a1 = a0 * z, a1 * z
            f[t] = a1
        for t in range(BLOCK - 1, -1, -1):
            top = f[t] * b1
            f[t] = top / (top + (1 - f[t]) * b0)
            b0, b1 = m00[t] * b0 + m01[t] * b1, m10[t] * b0 + m11[t] * b1
            z = 1 / (b0 + b1)
            b0, b1 = b0 * z, b1 * z
        return f.T.reshape(-1)[:n]

    def score(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores, and the offending spans as code-point offsets with their marginals."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        column = pc.fill_null(column.cast(pa.large_string()), "")
        spans: list[list[dict]] = [[] for _ in range(len(column))]
        scores = np.empty(len(column))
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
        at = 0
        while at < len(column):  # the words of a slice at a time are held
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE)))
            scores[at:to] = self._score(column.slice(at, to - at), spans, at)
            at = to
        return scores, spans

    def _score(self, texts: pa.Array, spans: list[list[dict]], offset: int) -> np.ndarray:
        words = split_words(texts)
        at, p, first = found = self.marginals(words)
        measures = self.summaries(words, found)
        hits = np.flatnonzero(p >= SPAN_AT)
        document = np.searchsorted(first, hits, "right") - 1
        for k in np.unique(document):
            own = {int(i - first[k]): float(p[i]) for i in hits[document == k]}
            text = texts[int(at[k])].as_py()
            spans[offset + at[k]] = [{"start": w.start(), "end": w.end(), "marginal": own[i]} for i, w in enumerate(WORD.finditer(text)) if i in own]
        *weights, intercept = self.field.calibration
        return sigmoid(sum(w * x for w, x in zip(weights, measures)) + intercept)


def toxicity(field: Field) -> Callable:
    """A column function: text -> struct(score, spans) by ``field``."""
    number = hash((field.bias, field.start, field.steps, field.calibration, len(field.weights), len(field.before)))

    @F.arrow_udf(SCHEMA)
    def crf(text: pa.Array) -> pa.Array:
        scores, spans = held(("toxicity", number), lambda: Scorer(field)).score(text)
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, kinds)], names=["score", "spans"])

    return crf


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, toxic_docs: int = 1200, clean_docs: int = 3000) -> Field:
    """Fit on at most ``toxic_docs`` and ``clean_docs`` labelled documents outside the held-out fold."""
    return fit(labelled_sample(docs, labels, "toxic", folds, held_out, {1: toxic_docs, 0: clean_docs}))


def score_toxicity(docs: DataFrame, field: Field, column: str = "toxicity") -> DataFrame:
    """``docs`` with a struct(score, spans) column.

    Whole texts are scored. Null and empty texts have no words: their score is that of a document
    whose every marginal is least, and no spans. Repeated rows score alike; other columns stay.
    """
    return small_batches(docs).withColumn(column, toxicity(field)(F.make_valid_utf8(F.col("text"))))
